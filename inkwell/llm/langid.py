"""Language ID by unigram pieces, summed over all segmentations of a text's words."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The training sample: documents of a language, and its distinct words, at most.
DOCS, WORDS = 1500, 40_000
#: EM rounds and the count that every piece of the vocabulary starts with.
ROUNDS, PRIOR = 4, 0.01
#: Scored words that a task keeps, and their bytes; places of words times letters that are summed at a time.
KEPT, KEPT_BYTES, CELLS = 300_000, 24 << 20, 500_000
#: Steps between two scalings of the forward sums: a letter's odds are over 1e-12, so sums stay over 1e-200.
STEPS = 16
LETTERS = regex.compile(r"\p{L}+")


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a tiktoken rank file that can occur in a space and lower-case letters; all single bytes are."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in pieces if len(p) == 1 or plausible(p)]


def plausible(piece: bytes) -> bool:
    text = piece.removeprefix(b" ").decode("utf-8", "ignore")
    return b" " not in piece[1:] and not any(c.isascii() and not c.islower() for c in text)


class Trie:
    """Pieces by a dense table of transitions; state 0 is dead, 1 the root."""

    def __init__(self, pieces: list[bytes]) -> None:
        used = sorted({b for p in pieces for b in p})
        self.code = np.zeros(256, np.int32)
        self.code[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        rows: list[dict[int, int]] = [{}, {}]
        ends: list[int] = [-1, -1]
        for i, p in enumerate(pieces):
            at = 1
            for c in self.code[list(p)].tolist():
                if c not in rows[at]:
                    rows.append({})
                    ends.append(-1)
                    rows[at][c] = len(rows) - 1
                at = rows[at][c]
            ends[at] = i
        self.next = np.zeros((len(rows), width), np.int32)
        for s, row in enumerate(rows):
            if row:
                self.next[s, list(row)] = list(row.values())
        self.end = np.array(ends, np.int32)
        self.deep = max(map(len, pieces), default=1)

    def pad(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words as a table of byte codes, and their lengths."""
        n = np.array([len(w) for w in words])
        m = int(n.max(initial=1))
        raw = np.frombuffer(b"".join(w.ljust(m, b"\0") for w in words), np.uint8).reshape(len(words), m)
        table = self.code[raw]
        table[np.arange(m) >= n[:, None]] = 0
        return table, n

    def arcs(self, table: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """For each start the pieces from there: (end, word rows, piece numbers)."""
        m = table.shape[1]
        for i in range(m):
            rows = np.flatnonzero(table[:, i])
            state = np.ones(len(rows), np.int32)
            found = []
            for j in range(i, m):
                state = self.next[state, table[rows, j]]
                alive = state > 0
                if not alive.all():
                    rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                piece = self.end[state]
                is_end = piece >= 0
                found.append((j + 1, rows[is_end], piece[is_end]))
            yield i, found


def batches(words: list[bytes]) -> Iterator[np.ndarray]:
    """Numbers of words of like lengths, CELLS letters at a time or one word."""
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    while at < len(order):
        longest = len(words[order[at]]) * 5 // 4 + 2
        stop = at + 1
        while stop < len(order) and len(words[order[stop]]) <= longest and (stop - at) * longest < CELLS:
            stop += 1
        yield order[at:stop]
        at = stop


def rescale(a: np.ndarray, i: int, deep: int, scale: np.ndarray) -> None:
    """Divide the sums from place i on, as far as a piece reaches, by their largest, whose log goes to the scale."""
    open_ = a[i : i + deep + 1]
    top = open_.max(axis=0)
    top[top == 0] = 1.0
    open_ /= top
    scale += np.log(top)


def forward(trie: Trie, words: list[bytes], p: np.ndarray) -> np.ndarray:
    """log of each word's probability under each language, p (pieces, languages), over all segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    for rows in batches(words):
        table, n = trie.pad([words[k] for k in rows])
        a, scale = np.zeros((table.shape[1] + 1, len(rows), p.shape[1])), np.zeros((len(rows), p.shape[1]))
        a[0] = 1.0
        for i, found in trie.arcs(table):
            done = n == i
            out[rows[done]] = np.log(a[i, done]) + scale[done]
            if i and i % STEPS == 0:
                rescale(a, i, trie.deep, scale)
            for end, who, piece in found:
                a[end, who] += a[i, who] * p[piece]
        done = n == table.shape[1]
        out[rows[done]] = np.log(a[-1, done]) + scale[done]
    return out


def expected(trie: Trie, words: list[bytes], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected counts of each piece over all segmentations of the weighted words: forward times backward, as logs."""
    counts, log_p = np.zeros(len(p)), np.log(p)
    for group in batches(words):
        table, n = trie.pad([words[k] for k in group])
        rows, arcs = np.arange(len(n)), list(trie.arcs(table))
        a, b = np.zeros((table.shape[1] + 1, len(n))), np.zeros((table.shape[1] + 1, len(n)))
        log_a, log_b = np.full_like(a, -np.inf), np.full_like(b, -np.inf)
        scale = np.zeros(len(n))
        a[0] = 1.0
        for i, found in arcs:
            if i and i % STEPS == 0:
                rescale(a, i, trie.deep, scale)
            with np.errstate(divide="ignore"):
                log_a[i] = np.log(a[i]) + scale
            for end, who, piece in found:
                a[end, who] += a[i, who] * p[piece]
        scale = np.zeros(len(n))
        b[n, rows], log_b[n, rows] = 1.0, 0.0
        for i, found in reversed(arcs):
            for end, who, piece in found:
                b[i, who] += p[piece] * b[end, who]
            with np.errstate(divide="ignore"):
                log_b[i] = np.log(b[i]) + scale
            if i % STEPS == 0:
                rescale(b, i, trie.deep, scale)
        for i, found in arcs:
            for end, who, piece in found:
                counts += np.bincount(piece, np.exp(log_a[i, who] + log_p[piece] + log_b[end, who] - log_b[0, who]) * weight[group][who], minlength=len(p))
    return counts


def blocks(text: str) -> list[bytes]:
    """A text's runs of letters, whole and lower-cased, each with a leading space."""
    return [b" " + w.encode() for w in LETTERS.findall(text.lower())]


def train(samples: dict[str, dict[bytes, int]], pieces: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces, languages), by EM from equal odds of pieces of one length."""
    trie = Trie(pieces)
    langs = sorted(samples)
    start = np.array([0.02 ** (1 + 0.1 * len(p)) for p in pieces])
    start /= start.sum()
    out = np.zeros((len(pieces), len(langs)))
    for k, lang in enumerate(langs):
        words, weight = list(samples[lang]), np.array(list(samples[lang].values()), float)
        p = start
        for _ in range(ROUNDS):
            p = expected(trie, words, weight, p) + PRIOR
            p /= p.sum()
        out[:, k] = p
    return langs, out


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def word_counts(docs: DataFrame) -> dict[str, dict[bytes, int]]:
    """Word counts by language of at most about DOCS documents each, drawn by a hash of doc_id, never held-out ones."""
    docs = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, DOCS / n)))])
    share = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / float(1 << 53)
    sample = docs.where(share < F.element_at(rate, F.col("lang")))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = blocks(text.as_py())
                words += new
                langs += [lang] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary())], names=["lang", "word"])

    from pyspark.sql import Window

    counts = sample.select("lang", "text").mapInArrow(step, "lang string, word binary").groupBy("lang", "word").agg(F.count("*").alias("n"))
    # sums of the bounded sample, whatever the table's size
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= WORDS)
    found: dict[str, dict[bytes, int]] = {}
    table = top.select("lang", "word", "n").toArrow()
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        found.setdefault(lang, {})[word] = n
    return dict(sorted((k, dict(sorted(v.items()))) for k, v in found.items()))


class Scorer:
    """Log-likelihoods of texts, with a bounded store of the words scored so far."""

    def __init__(self, langs: list[str], pieces: list[bytes], p: np.ndarray) -> None:
        self.langs, self.trie, self.p = langs, Trie(pieces), p
        self.known: dict[bytes, int] = {}
        self.bytes = 0
        self.scores = np.zeros((0, len(langs)))

    def words(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > KEPT or self.bytes > KEPT_BYTES:
            self.known, self.scores, self.bytes = {}, np.zeros((0, len(self.langs))), 0
            new = list(set(words))
        if new:
            self.bytes += sum(map(len, new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, forward(self.trie, new, self.p)))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, scores = [], []
        for at in range(0, len(texts), 512):
            each = [blocks(t) if t else [] for t in texts[at : at + 512]]
            flat = self.words([w for x in each for w in x])
            n = np.array([len(x) for x in each])
            doc = np.repeat(np.arange(len(n)), n)
            total = np.stack([np.bincount(doc, self.scores[flat, k], minlength=len(n)) for k in range(len(self.langs))], axis=1)
            odds = np.exp(total - total.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            best = odds.argmax(axis=1)
            out += [self.langs[b] if k else "und" for b, k in zip(best, n, strict=True)]
            scores += [float(odds[i, b]) if n[i] else 0.0 for i, b in enumerate(best)]
        return out, scores


_scorers: dict[tuple, Scorer] = {}


def scorer_of(langs: list[str], pieces: list[bytes], p: np.ndarray) -> Scorer:
    """The worker's scorer of a model; tasks after its first find the trie built and words scored."""
    key = (*langs, len(pieces), zlib.crc32(p.tobytes()))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(langs, pieces, p.astype(float))
    return _scorers[key]


def identify(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language under which a text's words are likeliest, all weighing alike.

    Piece probabilities come from the text and non-null lang of documents that are not held out (crc32 of doc_id mod 3
    is 1), from a sample of at most about DOCS documents and WORDS words a language; predictions see the text only.
    score: the posterior of the language under equal priors. Null texts and texts without a letter, or if there is
    nothing to learn from: `und` with score 0. A null doc_id is never held out. Ties go to the first language by name.
    A row per input row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = vocabulary(vocabulary_path)
    samples = word_counts(docs)
    langs, p = train(samples, pieces) if samples else ([], np.zeros((len(pieces), 0)))
    model = spark.sparkContext.broadcast((langs, pieces, p.astype(np.float32)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, p = model.value
        scorer = scorer_of(langs, pieces, p) if langs else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lang, score = scorer.predict(texts) if scorer else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return narrow.mapInArrow(step, "doc_id long, held_out boolean, lang_pred string, score double")
