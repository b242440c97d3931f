"""Personal data: base patterns, and a skip-chain CRF that labels what repeats or resembles them."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Labels of tokens: 0 is none of the kinds.
LABELS = 1 + len(KINDS)
#: What the model is fitted on at most, about: tokens, documents, and tokens of a document outside personal data.
TOKENS, DOCS, PLAIN = 60_000, 20_000, 40
#: Rounds of message passing; its damping; the least marginal of an added span's token; the most a pair's potential says.
ROUNDS, DAMP, SURE, MOST = 12, 0.3, 0.9, 5.0

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a digit run is entered at its start only: an earlier match takes a run whole, and if none starts there none does inside
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
MASKED = re.compile(r"(?<!\S)[^\s(\[]*+(?:[(\[](?!(?:at|dot)[)\]])[^\s(\[]*+)*+[(\[](?:at|dot)[)\]]\S*+", re.IGNORECASE)
AT = re.compile(r"@|[(\[]at[)\]]", re.IGNORECASE)
JOINT = re.compile(r"[(\[](?:at|dot)[)\]]|[^0-9a-z]")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @, domain: each @ closes the run of local characters before it, back to the last match."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCALS:
            start -= 1
        if start < at and at >= after and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            after = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind and start."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def trimmed(token: str) -> tuple[str, int]:
    """The token without punctuation around it, and how much went in front."""
    bare = token.strip(".,;:!?()[]{}<>\"'#$%&*|=_")
    return bare, token.find(bare) if bare else 0


def features(bare: str, before: bool, after: bool, run: int) -> list[float]:
    """Of the token's shape, without what the base patterns ask for; run: the digits of the numbers around it."""
    n = sum(c.isdigit() for c in bare)
    masked = bool(MASKED.match(bare)) if "(" in bare or "[" in bare else False
    parts = re.split(r"[^0-9]+", bare.strip("+")) if len(bare) < 60 else []
    return [
        1.0,
        float("@" in bare),
        float(masked),
        float(len(parts) == 4 and all(p and len(p) <= 3 for p in parts)),
        float(16 <= n <= 19),
        float(8 <= n <= 15),
        min(n, 20) / 10,
        float(n == len(bare)),
        float(any(c.isalpha() for c in bare)),
        n / max(1, len(bare)),
        float(before),
        float(after),
        float(8 <= run <= 15),
        float(16 <= run <= 19),
        float(n == 0 and not masked),
    ]


WIDTH = 15


def letters(token: str) -> str:
    """The token's letters and digits, lower-case, however it is joined."""
    return JOINT.sub("", token.lower())


def local_part(token: str) -> str:
    """Of an address the part before the @, if it is no mere word: six letters or digits with a digit or a joint."""
    part = AT.split(token)[0]
    return letters(part) if len(letters(part)) >= 6 and re.search(r"[0-9._+-]", part) else ""


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """(start, end, bare, first, last) of tokens with a digit or @, masked addresses, and tokens like a known address."""
    found = {m.start(): m for m in TOKEN.finditer(text)}
    if "(" in text or "[" in text:
        found |= {m.start(): m for m in MASKED.finditer(text)}
    known = {x for k, s, e in base if k == 0 for x in (letters(text[s:e]), local_part(text[s:e])) if x}
    if known:
        longest = 2 * max(map(len, known)) + 20
        for m in re.finditer(r"\S+", text):
            if m.start() not in found and m.end() - m.start() <= longest and letters(m[0]) in known:
                found[m.start()] = m
    out = []
    for at in sorted(found):
        m = found[at]
        bare, skipped = trimmed(m[0])
        if bare:
            out.append((at + skipped, at + skipped + len(bare), bare, at, m.end()))
    return out


class Tokens:
    """The candidate tokens of some texts as one graph: chain edges of neighbours, skip edges of tokens that repeat or resemble.

    Tokens resemble each other if their letters and digits are the same; if they are numbers, alone or several in a
    row, of which the last seven digits are; or if one is the local part of the other's address. With truth (spans as
    base ones), y has the labels of both.
    """

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]], truth: list[list[tuple[int, int, int]]] | None = None) -> None:
        doc, start, end, rows, label, y, chain, skip = [], [], [], [], [], [], [], []
        for d, text in enumerate(texts):
            last: dict[str, int] = {}
            base = sorted((s, e, k) for k, s, e in spans[d])
            more = sorted((s, e, k) for k, s, e in truth[d]) if truth else []
            found = candidates(text, spans[d])
            near = [False] + [text[x[4] : z[3]].isspace() for x, z in zip(found[:-1], found[1:], strict=True)] + [False]
            digits = [re.sub(r"[^0-9]", "", x[2]) for x in found]
            number = [bool(n) and not re.search(r"[^\W0-9_]|@", x[2]) for n, x in zip(digits, found, strict=True)]
            first = 0
            for i, (s, e, bare, _, _) in enumerate(found):
                here = len(doc)
                if not (i and near[i] and number[i] and number[i - 1]):
                    first = i
                stop = i + 1
                while number[i] and stop < min(len(found), first + 8) and near[stop] and number[stop]:
                    stop += 1
                run = "".join(digits[first:stop]) if number[i] and stop - first <= 8 else digits[i]
                doc.append(d)
                start.append(s)
                end.append(e)
                rows.append(features(bare, near[i], near[i + 1], len(run)))
                over = [k for b, c, k in base if b < e and s < c]
                label.append(over[0] + 1 if over else 0)
                over = over or [k for b, c, k in more if b < e and s < c]
                y.append(over[0] + 1 if over else 0)
                if near[i]:
                    chain.append((here - 1, here))
                keys = set()
                if len(whole := letters(bare)) >= 4:
                    keys |= {"t" + whole, "l" + whole}
                if "@" in bare or rows[-1][2]:
                    keys |= {"l" + x for x in [local_part(bare)] if x}
                if number[i] and len(run) >= 7:
                    behind = len("".join(digits[i + 1 : stop]))
                    keys.add(f"n{run[-7:]}:{behind}")
                for key in sorted(keys):
                    if key in last:
                        skip.append((last[key], here))
                    last[key] = here
        self.doc, self.start, self.end = np.array(doc, int), np.array(start, int), np.array(end, int)
        self.x, self.label, self.y = np.array(rows, float).reshape(-1, WIDTH), np.array(label, int), np.array(y, int)
        self.chain, self.skip = (np.array(sorted(set(e)), int).reshape(-1, 2) for e in (chain, skip))


def variant(kind: int, span: str, r: random.Random) -> str:
    """The same data written so that its base pattern misses it."""
    if kind == 0:
        local, domain = span.split("@", 1)
        return local + r.choice(("(at)", "[at]", "(AT)")) + domain
    if kind == 1:
        return span.replace(".", r.choice("-,_/"))
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 2:
        return r.choice("./_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return r.choice((digits, digits[-10:], span.lstrip("+"), "00" + digits, "/".join((digits[:3], digits[3:])), " ".join((digits[:-7], digits[-7:-4], digits[-4:]))))


def decoy(text: str, r: random.Random) -> str:
    """Something of the same shape: other digits, and other letters but for how an address is masked."""
    parts = re.split(r"([(\[](?:at|dot)[)\]])", text, flags=re.IGNORECASE)
    other = lambda c: str(r.randrange(10)) if c.isdigit() else r.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c
    return "".join(x if i % 2 else "".join(map(other, x)) for i, x in enumerate(parts))


def augmented(text: str, r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with a variant of each base span (the first eight) and a decoy of its shape put between words; the variants' spans.

    Nothing but its likeness to the span tells a variant from a decoy, so a model of the text learns to go by that.
    """
    base = base_spans(text)
    gaps = [m.end() for m in re.finditer(r"\s", text) if not any(s < m.end() <= e for _, s, e in base)] + [len(text)]
    new = []
    for k, s, e in base[:8]:
        v = variant(k, text[s:e], r)
        new += [(r.choice(gaps), k, v), (r.choice(gaps), -1, decoy(v, r))]
    out, spans, at, done = [], [], 0, 0
    for gap, k, v in sorted(new):
        out += [text[done:gap], " ", v, " "]
        at += gap - done + 1
        if k >= 0:
            spans.append((k, at, at + len(v)))
        at, done = at + len(v) + 1, gap
    return "".join([*out, text[done:]]), spans


class SkipChain:
    """Node, chain and skip potentials, each fitted on its own factors (piecewise training)."""

    def __init__(self) -> None:
        self.node, self.chain, self.skip = np.zeros((WIDTH, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))

    def fit(self, x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 300) -> None:
        """x, y: tokens' features and labels; chain, skip: counts of label pairs on either kind of edge."""
        m, v = np.zeros_like(self.node), np.zeros_like(self.node)
        target = np.eye(LABELS)[y]
        for t in range(1, rounds + 1):
            z = x @ self.node
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = x.T @ (target - p) / len(x) - 1e-4 * self.node
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.node = self.node + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        # what a pair says beyond its tokens: its share over the shares of its labels, of a chain's among its own edges, as
        # any two tokens may be neighbours; of a skip edge's among the tokens that nodes are fitted to, as a likeness is news
        tokens = (np.bincount(y, minlength=LABELS) + 0.5) / (len(y) + 0.5 * LABELS)
        for name, counts in (("chain", chain), ("skip", skip)):
            both = counts + counts.T + 0.5
            share = both / both.sum()
            alone = share.sum(axis=1) if name == "chain" else tokens
            setattr(self, name, np.clip(np.log(share / np.outer(alone, alone)), -MOST, MOST))

    def marginals(self, graph: Tokens) -> np.ndarray:
        """Loopy sum-product over all documents' graphs at once; tokens of base spans are held at their label."""
        z = graph.x @ self.node
        z -= z.max(axis=1, keepdims=True)
        held = graph.label > 0
        z[held] = -30.0
        z[held, graph.label[held]] = 0.0
        edges = np.concatenate((graph.chain, graph.skip))
        if not len(edges):
            p = np.exp(z)
            return p / p.sum(axis=1, keepdims=True)
        factor = np.exp(np.concatenate((np.repeat(self.chain[None], len(graph.chain), 0), np.repeat(self.skip[None], len(graph.skip), 0))))
        a, b = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        factor = np.concatenate((factor, factor.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        message = np.full((len(a), LABELS), -np.log(LABELS))
        for _ in range(ROUNDS):
            belief = z.copy()
            np.add.at(belief, b, message)
            out = belief[a] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.einsum("ei,eij->ej", out, factor)
            new = np.log(new / new.sum(axis=1, keepdims=True))
            message = np.logaddexp(np.log(1 - DAMP) + new, np.log(DAMP) + message)
        np.add.at(z, b, message)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, graph: Tokens, spans: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Per text the spans of tokens outside base spans that are some kind with marginal SURE or more."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in spans]
        if not len(graph.doc):
            return out
        p = self.marginals(graph)
        kind = p.argmax(axis=1)
        new = np.flatnonzero((graph.label == 0) & (kind > 0) & (p.max(axis=1) >= SURE))
        linked = {(int(x), int(y)) for x, y in graph.chain}
        for i in new.tolist():
            mine = out[graph.doc[i]]
            if mine and (i - 1, i) in linked and mine[-1][0] == kind[i] - 1 and mine[-1][2] == graph.end[i - 1]:
                mine[-1] = (mine[-1][0], mine[-1][1], int(graph.end[i]))
            else:
                mine.append((int(kind[i]) - 1, int(graph.start[i]), int(graph.end[i])))
        return out


def fitted(docs: DataFrame) -> SkipChain | None:
    """A model of about DOCS documents drawn by a hash of id and text, with variants of the base patterns' spans (see `augmented`).

    Labels are the base patterns' and the variants'. Of a document all tokens of either are learnt from and PLAIN others.
    """
    docs = docs.where("text is not null")
    rate = min(1.0, DOCS / max(1, docs.count()))
    mark = F.xxhash64("doc_id", "text", F.lit(13))
    drawn = docs.select("text", mark.alias("mark")).where(F.shiftrightunsigned("mark", 11) / float(1 << 53) < rate).where(F.col("text").rlike("[0-9@]"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, mark in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                r = random.Random(mark)
                t, truth = augmented(text.as_py(), r)
                g = Tokens([t], [base_spans(t)], [truth])
                if not len(g.doc):
                    continue
                edge = [np.bincount(g.y[e[:, 0]] * LABELS + g.y[e[:, 1]], minlength=LABELS**2).tolist() for e in (g.chain, g.skip)]
                plain = np.flatnonzero(g.y == 0).tolist()
                keep = np.flatnonzero(g.y > 0).tolist()[:PLAIN] + sorted(r.sample(plain, min(PLAIN, len(plain))))
                yield pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([g.x[keep].ravel().tolist()]), pa.array([g.y[keep].tolist()]), pa.array([edge[0]]), pa.array([edge[1]])], names=["mark", "x", "y", "chain", "skip"])

    rows = drawn.mapInArrow(step, "mark long, x array<double>, y array<long>, chain array<long>, skip array<long>")
    got = rows.orderBy("mark").limit(TOKENS // 3).toArrow()
    if not got.num_rows:
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    y = got.column("y").combine_chunks().flatten().to_numpy()
    order = np.lexsort((*x.T, y))[:: max(1, len(y) // TOKENS)]
    pairs = [got.column(c).combine_chunks().flatten().to_numpy().reshape(-1, LABELS, LABELS).sum(axis=0) for c in ("chain", "skip")]
    model = SkipChain()
    model.fit(x[order], y[order], *pairs)
    return model


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal(docs: DataFrame) -> DataFrame:
    """Spans of personal data in docs (doc_id, text), in code points, ends exclusive.

    The model adds what resembles a base span of the same document: an address masked or its local part alone, numbers
    with other separators or without a country code. Returns doc_id, n_email, n_ip, n_card, n_phone (base patterns), base_sha256 of their spans, spans (all, those that
    the CRF adds included) and n_added. Null text: empty; an empty text has no span. A row per input row, repeated
    rows alike; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                texts = [x or "" for x in some.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = model.value.added(Tokens(texts, base), base) if model.value else [[] for _ in texts]
                counts = [pa.array([sum(k == n for k, _, _ in b) for b in base], pa.int64()) for n in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), *counts, digest, pa.array([joined(b + m) for b, m in zip(base, more, strict=True)], pa.string()), pa.array([len(m) for m in more], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(step, schema)
