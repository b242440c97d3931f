"""Document quality by a linear-chain CRF over lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted on, at most (about), and bytes of each.
SAMPLE, LONG = 3000, 200_000
KINDS = ("lower", "upper", "digit", "space", "mark", "bar", "bang", "symbol", "line")


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.islower():
            k = "lower"
        elif c.isupper():
            k = "upper"
        elif c.isdigit():
            k = "digit"
        elif c == "\n":
            k = "line"
        elif c.isspace():
            k = "space"
        else:
            k = "bar" if c == "|" else "bang" if c in "!?" else "symbol" if c in "#$%&*@^~=+<>{}[]\\/_`" else "mark"
        out[b] = KINDS.index(k)
    return out


KIND = _kinds()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with those of the lines around it, the lines' bytes, and the lines of each text."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = KIND[raw]
    line = np.cumsum(kind == KINDS.index("line"))
    line = np.concatenate(([0], line[:-1])) if len(line) else line
    total = sum(t.count(b"\n") + 1 for t in texts)
    counts = np.bincount(line * len(KINDS) + kind, minlength=total * len(KINDS)).reshape(total, len(KINDS))[:, :-1].astype(float)
    size = counts.sum(axis=1)
    n = np.array([t.count(b"\n") + 1 for t in texts])
    share = counts / np.maximum(size, 1)[:, None]
    words = counts[:, KINDS.index("space")] + 1
    again, unlike = repeats(texts)
    own = np.column_stack((again, unlike, share[:, :3], np.minimum(share[:, 4:] * 4, 1.5), np.log1p(size) / 5, np.minimum(size / words, 20) / 10, size == 0))
    doc = np.repeat(np.arange(len(n)), n)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.column_stack((own, before, after, np.ones(total))), size, n


def repeats(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of every line: the share of words that equal the one before, and of different words; 0 and 1 without a word."""
    again, unlike = [], []
    for text in texts:
        for line in text.split(b"\n"):
            words = line.split()
            again.append(sum(map(eq, words, words[1:])) / len(words) if words else 0.0)
            unlike.append(len(set(words)) / len(words) if words else 1.0)
    return np.array(again), np.array(unlike)


def padded(x: np.ndarray, n: np.ndarray, rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x of some documents as (documents, longest, ...), and which places hold a line."""
    m = int(n[rows].max())
    at = start[rows][:, None] + np.minimum(np.arange(m), n[rows][:, None] - 1)
    return x[at], np.arange(m) < n[rows][:, None]


def groups(n: np.ndarray, cells: int = 400_000) -> Iterator[np.ndarray]:
    """Documents of like line counts together."""
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        most = n[order[at]] * 5 // 4 + 2
        stop = at + 1
        while stop < len(order) and n[order[stop]] <= most and (stop - at) * most < cells:
            stop += 1
        yield order[at:stop]
        at = stop


def marginals(node: np.ndarray, real: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: node (documents, lines, 2) log potentials, edge (2, 2) -> P(line label), expected label pairs."""
    d, m, _ = node.shape
    potential = np.exp(node - node.max(axis=2, keepdims=True))
    move = np.exp(edge)
    f, b = np.zeros_like(node), np.ones_like(node)
    f[:, 0] = potential[:, 0] / potential[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, m):
        x = (f[:, t - 1] @ move) * potential[:, t]
        f[:, t] = np.where(real[:, t, None], x / x.sum(axis=1, keepdims=True), f[:, t - 1])
    for t in range(m - 2, -1, -1):
        x = (potential[:, t + 1] * b[:, t + 1]) @ move.T
        b[:, t] = np.where(real[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
    p = f * b
    p /= p.sum(axis=2, keepdims=True)
    pairs = np.zeros((2, 2))
    if m > 1:
        x = f[:, :-1, :, None] * move * (potential * b)[:, 1:, None, :]
        x /= x.sum(axis=(2, 3), keepdims=True)
        pairs = (x * real[:, 1:, None, None]).sum(axis=(0, 1))
    return p, pairs


class LineCRF:
    """Label 1: a good line. weight: of the features, for label 1 against 0; edge: of label pairs in a row."""

    def __init__(self, features: int) -> None:
        self.weight, self.edge, self.scale = np.zeros(features), np.zeros((2, 2)), np.array([1.0, 0.0])

    def good(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P(good) of every line."""
        out, start = np.zeros(len(x)), np.cumsum(n) - n
        score = x @ self.weight
        for rows in groups(n):
            s, real = padded(score, n, rows, start)
            p, _ = marginals(np.stack((np.zeros_like(s), s), axis=2), real, self.edge)
            at = (start[rows][:, None] + np.arange(s.shape[1]))[real]
            out[at] = p[..., 1][real]
        return out

    def fit_lines(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, rounds: int = 40, l2: float = 1e-3) -> None:
        """Conditional likelihood of line labels, by Adam on its gradient."""
        start = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(n)), n)
        follows = doc[1:] == doc[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][follows], y[1:][follows]), 1)
        theta = np.concatenate((self.weight, self.edge.ravel()))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        parts = list(groups(n))
        for t in range(1, rounds + 1):
            self.weight, self.edge = theta[:-4], theta[-4:].reshape(2, 2)
            score, p, pairs = x @ self.weight, np.zeros(len(x)), np.zeros((2, 2))
            for rows in parts:
                s, real = padded(score, n, rows, start)
                q, e = marginals(np.stack((np.zeros_like(s), s), axis=2), real, self.edge)
                p[(start[rows][:, None] + np.arange(s.shape[1]))[real]] = q[..., 1][real]
                pairs += e
            gradient = np.concatenate((x.T @ (y - p), (seen - pairs).ravel())) / len(x) - l2 * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weight, self.edge = theta[:-4], theta[-4:].reshape(2, 2)

    def documents(self, x: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Mean of the lines' marginals, weighed by their length; an empty line weighs as one byte."""
        doc, w = np.repeat(np.arange(len(n)), n), size + 1
        return np.bincount(doc, self.good(x, n) * w, len(n)) / np.bincount(doc, w, len(n))

    def fit(self, texts: list[bytes], label: np.ndarray, rounds: int = 3) -> None:
        """From labels of documents: lines of good documents are good, and of a bad one those that the model likes
        less than its average; the labels settle over a few rounds. Then the score is calibrated on the same documents."""
        x, size, n = line_features(texts)
        doc = np.repeat(np.arange(len(n)), n)
        y = label[doc]
        for _ in range(rounds):
            self.fit_lines(x, n, y)
            p = self.good(x, n)
            level = np.quantile(p[label[doc] == 1], 0.05) if (label == 1).any() else 0.5
            lowest = np.full(len(n), np.inf)
            np.minimum.at(lowest, doc, p)
            y = np.where((label[doc] == 1) | ((p > level) & (p > lowest[doc])), 1, 0)
        z = self.logit(self.documents(x, size, n))
        a, b = 1.0, 0.0
        for _ in range(400):  # Platt scaling by Newton's method, with a little damping
            q = 1 / (1 + np.exp(-(a * z + b)))
            g = np.array([((label - q) * z).mean() - 1e-4 * a, (label - q).mean()])
            h = q * (1 - q)
            hess = np.array([[(h * z * z).mean() + 1e-3, (h * z).mean()], [(h * z).mean(), h.mean() + 1e-3]])
            step = np.linalg.solve(hess, g)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.scale = np.array([a, b])

    @staticmethod
    def logit(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """P(label 1) of each text."""
        out = []
        at = 0
        while at < len(texts):  # a few MB at a time
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) < 4_000_000):
                held += len(texts[stop])
                stop += 1
            z = self.logit(self.documents(*line_features(texts[at:stop])))
            out.append(1 / (1 + np.exp(-(self.scale[0] * z + self.scale[1]))))
            at = stop
        return np.concatenate(out) if out else np.zeros(0)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineCRF | None:
    """A model from about `sample` labelled documents that are not held out, drawn by a hash of doc_id."""
    labels = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    labels = labels.where("quality = other").select("doc_id", "quality")
    rate = min(1.0, sample / max(1, labels.count()))
    drawn = labels.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11) / float(1 << 53) < rate)
    # at most about `sample` rows of two numbers; longer texts than LONG aren't learnt from
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") < LONG)).select("doc_id", F.col("text").cast("binary").alias("text"))
    got = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality").orderBy("doc_id", "text").limit(2 * sample).toArrow()
    label = (got.column("quality").to_numpy() > 0).astype(int)
    if len(set(label.tolist())) < 2:
        return None
    texts = got.column("text").to_pylist()
    model = LineCRF(line_features(texts[:1])[0].shape[1])
    model.fit(texts, label)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs (doc_id, text) by labels (doc_id, quality).

    score is P(quality = 1) of the whole text, from its lines only; predicted is 1 from `threshold` on. Held out of
    learning: crc32 of doc_id mod 5 is 0. Null texts count as empty. A doc_id with labels that differ isn't learnt
    from; with labels of one kind only, or none, every score is 1. A row per input row, repeated ones alike; null ids
    are never held out; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")

    def rated(some: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scoring(docs, labels, rated), "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those that score less than the threshold (see quality_scores); all columns stay, whatever their names."""

    def kept(some: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return some.filter(pa.array(score >= threshold))

    return docs.mapInArrow(scoring(docs, labels, kept), docs.schema)


def scoring(docs: DataFrame, labels: DataFrame, out: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]):
    """What scores batches with a column text by a model of docs and labels, and gives out() of each part of them."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for first in range(0, batch.num_rows, 1000):
                some = batch.slice(first, 1000)
                texts = [(x or "").encode() for x in some.column(at).to_pylist()]
                yield out(some, model.value.score(texts) if model.value else np.ones(len(texts)))

    return step
