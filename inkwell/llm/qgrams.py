"""Benchmark decontamination by the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.shared import cut

#: Bytes of a gram at most; letters and digits of a passage and the step between passages; edits per passage letter.
Q, PASSAGE, STEP, RATE = 8, 64, 16, 0.1
#: Bytes of benchmark items that are searched for at a time: an index takes about a hundred times as many.
MOST = 4 << 20
DROP = bytes(b for b in range(128) if not chr(b).isalnum())


def normal(text: str | None) -> bytes:
    """Lower-cased letters and digits (all bytes beyond ASCII stay) as UTF-8."""
    return (text or "").lower().encode("utf-8", "ignore").translate(None, DROP)


def grams(text: bytes, q: int = Q) -> np.ndarray:
    """Each run of q bytes, 8 at most, as a number; none of a shorter text."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text + bytes(8 - q), np.uint8)
    out = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (n, 8), (1, 1))).view("<u8").ravel()
    return out if q == 8 else out & np.uint64((1 << 8 * q) - 1)


def gram_size(size: int, edits: int) -> int:
    """The longest gram of which a passage of that size shares one at least with any text within the edits."""
    return min(Q, size // (edits + 1))


def banded(passage: bytes, region: bytes, edits: int, offset: int, reach: int) -> int:
    """Least edits to turn the passage into a stretch of the region that starts within `reach` of offset, or edits + 1.

    Rows go over the passage, columns over diagonals offset - reach to offset + reach; a stretch may start and end on
    any of them.
    """
    width = 2 * reach + 1
    base = offset - reach
    at = np.arange(width)
    row = np.where((at + base >= 0) & (at + base <= len(region)), 0, edits + 1)
    padded = np.full(len(passage) + width + 1, -1, np.int64)
    lo, hi = max(0, base), min(len(region), base + len(padded))
    if hi > lo:
        padded[lo - base : hi - base] = np.frombuffer(region, np.uint8)[lo:hi]
    for i, c in enumerate(passage):
        change = row + (padded[i : i + width] != c)
        change[:-1] = np.minimum(change[:-1], row[1:] + 1)
        row = np.minimum.accumulate(change - at) + at  # a further letter of the region costs one each
        if row.min() > edits:
            return edits + 1
    ends = at + base + len(passage)
    return int(min(edits + 1, row[(ends >= 0) & (ends <= len(region))].min(initial=edits + 1)))


class Grams:
    """Where the grams of some passages are, for passages with grams of one size."""

    def __init__(self, passages: list[bytes], numbers: list[int], q: int) -> None:
        each = [grams(passages[k], q) for k in numbers]
        gram = np.concatenate(each)
        order = np.argsort(gram, kind="stable")
        self.q, self.gram = q, gram[order]
        self.who = np.repeat(np.array(numbers, np.int32), [len(g) for g in each])[order]
        self.at = np.concatenate([np.arange(len(g), dtype=np.uint8) for g in each])[order]
        self.bits = max(16, min(28, int(len(gram) * 8).bit_length()))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.slot(self.gram)] = True

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def shared(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Passage and diagonal of each gram that the text shares."""
        g = grams(text, self.q)
        place = np.flatnonzero(self.maybe[self.slot(g)])
        g = g[place]
        lo, hi = np.searchsorted(self.gram, g, "left"), np.searchsorted(self.gram, g, "right")
        n = hi - lo
        hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.who[hit].astype(np.int64), np.repeat(place, n) - self.at[hit]


class Index:
    """Passages of the benchmark and where their grams are. Those of under Q letters are looked for as whole words."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.passages: list[bytes] = []
        self.item: list[int] = []
        self.short: list[tuple[int, bytes]] = []
        for item, text in items:
            t = normal(text)
            starts = range(0, max(1, len(t) - PASSAGE + 1), STEP)
            for p in sorted({t[s : s + PASSAGE] for s in starts} | {t[max(0, len(t) - PASSAGE) :]}):
                if len(p) >= Q:
                    self.passages.append(p)
                    self.item.append(item)
                elif p:
                    self.short.append((item, p))
        size = np.array([len(p) for p in self.passages], np.int64)
        self.edits = (size * RATE).astype(np.int64)
        q = np.array([gram_size(m, k) for m, k in zip(size.tolist(), self.edits.tolist(), strict=True)], np.int64)
        # the lemma: an edit spoils q grams at most; a gram that a passage repeats is counted at each place
        self.least = size - q + 1 - self.edits * q
        self.grams = [Grams(self.passages, np.flatnonzero(q == x).tolist(), x) for x in sorted(set(q.tolist()))]

    def regions(self, text: bytes) -> list[tuple[int, int]]:
        """(passage, offset) for the bands of diagonals in which enough grams are shared.

        Bands are 2 * edits + 2 diagonals wide and overlap by half, so the diagonals of any alignment within the
        budget, which span at most edits + 1, lie in one of them.
        """
        each = [g.shared(text) for g in self.grams]
        if not any(len(who) for who, _ in each):
            return []
        who, diagonal = (np.concatenate(x) for x in zip(*each, strict=True))
        half = self.edits[who] + 1
        band = (diagonal + PASSAGE) // half + 1
        key = np.concatenate(((who << 40) + band, (who << 40) + band - 1))  # band b holds halves b and b + 1
        found, count = np.unique(key, return_counts=True)
        out = []
        for k in found[count >= self.least[found >> 40]].tolist():
            p, b = k >> 40, k & ((1 << 40) - 1)
            out.append((p, b * (int(self.edits[p]) + 1) - PASSAGE))
        return out

    def leaks(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, start, end) in the normalised text, the first verified passage of each item."""
        t = normal(text)
        seen: dict[int, tuple[int, int]] = {}
        for p, offset in self.regions(t):
            if self.item[p] in seen:
                continue
            edits, passage = int(self.edits[p]), self.passages[p]
            lo = max(0, offset - 2 * edits - 2)
            region = t[lo : max(0, offset + len(passage) + 2 * edits + 4)]
            if passage in region or banded(passage, region, edits, offset - lo, edits + 1) <= edits:
                seen[self.item[p]] = (max(0, offset), min(len(t), offset + len(passage)))
        if found := [(item, p) for item, p in self.short if item not in seen and p in t]:
            ends = np.cumsum([0] + [len(normal(w)) for w in (text or "").split()]).tolist()
            edges = set(ends)
            for item, p in found:
                at = t.find(p)
                while at >= 0 and not (at in edges and at + len(p) in edges):
                    at = t.find(p, at + 1)
                if at >= 0:
                    seen.setdefault(item, (at, at + len(p)))
        return [(i, *span) for i, span in seen.items()]


_indexes: dict[int, Index] = {}


def index_of(items: list[tuple[int, str]]) -> Index:
    """The worker's index of some items; tasks after its first find it built."""
    key = hash(tuple(items))
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(items)
    return _indexes[key]


def item_blocks(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark's items as broadcasts of about MOST bytes each, one after the other."""
    benchmark = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // MOST))
    for k in range(blocks):
        some = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(sorted((r["item_id"], r["text"]) for r in some.collect()))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_ids array<long>): documents of docs (doc_id, text) that hold a passage of the benchmark's items.

    A passage is 64 letters or digits of an item (all of a shorter one), stepped by 16, so any 79 in a row hold one;
    case, spaces and punctuation don't count. It is found if a stretch of the text is within 10 % edits of it; one of
    under 8 letters must be whole words. A row per input row that has a leak, items ascending; null and empty texts
    have none, nor do items without a letter or digit; repeated items count once each, repeated rows alike; an empty
    table or benchmark gives an empty result. Only doc_id, text, item_id are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    blocks = list(item_blocks(benchmark))
    if len(blocks) > 1:
        rows = cut(rows, "searched")  # the numbers stay

    def search(held: Broadcast) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(held.value)
            for batch in batches:
                found = [sorted({i for i, _, _ in index.leaks(t.as_py())}) for t in batch.column(1)]
                some = [k for k, x in enumerate(found) if x]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), pa.array([found[k] for k in some], pa.list_(pa.int64())), batch.column(2).take(pa.array(some, pa.int64()))], names=["doc_id", "item_ids", "row"])

        return rows.mapInArrow(step, "doc_id long, item_ids array<long>, row long")

    found = [search(held) for held in blocks]
    if len(found) == 1:
        return found[0].drop("row")
    found = reduce(DataFrame.union, found).groupBy("row", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return found.select("doc_id", "item_ids")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a passage of the benchmark (see find_leaks); all columns stay.

    Null and empty texts stay; repeated rows go or stay alike; the benchmark's blocks are searched for one by one.
    """

    def without(docs: DataFrame, held: Broadcast) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(held.value)
            for batch in batches:
                keep = [not index.leaks(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(step, docs.schema)

    for k, held in enumerate(item_blocks(benchmark)):
        docs = without(cut(docs, "searched") if k else docs, held)
    return docs
