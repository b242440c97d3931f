"""The nearest vectors by cosine of a stated set of queries, against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from inkwell.functions.vectors import cosine
from inkwell.operators.rank import topk
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the vectors; queries in a block; vectors that are compared with a block at once.
PARTS, BLOCK, STEP = 12, 2048, 1024


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """rows (doc_id, vec), queries (qid, q) -> (qid, method, rank, doc_id, score): every pair is scored, as products of
    matrices, a block of queries by a part of the vectors. Pairs with a vector that is no row of a matrix (null, of
    another length than the longest, or with null or infinite numbers) are scored one at a time."""
    length = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    fine, odd = rows.where(plain("doc_id", "vec", length)), rows.where(~plain("doc_id", "vec", length))
    asked, others = queries.where(plain("qid", "q", length)), queries.where(~plain("qid", "q", length))
    blocks = max(1, -(-asked.count() // BLOCK))
    scored = products(fine, asked, k, blocks)
    if not odd.isEmpty():
        scored = scored.unionByName(pairs(odd, queries))
    if not others.isEmpty():
        scored = scored.unionByName(pairs(fine, others))
    return topk(scored, k, "cosine")


def plain(name: str, vec: str, length: int) -> Column:
    finite = F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above
    return F.coalesce(F.col(name).isNotNull() & (F.size(vec) == length) & finite, F.lit(False))


def pairs(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return rows.crossJoin(queries).select("qid", "doc_id", cosine(F.col("q"), F.col("vec")).alias("score"))


def products(rows: DataFrame, queries: DataFrame, k: int, blocks: int) -> DataFrame:
    """(qid, doc_id, score): of each part of the vectors the best k of every query."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, asked, best = None, [], None
        for batch in batches:
            slots, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(slots) != 0) | (np.diff(kinds) != 0)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(slots)]):
                if x == y:
                    continue
                if slots[x] != slot:
                    if best:
                        yield best.batch()
                    slot, asked, best = slots[x], [], None
                names, part = batch.column(2)[x:y].to_numpy(), batch.column(3)[x:y]
                vectors = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(y - x, -1)
                if kinds[x] == 0:
                    asked.append((names, vectors))
                elif asked:
                    best = best or Best(np.concatenate([n for n, _ in asked]), np.concatenate([v for _, v in asked]), k)
                    for i in range(0, y - x, STEP):
                        best.add(names[i : i + STEP], vectors[i : i + STEP])
        if best:
            yield best.batch()

    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("qid").cast("long").alias("name"), F.col("q").alias("vec"))
    held = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("doc_id").cast("long").alias("name"), "vec")
    both = sent.unionByName(held).select((F.col("part") * blocks + F.col("block")).alias("slot"), "kind", "name", "vec")
    both = both.repartitionById(PARTS * blocks, "slot").sortWithinPartitions("slot", "kind", "name")
    return both.mapInArrow(step, "qid long, doc_id long, score double")


class Best:
    """The best k so far of each query of a block. Vectors come by id, so a tie never displaces one that came before."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.names, self.vectors, self.norms, self.k = names, vectors, np.sqrt((vectors * vectors).sum(axis=1)), k
        self.least = np.full(len(names), -np.inf)
        self.at, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        n = self.norms[:, None] * np.sqrt((vectors * vectors).sum(axis=1))
        found = self.vectors @ vectors.T
        found = np.divide(found, n, out=np.zeros_like(found), where=n != 0)
        rounded = np.round(found, 9)
        new = rounded > self.least[:, None]
        if len(ids) > self.k and new.sum() > 4 * self.k * len(self.names):
            new &= rounded >= np.partition(rounded, -self.k, axis=1)[:, -self.k, None]
        q, r = np.nonzero(new)
        if not len(q):
            return
        at, names, scores = np.concatenate([self.at, q]), np.concatenate([self.ids, ids[r]]), np.concatenate([self.scores, found[q, r]])
        order = np.lexsort((names, -np.round(scores, 9), at))
        at = at[order]
        first = np.searchsorted(at, at)
        place = np.arange(len(at)) - first
        self.at, self.ids, self.scores = at[place < self.k], names[order][place < self.k], scores[order][place < self.k]
        last = order[place == self.k - 1]
        self.least[at[place == self.k - 1]] = np.round(scores[last], 9)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.names[self.at]), pa.array(self.ids), pa.array(self.scores)], names=["qid", "doc_id", "score"])
