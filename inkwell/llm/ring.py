"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.shared import cut

#: Virtual nodes of a shard; hash buckets that order the rows of a cell; size classes are powers of two.
NODES, BUCKETS = 24, 1024


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes in clockwise (ascending) order, and the shard of each."""
    at = sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}") - (1 << 63), s) for s in range(shards) for v in range(nodes))
    return np.array([p for p, _ in at], np.int64), np.array([s for _, s in at])


def walk(owners: np.ndarray, shards: int) -> np.ndarray:
    """For each arc the shards in the order in which a key meets them clockwise, each once."""
    out = []
    for a in range(len(owners)):
        seen = dict.fromkeys(int(s) for s in np.roll(owners, -a))
        out.append(list(seen) + [s for s in range(shards) if s not in seen])
    return np.array(out)


def place(cells: list[tuple[int, int, int]], order: np.ndarray, route: np.ndarray, room: float) -> list[tuple[int, int, int, int]]:
    """Cells (arc, rows, bytes) to segments (cell, first row, rows, shard), a cell's in the order of its rows.

    Cells ask in the order given, each the shards of its route clockwise; a shard takes as many of the cell's rows as
    still fit by their mean size, and those that overflow go on to the next. What fits nowhere, less than a row for a
    shard, goes to the shard with the lowest load.
    """
    shards = route.shape[1]
    load, out = [0.0] * shards, []
    for c in order.tolist():
        arc, n, size = cells[c]
        mean, first = size / n, 0
        for s in route[arc].tolist():
            take = min(n - first, int((room - load[s]) / mean))
            if take > 0:
                out.append((c, first, take, s))
                load[s] += take * mean
                first += take
            if first == n:
                break
        while first < n:
            s = min(range(shards), key=load.__getitem__)
            out.append((c, first, 1, s))
            load[s] += mean
            first += 1
    return out


def shard_documents(docs: DataFrame, shards: int = 8, nodes: int = NODES, slack: float = 0.0005) -> DataFrame:
    """Put docs (doc_id, text) into shards of near equal bytes (law `bytes`).

    A document's key is its text, so copies start at one place on the ring; a shard holds (1 + slack) times the mean,
    and keys that find it full go on clockwise. How many rows of a cell (arc, size class) that are is decided on the
    driver, which sees sums only; which ones, by their number in the cell, in the order of a hash of doc_id and text.
    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (gapless from 0 in a shard) and grown_shard
    (null under this law). Null text: no bytes, crc32 of nothing. A row per input row; rows that repeat doc_id and text
    are numbered as they are stored, so they too spread over shards; an empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    places, owners = ring(shards, nodes)
    text = F.coalesce(F.col("text"), F.lit(""))
    cuts = F.array(*[F.lit(int(p)) for p in places])
    # the hash is bound to a name, so that it is computed once and not for every virtual node
    before = F.transform(F.array(F.xxhash64(text)), lambda h: F.size(F.filter(cuts, lambda p: p < h)))[0]
    arc = F.pmod(before, F.lit(len(places)))
    size = (F.octet_length(text) + 1).cast("long")
    doc_id = F.col("doc_id").cast("long")
    bucket = F.pmod(F.xxhash64(doc_id, text, F.lit(3)), F.lit(BUCKETS)).cast("int")
    rows = docs.select(doc_id.alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), arc.cast("int").alias("arc"), F.floor(F.log2(size)).cast("int").alias("kind"), bucket.alias("bucket"), F.monotonically_increasing_id().alias("id"))
    # stored, the numbers stay; their upper bits tell the task that wrote the row
    rows = cut(rows, "ring").withColumn("task", F.shiftright("id", 33))
    sums = rows.groupBy("arc", "kind").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toArrow().sort_by([("arc", "ascending"), ("kind", "ascending")])
    a, k, b, n = (sums.column(x).to_numpy() for x in ("arc", "kind", "bytes", "n"))
    cells = list(zip(a.tolist(), n.tolist(), b.tolist(), strict=True))
    plan, filled = [], [0] * shards
    for c, first, take, s in place(cells, np.lexsort((a, -k)), walk(owners, shards), b.sum() / shards * (1 + slack)):
        plan.append((int(a[c]), int(k[c]), first, first + take, s, filled[s] - first))
        filled[s] += take
    plan = spark.createDataFrame(plan, "arc int, kind int, lo long, hi long, shard int, shift long")
    # a row's number in its cell: sums of buckets, of which there are few, of a bucket's tasks, and a window in a task
    cell, part = ["arc", "kind"], ["arc", "kind", "bucket"]
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = rows.groupBy(*part, "task").agg(F.count("*").alias("n"))
    buckets = tasks.groupBy(*part).agg(F.sum("n").alias("n")).select(*part, ahead(Window.partitionBy(*cell).orderBy("bucket")).alias("low"))
    tasks = tasks.select(*part, "task", ahead(Window.partitionBy(*part).orderBy("task")).alias("inside")).join(buckets, part)
    within = F.row_number().over(Window.partitionBy(*part, "task").orderBy("id")) - 1
    rows = rows.withColumn("within", within).join(tasks, [*part, "task"]).withColumn("nth", F.col("low") + F.col("inside") + F.col("within"))
    # the plan has a row per cell, of which there are nodes * shards * 41 size classes at most, and as many cuts again
    out = rows.join(F.broadcast(plan), cell).where((F.col("lo") <= F.col("nth")) & (F.col("nth") < F.col("hi")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
