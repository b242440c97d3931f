"""SimHash near-duplicate classes found with BK-trees.

A BK-tree over all fingerprints of a large corpus neither fits one machine nor has a size that would allow a broadcast.
So fingerprints are dealt into buckets such that any two within the radius meet in one, a bucket is cut into shards of
at most ``SHARD`` distinct fingerprints, a BK-tree is built per shard where it is needed, and every pair of shards of a
bucket meets in one task, where the one's fingerprints follow the other's edges. No pair of documents is ever emitted:
a task returns the links of a spanning forest, and connected components join those over buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.shared import connected_components, cut

#: Distinct fingerprints in a shard tree at most (as the mean of a hash split).
SHARD = 4096


class BKTree:
    """Fingerprints as rows of 64-bit words; children are keyed by their integer Hamming distance to the parent.

    Row 0 is the root; of the rows that meet at a node at one distance the first is its child and the others go on from
    there. Rows equal to a node are kept with it. `followed` and `skipped` count the edges of searches so far.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.keys = words, 64 * words.shape[1] + 1
        codes, children, twins = [], [], []
        rows, node = np.arange(1, len(words)), np.zeros(max(0, len(words) - 1), np.int64)
        while len(rows):
            far = distances(words[rows], words[node])
            same = far == 0
            twins.append(np.stack((node[same], rows[same])))
            rows, node, far = rows[~same], node[~same], far[~same]
            code, first, group = np.unique(node * self.keys + far, return_index=True, return_inverse=True)
            codes.append(code)
            children.append(rows[first])
            node = rows[first][group]
            rows, node = rows[rows != node], node[rows != node]
        code = np.concatenate([*codes, np.zeros(0, np.int64)])
        order = np.argsort(code)
        self.code, self.child = code[order], np.concatenate([*children, np.zeros(0, np.int64)])[order]
        twin = np.concatenate([*twins, np.zeros((2, 0), np.int64)], axis=1)
        self.twin_of, self.twin = twin[:, np.argsort(twin[0], kind="stable")]
        self.followed = self.skipped = 0

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) within the radius. From a node at distance d only edges keyed d - radius to d + radius are followed."""
        found = []
        for at in range(0, len(queries), 256):
            query = np.arange(at, min(at + 256, len(queries)))
            node = np.zeros(len(query), np.int64) if len(self.words) else np.zeros(0, np.int64)
            query = query[: len(node)]
            while len(query):
                far = distances(queries[query], self.words[node])
                hit = far <= radius
                found.append((query[hit], node[hit]))
                all_ = node * self.keys
                low = np.searchsorted(self.code, all_ + np.maximum(far - radius, 0))
                n = np.searchsorted(self.code, all_ + np.minimum(far + radius, self.keys - 1), "right") - low
                end = np.cumsum(n)
                self.followed += int(n.sum())
                self.skipped += int((np.searchsorted(self.code, all_ + self.keys - 1, "right") - np.searchsorted(self.code, all_)).sum() - n.sum())
                query, node = np.repeat(query, n), self.child[np.repeat(low - (end - n), n) + np.arange(int(n.sum()))]
        query, node = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        low = np.searchsorted(self.twin_of, node)
        n = np.searchsorted(self.twin_of, node, "right") - low
        end = np.cumsum(n)
        twin = self.twin[np.repeat(low - (end - n), n) + np.arange(int(n.sum()))]
        return np.concatenate((query, np.repeat(query, n))), np.concatenate((node, twin))


def distances(words: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ query).sum(axis=1, dtype=np.int64)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words of A-Z-lower-cased text; fewer words: of the whole sequence."""
    words = (text or b"").lower().split()  # bytes split at exactly space and \x09-\x0d
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    runs = zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number with the bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


MIX = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def remix(hashes: np.ndarray, j: int) -> np.ndarray:
    """The j-th of a family of 64-bit hashes of hashes."""
    x = (hashes ^ MIX[j]) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * MIX[j + 1]
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, keys: int = 0, hashed: bool = False) -> DataFrame:
    """(doc_id, fp array<long>, keys array<long>, with hashed th, a hash of the text): SimHash over `64 * words` bits of the text's shingles.

    With keys, that many minima of independent hashes of the shingle set go along, for blocking; the shingles then
    count once each. Null and empty texts have no shingle: fingerprint zero and keys zero.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, mins = [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), width)
                if keys:
                    h = np.unique(h)
                fps.append([majority(h if not j else remix(h, 40 + j)) for j in range(words)])
                mins.append([int(remix(h, j).min()) if len(h) else 0 for j in range(keys)])
            n = len(fps)
            fp = pa.array(signed(np.array(fps, np.uint64).reshape(-1)), pa.int64())
            key = pa.array(signed(np.array(mins, np.uint64).reshape(-1)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * words, pa.int32()), fp), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * keys, pa.int32()), key)],
                names=[*["th"] * hashed, "doc_id", "fp", "keys"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if hashed:
        narrow = narrow.withColumn("th", F.xxhash64("text"))
    return narrow.mapInArrow(step, "th long, " * hashed + "doc_id long, fp array<long>, keys array<long>")


def similar_texts(texts: pa.ChunkedArray, width: int, similarity: float):
    """Whether two rows' sets of shingles have that Jaccard similarity; sets are made when first asked for."""
    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.unique(shingle_hashes(texts[i].as_py(), width))
        return sets[i]

    def alike(i: int, j: int) -> bool:
        a, b = shingles(i), shingles(j)
        n, few = len(a) + len(b), min(len(a), len(b))
        if few < similarity * (n - few) - 1e-9:
            return False
        both = np.sort(np.concatenate((a, b)), kind="stable")
        same = int(np.count_nonzero(both[1:] == both[:-1]))
        return same >= similarity * (n - same) - 1e-9

    return alike


def forest(words: np.ndarray, first: np.ndarray, second: np.ndarray, radius: int, alike: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is within the radius between two shards (row masks, maybe the same) of words.

    The first shard is a tree, which the second's rows search. With alike, a pair within the radius links only if that
    holds too; each is asked, the nearest first, until two labels are one.
    """
    label = np.arange(len(words))
    members: dict[int, list[int]] = {}
    rows, queries = np.flatnonzero(first), np.flatnonzero(second)
    tree, links = BKTree(words[rows]), []

    def join(q: int, near: int) -> None:
        links.append((q, near))
        mine, other = int(label[q]), int(label[near])
        a, b = members.pop(other, [other]), members.pop(mine, [mine])
        if len(a) < len(b):
            a, b, other = b, a, mine
        label[b] = other
        members[other] = a + b

    for at in range(0, len(queries), 256):
        some = queries[at : at + 256]
        who, found = tree.within(words[some], radius)
        q, near = some[who], rows[found]
        both = first[q] & second[near]  # of a pair that meets twice one meeting is enough
        keep = ((near < q) | ~both) & (label[q] != label[near])
        q, near = q[keep], near[keep]
        if alike is None:  # one pair of each two labels
            _, one = np.unique(label[q] * len(words) + label[near], return_index=True)
            q, near = q[one], near[one]
        else:
            order = np.lexsort((distances(words[near], words[q]), q))
            q, near = q[order], near[order]
        for i, j in zip(q.tolist(), near.tolist(), strict=True):
            if label[i] != label[j] and (alike is None or alike(i, j)):
                join(i, j)
    return links


def bucket_links(radius: int, words: int, width: int = 0, similarity: float = 0.0):
    """Over rows (bucket, part, left, right, side, fp) sorted by the first four: links (a, b) of each bucket's shard pair.

    With a similarity, rows have th and text too, linked texts' sets of `width`-word shingles have that similarity, and
    links are between their th; else between fingerprints.
    """

    def links_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n = table.num_rows
        keys = [table.column(c).to_numpy() for c in ("bucket", "part", "left", "right")]
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.append(np.flatnonzero(new), n)
        fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, words)
        name = table.column("th").to_numpy().view(np.uint64)[:, None] if similarity else fp
        side = table.column("side").to_numpy()
        found = []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s < 2:
                continue
            w = fp[s:e]
            asked = similar_texts(table.column("text").slice(s, e - s), width, similarity) if similarity else None
            if e - s == 2:  # a tree of one edge
                pairs = [(0, 1)] if distances(w[:1], w[1])[0] <= radius and (asked is None or asked(0, 1)) else []
            else:
                m = side[s:e]
                pairs = forest(w, m <= 1, m != 1, radius, asked)
            found += [(s + i, s + j) for i, j in pairs]
        at = np.array(found, np.int64).reshape(-1, 2)
        return name[at[:, 0]], name[at[:, 1]]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            cols = []
            for x in links_of(table):
                flat = pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64), pa.int64())
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat))
            return pa.RecordBatch.from_arrays(cols, names=["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(c).to_numpy() for c in ("bucket", "part", "left", "right")]
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            cutoff = int(np.argmax(last))  # the last run may go on in the next batch
            if cutoff:
                yield out(held.slice(0, cutoff))
                held = held.slice(cutoff).combine_chunks()
        if held is not None:
            yield out(held)

    return step


def link_buckets(buckets: DataFrame, radius: int, words: int, shard: int | None = None, texts: DataFrame | None = None, width: int = 0, similarity: float = 0.0) -> DataFrame:
    """(bucket, part, fp) with distinct rows -> links (a, b). Buckets over `shard` rows are cut; all shard pairs meet.

    With texts (th, text) and buckets that have a th, links are between th, of texts of that similarity.
    """
    shard = shard or SHARD
    counts = buckets.groupBy("bucket", "part").agg(F.count("*").alias("n")).where("n > 1")
    met = buckets.join(counts, ["bucket", "part"])
    shards = F.ceil(F.col("n") / shard).cast("int")
    more = [] if texts is None else ["th"]
    mine = F.when(F.col("n") > shard, F.pmod(F.xxhash64(*(more or ["fp"]), F.lit(7)), shards).cast("int")).otherwise(F.lit(0))
    met = met.select("bucket", "part", "fp", *more, mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.greatest(shards, F.lit(1)) - 1)).alias("other"))
    # side 0: a tree over the rows and queries among them; 1: in the tree; 2: a query
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    met = met.select("bucket", "part", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), side.cast("int").alias("side"), "fp", *more)
    if texts is not None:
        met = cut(met, "met")
        asked = texts.join(met.select("th").distinct().hint("merge"), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
        met = met.join(asked.hint("merge"), "th")  # at every size alike
    # a number of its own: adaptive execution would put these few bytes, dear to search, into a few tasks
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, "bucket", "part", "left", "right").sortWithinPartitions("bucket", "part", "left", "right", "fp")
    return met.mapInArrow(bucket_links(radius, words, width, similarity), "a array<long>, b array<long>")


def bits(x: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND((1 << (high - low)) - 1)


def near_fingerprints(fps: DataFrame, radius: int) -> DataFrame:
    """fps: distinct (fp array of one long). Links between fingerprints at most `radius` bits apart, all of them joined.

    The 64 bits are cut into radius + 1 blocks; two fingerprints within the radius agree on one at least, so they meet
    in its bucket. Of a block so many bits count that a bucket holds a shard tree's fingerprints or less; a table of no
    more is one bucket. A bucket that holds over SHARD all the same is dealt anew by the blocks of its other bits.
    """
    blocks, x = radius + 1, F.col("fp")[0]
    edges = [64 * i // blocks for i in range(blocks + 1)]
    wide = min(64 // blocks, max(0, (fps.count() - 1) // SHARD).bit_length())
    parts = range(blocks if wide else 1)
    entry = [F.struct(F.lit(k).alias("part"), bits(x, edges[k + 1] - wide, edges[k + 1]).alias("bucket")) for k in parts]
    dealt = fps.select("fp", F.explode(F.array(*entry)).alias("e")).select(F.col("e.bucket").alias("bucket"), F.col("e.part").alias("part"), "fp")
    counts = dealt.groupBy("bucket", "part").agg(F.count("*").alias("n")).where("n > 1")
    met = dealt.join(counts, ["bucket", "part"])
    whole = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("v")))
    more = F.when(F.col("n") <= SHARD, whole)
    for k in parts if wide else ():
        rest = [(edges[b], edges[b + 1]) for b in range(blocks) if b != k] + [(edges[k], edges[k + 1] - wide)]
        cells = cells_of(rest, blocks)
        fine = [F.struct(F.lit(s + 1).alias("sub"), F.xxhash64(*[bits(x, lo, hi) for lo, hi in cell]).alias("v")) for s, cell in enumerate(cells)]
        more = more.when(F.col("part") == k, F.array(*fine))
    met = met.select("bucket", "part", "fp", F.explode(more.otherwise(whole)).alias("e"))
    met = met.select(F.when(F.col("e.sub") == 0, F.col("bucket")).otherwise(F.xxhash64("bucket", "e.v")).alias("bucket"), (F.col("part") * 64 + F.col("e.sub")).cast("int").alias("part"), "fp")
    return link_buckets(met, radius, 1)


def cells_of(ranges: list[tuple[int, int]], cells: int) -> list[list[tuple[int, int]]]:
    """Ranges of bits as so many cells of about as many bits, each a list of ranges."""
    places = [b for lo, hi in ranges for b in range(lo, hi)]
    out = []
    for k in range(cells):
        mine = places[len(places) * k // cells : len(places) * (k + 1) // cells]
        cell = []
        for b in mine:
            if cell and cell[-1][1] == b:
                cell[-1] = (cell[-1][0], b + 1)
            else:
                cell.append((b, b + 1))
        out.append(cell)
    return out


def classes(docs: DataFrame, links: DataFrame, name: str = "fp") -> DataFrame:
    """(doc_id, name), links between names -> (name, component_id): the least doc_id of all documents reachable."""
    least = docs.groupBy(name).agg(F.min("doc_id").alias("low"))
    roots = connected_components(links)
    named = least.join(roots.withColumnRenamed("node", name), name, "left").select(name, "low", F.coalesce("root", name).alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(lowest, "root").select(name, "component_id")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints of `width`-word shingles, linked at `radius` or fewer bits.

    A row per input row, repeated doc_ids included. Null and empty texts have fingerprint zero and link like any
    other. component_id is the least doc_id reachable (null ids are passed over; null if a class has no other).
    Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    fp = cut(fingerprints(docs, width).select("doc_id", "fp"), "fp")
    links = cut(near_fingerprints(cut(fp.select("fp").distinct(), "distinct"), radius), "links")
    named = classes(fp, links)
    return fp.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, words: int = 4, keys: int = 6, similarity: float = 0.8, slack: float = 0.335) -> DataFrame:
    """(doc_id, component_id): classes of documents linked where their sets of `width`-word shingles are similar.

    A link's similarity is counted on the sets themselves; SimHashes only choose what is counted. By them, a Jaccard
    similarity J is a cosine of 2J/(1+J) between shingle sets, and two SimHashes differ in angle/pi of their bits. The
    estimate's standard error is 0.035 at 256 bits, and sets of four and five shingles differ more than the angle says;
    all from an estimated similarity - slack on is counted, 71 bits. Blocks are minima of `keys` independent hashes of
    the shingle set: documents at 0.8 miss every shared block with a chance of 0.2 ** keys.
    Texts are told apart by a 64-bit hash; equal ones are one. Null and empty texts have no shingle and are alike. Other
    nulls, ties, repeated rows and extra columns: as in simhash_components.
    """
    j = similarity - slack
    radius = int(64 * words * np.arccos(2 * j / (1 + j)) / np.pi)
    fp = cut(fingerprints(docs, width, words, keys, hashed=True), "fp")
    each = fp.dropDuplicates(["th"])
    dealt = each.select("fp", "th", F.posexplode("keys").alias("part", "bucket"))
    texts = docs.select(F.xxhash64(F.col("text").cast("binary")).alias("th"), F.col("text").cast("binary").alias("text"))
    links = link_buckets(dealt, radius, words, texts=texts, width=width, similarity=similarity)
    links = cut(links.select(F.col("a")[0].alias("a"), F.col("b")[0].alias("b")), "links")
    return fp.join(classes(fp, links, "th"), "th").select("doc_id", "component_id")
