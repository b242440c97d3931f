"""Bottom-k sketches of shingle hashes: resemblance, containment and distinct counts. DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes kept, and the bits of each: ten hexadecimal digits.
K, BITS = 128, 40
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a range of neighbours, as the mean; ranges at most, and keys that are drawn for each: 64 MB in all.
ROWS, RANGES, DRAWN = 500, 1 << 19, 8


def word_hashes(text: Column) -> Column:
    """XXH64 of each word; a null or blank text has none."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, SPACE), lambda w: F.xxhash64(w)))


def with_sketch(df: DataFrame, text: str, name: str, width: int = 5, k: int = K) -> DataFrame:
    """Add `name`: the k least distinct 40-bit hashes of `text`'s shingles of `width` words, ascending.

    Fewer words than width: the whole sequence is the one shingle. No word: an empty sketch.
    """
    names, words = df.columns, f"__{name}_words"
    df = df.withColumn(words, word_hashes(F.col(text)))
    h = F.col(words)
    df, runs = hash_runs(df, words, width, f"__{name}_runs")
    short = lambda x: F.shiftrightunsigned(x, 64 - BITS)
    whole = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(short(F.xxhash64(h))))
    hashes = F.when(F.size(h) < width, whole).otherwise(F.transform(F.col(runs), short))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).select(*names, name)


def hash_runs(df: DataFrame, words: str, width: int, name: str) -> tuple[DataFrame, str]:
    """Add a column of the hashes of each run of `width` words, out of those of its halves; returns its name too.

    Arrays are paired, never indexed inside a function of their elements: an optimizer may move such a function to
    where its array is computed anew for every element.
    """
    if width == 1:
        return df, words
    left = 1 << (width - 1).bit_length() - 1
    df, a = hash_runs(df, words, left, f"{name}{left}")
    df, b = (df, a) if left * 2 == width else hash_runs(df, words, width - left, f"{name}{width - left}")
    n = F.greatest(F.size(words) - (width - 1), F.lit(0))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, left + 1, n), lambda x, y: F.xxhash64(x, y))
    return df.withColumn(name, pairs), name


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the shared part of the k least hashes of both together. Two empty sketches: 1."""
    both = merge(a, b, k)
    edge = F.element_at(both, -1)
    shared = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= edge))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k, else (k - 1) over the k-th hash as a fraction of the range."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's count over a's."""
    found = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / F.greatest(distinct_count(a, k), F.lit(1.0))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), found))


def digest(a: Column) -> Column:
    """The sketch as text, ten hexadecimal digits a hash; from_digest() is the inverse."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")


def from_digest(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"([0-9a-f]{{{BITS // 4}}})"), 1), lambda x: F.conv(x, 16, 10).cast("long"))


def constant(rows: list, schema: str) -> Column:
    """A literal of nested rows; as one text it makes a short plan, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) dealt into ranges of (doc_id, hash of text); returns them with rows that only mark the next range's first.

    One shuffle: range bounds are quantiles of a sample of the rows' keys, so a row at a bound goes into the range
    before as well, as its last row, and the first row of all also ends the last range. A range is found in two steps,
    among every so manieth bound and among those from there on.
    """
    pair = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("t"))
    docs = docs.withColumn("__key", pair)
    seen = docs.agg(F.count("*").alias("n"), F.min("__key").alias("low")).first()
    n, low = seen["n"], tuple(seen["low"] or (0, 0))
    parts = max(1, min(RANGES, n // ROWS))
    share = F.shiftrightunsigned(F.xxhash64("__key", F.lit(9)), 11) / float(1 << 53)
    drawn = docs.where(share < min(1.0, DRAWN * parts / max(1, n))).select("__key.k", "__key.t").toArrow() if parts > 1 else None
    keys = sorted(zip(drawn.column(0).to_pylist(), drawn.column(1).to_pylist(), strict=True)) if parts > 1 else []
    bounds = sorted({keys[len(keys) * i // parts] for i in range(1, parts)} - {low}) if keys else []
    step = max(1, int(len(bounds) ** 0.5))
    rows = [{"k": k, "t": t} for k, t in bounds]
    coarse = constant(rows[::step], "array<struct<k:bigint,t:bigint>>")
    fine = constant([rows[i : i + step] for i in range(0, len(rows), step)], "array<array<struct<k:bigint,t:bigint>>>")
    upto = lambda some: F.size(F.filter(some, lambda b: b <= F.col("__key")))
    docs = docs.withColumn("__block", upto(coarse)).withColumn("__bounds", F.get(fine, F.col("__block") - 1))
    docs = docs.withColumn("__own", F.when(F.col("__block") == 0, 0).otherwise((F.col("__block") - 1) * step + upto(F.col("__bounds"))))
    entry = lambda part, mark: F.struct(part.cast("int").alias("part"), F.lit(mark).alias("mark"))
    places = (
        F.when((F.col("__key.k") == low[0]) & (F.col("__key.t") == low[1]), F.array(entry(F.col("__own"), 0), entry(F.lit(len(bounds)), 1)))
        .when(F.array_contains("__bounds", F.col("__key")), F.array(entry(F.col("__own"), 0), entry(F.col("__own") - 1, 1)))
        .otherwise(F.array(entry(F.col("__own"), 0)))
    )
    docs = docs.select("doc_id", "text", "__key", F.explode(places).alias("__at"))
    docs = docs.select("doc_id", "text", F.col("__at.part").alias("__part"), F.col("__at.mark").alias("__mark"), F.col("__key.k").alias("__key"), F.col("__key.t").alias("__tie"))
    return docs, Window.partitionBy("__part").orderBy("__mark", "__key", "__tie")


def fingerprint_documents(docs: DataFrame, width: int = 5, k: int = K) -> DataFrame:
    """Sketches of every text and of its edited text (its last quarter replaced by the start of the next document).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the estimates
    n_shingles and held_by_next (containment in the next text). A row per input row. Null text: empty. Ties of doc_id
    go by a hash of the text; null ids come first. One row alone is its own next. Empty sketches: fingerprint '',
    likeness 1 to an empty one and 0 to any other. Only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs, order = with_next(docs)
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("__next"), F.lit(1), part))
    docs = docs.withColumn("__next", F.lead("text").over(order))
    docs = docs.withColumn("edited", F.when(F.col("__mark") == 0, edited))
    docs = with_sketch(with_sketch(docs, "text", "sketch", width, k), "edited", "edited_sketch", width, k)
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch", "__part", "__mark", "__key", "__tie")
    docs = docs.withColumn("next_sketch", F.lead("sketch").over(order)).where("__mark = 0")
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return docs.select("doc_id", "n_chars", "edited_sha256", digest(a).alias("fingerprint"), digest(b).alias("edited_fingerprint"), resemblance(a, b, k).alias("near_edited"), resemblance(a, c, k).alias("near_next"), distinct_count(a, k).alias("n_shingles"), containment(a, c, k).alias("held_by_next"))
