"""Collections, queries and judgments from files."""

from __future__ import annotations

from itertools import accumulate

from inkwell.functions.text import SPACES, doc_number
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """A directory tree of .txt files -> (doc_id, path, block, docno, text).

    A block is a file's directory. doc_id numbers the paths in order, so it is stable where a walk's order isn't.
    Unreadable and empty files have no row.
    """
    files = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    files = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    files = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("block"), doc_number(F.col("path")).alias("docno"), "text")
    return with_ids(files, "path", "doc_id")


def with_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add dense ids from 0 by the order of a unique key: ranks within ranges plus the sizes of the ranges before.

    Only counts per range go through one task, never the rows.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = df.select(key).where(F.pmod(F.xxhash64(key), F.lit(max(1, parts))) == 0).orderBy(F.xxhash64(key)).limit(64 * parts).orderBy(key).collect() if parts > 1 else []
    bounds = [r[0] for r in sample][:: max(1, len(sample) // parts)]
    cuts = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")
    df = df.withColumn("__part", F.size(F.filter(cuts, lambda b: b <= F.col(key).cast("string"))))
    counts = {r["__part"]: r["count"] for r in df.groupBy("__part").count().collect()}  # a row per range
    before = list(accumulate((counts.get(i, 0) for i in range(len(bounds) + 1)), initial=0))
    base = F.element_at(F.array(*[F.lit(n) for n in before]), F.col("__part") + 1)
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    out = df.withColumn("__rank", rank)
    return out.select((base + F.col("__rank")).cast("long").alias(name), *[c for c in df.columns if c != "__part"])


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines `QID token token ...` -> (qid, query)."""
    parts = F.split(F.trim("value"), SPACES)
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    return lines.select(F.col("p")[0].alias("qid"), F.array_join(F.slice("p", 2, F.size("p")), " ").alias("query"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Lines `QID DOCNO` -> (qid, doc_id, rel); every listed pair is relevant, all others are not."""
    parts = F.split(F.trim("value"), SPACES)
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p")).where(F.size("p") >= 2)
    return lines.select(F.col("p")[0].alias("qid"), F.col("p")[1].cast("long").alias("doc_id"), F.lit(1).alias("rel")).distinct()
