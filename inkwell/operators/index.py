"""The inverted index as tables, built by one shuffle and merged by union and sum."""

from __future__ import annotations

from dataclasses import dataclass

from inkwell.functions.text import tokens, words
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def postings_of(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf). Map-side partial counts stand in for an in-memory invert with spills."""
    return tokens(docs).groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))


def merge_postings(*parts: DataFrame) -> DataFrame:
    """Postings of several indexes as one; the tf of a pair that occurs in many is their sum."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))


def doc_lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id").agg(F.sum("tf").cast("long").alias("dl"))


def text_lengths(docs: DataFrame) -> DataFrame:
    """Document lengths from texts: no postings are shuffled for them. Documents without a token have none."""
    rows = docs.select("doc_id", F.size(words(F.col("text"))).alias("n")).where("n > 0")
    return rows.groupBy("doc_id").agg(F.sum("n").cast("long").alias("dl"))


def term_stats(postings: DataFrame) -> DataFrame:
    stats = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"), F.max("tf").alias("max_tf"))
    return stats.withColumn("term_len", F.length("term"))


def collection_stats(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: n, v, tokens, postings, avgdl, min_dl."""
    t = terms.agg(F.count("*").alias("v"), F.coalesce(F.sum("cf"), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("postings"))
    d = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.min("dl").alias("min_dl"))
    return d.crossJoin(t).select("n", "v", "tokens", "postings", "avgdl", "min_dl")


def packed(postings: DataFrame, chunk: int | None = None) -> DataFrame:
    """(term, list of (doc_id, tf) by doc_id). With chunk, a list holds doc_ids of one range of that many, so that a
    term of very many documents is spread over rows (term, part)."""
    part = F.floor(F.col("doc_id") / chunk).cast("long") if chunk else F.lit(0).cast("long")
    rows = postings.groupBy("term", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("list"))
    return rows if chunk else rows.drop("part")


@dataclass
class Index:
    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame

    @classmethod
    def of(cls, postings: DataFrame, docs: DataFrame | None = None) -> Index:
        docs, terms = doc_lengths(postings) if docs is None else docs, term_stats(postings)
        return cls(postings, docs, terms, collection_stats(terms, docs))

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, method: str = "bsbi") -> Index:
        """Index docs (doc_id, text); stored at path if given. Both methods give the same index."""
        if method not in ("bsbi", "spimi"):
            raise ValueError(f"unknown index method {method}")
        postings = postings_of(docs)
        return cls.of(postings, text_lengths(docs)) if path is None else cls.store(postings, path, text_lengths(docs))

    @classmethod
    def store(cls, postings: DataFrame, path: str, docs: DataFrame | None = None) -> Index:
        """Write postings in ranges of (term, doc_id), so a frequent term is several files' work, then their statistics."""
        spark = postings.sparkSession
        postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        postings = spark.read.parquet(f"{path}/postings")
        (doc_lengths(postings) if docs is None else docs).write.mode("overwrite").parquet(f"{path}/docs")
        # parts are ranges by term already, so its statistics are sorted by a small shuffle
        term_stats(postings).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        docs, terms = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/terms")
        collection_stats(terms, docs).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "docs", "terms", "stats")))

    def save(self, path: str) -> Index:
        return self.store(self.postings, path)

    def merge(self, other: Index, path: str | None = None) -> Index:
        postings = merge_postings(self.postings, other.postings)
        return self.of(postings) if path is None else self.store(postings, path)

    def lookup(self, term: str) -> DataFrame:
        """The postings of a term; the filter reaches the Parquet scan, which is sorted by term."""
        return self.postings.where(F.col("term") == term)

    def prefix(self, prefix: str, limit: int | None = None, lower: bool = False) -> DataFrame:
        """Terms that start with the prefix in code-point order; '' gives all."""
        found = self.terms.where(F.col("term").startswith(prefix.lower() if lower else prefix)).orderBy("term")
        return found.limit(limit) if limit is not None else found

    def term_ids(self) -> DataFrame:
        """(term_id, term) with dense ids from 0 in order of terms."""
        from inkwell.sources.readers import with_ids

        return with_ids(self.terms.select("term"), "term", "term_id")
