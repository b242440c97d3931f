"""Tokens and query terms: whitespace-separated, case and punctuation kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space and the four separators \x1c-\x1f.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """The tokens of a text, in order; none of a null or blank one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term): a row per occurrence."""
    return docs.select(F.col(doc).alias("doc_id"), F.explode(F.split(F.col(text), SPACES)).alias("term")).where("term <> ''")


def query_tokens(queries: DataFrame) -> DataFrame:
    """queries (qid, query) -> (qid, pos, term), duplicates kept."""
    return queries.select("qid", F.posexplode(words(F.col("query"))).alias("pos", "term"))


def query_terms(queries: DataFrame) -> DataFrame:
    """queries -> (qid, term, qtf, first_pos), a row per different term."""
    return query_tokens(queries).groupBy("qid", "term").agg(F.count("*").cast("int").alias("qtf"), F.min("pos").alias("first_pos"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    shorter = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(shorter == 0, 0).otherwise(F.coalesce(F.array_max(at), F.lit(0)))


def doc_number(path: Column) -> Column:
    """The file name without .txt, from a path."""
    return F.regexp_extract(path, r"/([^/]+)\.txt$", 1)
