"""Rank fusion over ranked lists (qid, method, rank, doc_id, score)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from inkwell.operators import expand, rank
from inkwell.operators.index import Index
from inkwell.operators.rank import topk
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("tfidf", "bm25", "wand", "lsi", "prf+bm25", "cooc+bm25", "prf+lsi")


def union(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, lists)


def rrf(lists: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Sum of 1 / (60 + rank) over the lists that hold a document."""
    return topk(lists.groupBy("qid", "doc_id").agg(F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("score")), k, "rrf")


def condorcet(lists: DataFrame, k: int = 10, most: int = 500, depth: int = 200) -> DataFrame:
    """Pairwise wins summed over lists: a list gives a document a win over each candidate that it ranks lower or misses.

    Of D candidates a list holds, the r-th has D - r wins, so a row number stands in for the pairs. With over `most`
    candidates those in the top `depth` of some list stay; documents without a win drop out.
    """
    counted = lists.join(lists.groupBy("qid").agg(F.countDistinct("doc_id").alias("d")), "qid")
    kept = counted.where((F.col("d") <= most) | (F.col("rank") <= depth)).select("qid", "doc_id").distinct()
    among = lists.join(kept, ["qid", "doc_id"], "left_semi").join(kept.groupBy("qid").agg(F.count("*").alias("d")), "qid")
    place = F.row_number().over(Window.partitionBy("qid", "method").orderBy("rank"))
    wins = among.withColumn("wins", F.col("d") - place).groupBy("qid", "doc_id").agg(F.sum("wins").cast("double").alias("score"))
    return topk(wins.where("score > 0"), k, "condorcet")


def normalised(lists: DataFrame) -> DataFrame:
    """Scores to [0, 1] per list; a list of equal scores becomes 0."""
    w = Window.partitionBy("qid", "method")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return lists.withColumn("score", F.when(high == low, F.lit(0.0)).otherwise((F.col("score") - low) / (high - low)))


def combsum(lists: DataFrame, k: int = 10) -> DataFrame:
    return topk(normalised(lists).groupBy("qid", "doc_id").agg(F.sum("score").alias("score")), k, "combsum")


def combmnz(lists: DataFrame, k: int = 10) -> DataFrame:
    """CombSUM times the number of lists that hold a document."""
    return topk(normalised(lists).groupBy("qid", "doc_id").agg((F.sum("score") * F.count("*")).alias("score")), k, "combmnz")


STRATEGIES = {"rrf": rrf, "condorcet": condorcet, "combsum": combsum, "combmnz": combmnz}


def overlap(lists: DataFrame, methods: list[str], queries: DataFrame) -> DataFrame:
    """(qid, m1, m2, jaccard) of the lists' documents for each pair of methods; two empty lists count as 1."""
    spark = queries.sparkSession
    pairs = spark.createDataFrame(list(combinations(methods, 2)), "m1 string, m2 string")
    sizes = lists.groupBy("qid", "method").agg(F.countDistinct("doc_id").alias("n"))
    a, b = lists.select("qid", F.col("method").alias("m1"), "doc_id").distinct(), lists.select("qid", F.col("method").alias("m2"), "doc_id").distinct()
    both = a.join(b, ["qid", "doc_id"]).groupBy("qid", "m1", "m2").agg(F.count("*").alias("both"))
    rows = queries.select("qid").distinct().crossJoin(F.broadcast(pairs))  # pairs of method names
    for m, n in (("m1", "n1"), ("m2", "n2")):
        rows = rows.join(sizes.select("qid", F.col("method").alias(m), F.col("n").alias(n)), ["qid", m], "left")
    rows = rows.join(both, ["qid", "m1", "m2"], "left").fillna(0, ["n1", "n2", "both"])
    all_ = F.col("n1") + F.col("n2") - F.col("both")
    return rows.select("qid", "m1", "m2", F.when(all_ == 0, F.lit(1.0)).otherwise(F.col("both") / all_).alias("jaccard"))


def single(index: Index, queries: DataFrame, method: str, k: int, lsi=None) -> DataFrame | None:
    """One retriever's list; none for a method that needs an LSI model where there isn't one."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method.endswith("lsi") and lsi is None:
        return None
    found = rank.wand(index, queries, k) if method == "wand" else expand.run(index, queries, method, k, lsi)
    return found.withColumn("method", F.lit(method))


def lists_of(index: Index, queries: DataFrame, methods: list[str], k: int, lsi=None) -> DataFrame:
    return union([x for x in (single(index, queries, m, k, lsi) for m in methods) if x is not None])


def fuse(index: Index, queries: DataFrame, k: int = 10, methods: list[str] | None = None, strategy: str = "rrf", lsi=None) -> DataFrame:
    """Fused ranking of lists of depth max(3k, 100)."""
    methods = methods or (["bm25", "lsi", "prf+bm25"] if lsi is not None else ["tfidf", "bm25", "wand"])
    return STRATEGIES[strategy](lists_of(index, queries, methods, max(3 * k, 100), lsi), k)


def compare(index: Index, queries: DataFrame, k: int = 10, methods: list[str] | None = None, lsi=None) -> DataFrame:
    """Every method's list and the RRF, CombMNZ and Condorcet rankings of them."""
    methods = methods or ["bm25", "wand", *(["lsi"] if lsi is not None else [])]
    lists = lists_of(index, queries, methods, max(3 * k, 100), lsi)
    return union([lists.where(F.col("rank") <= k), *(STRATEGIES[s](lists, k) for s in ("rrf", "combmnz", "condorcet"))])
