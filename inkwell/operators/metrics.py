"""Effectiveness of ranked lists (qid, method, rank, doc_id) against judgments (qid, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("rbp", "dcg", "ndcg", "ap")


def judged(ranked: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
    """ranked up to k with rel, 0 where a document has no judgment. Judgments without a qid hold for every query."""
    ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    on = [c for c in ("qid", "doc_id") if c in qrels.columns]
    rows = ranked.join(qrels.select(*on, "rel"), on, "left")
    return rows.withColumn("rel", F.coalesce("rel", F.lit(0)))


def gain(rel, place):
    return rel / F.log2(place + 1.0)


def per_query(rows: DataFrame, p: float = 0.8, ideal: DataFrame | None = None) -> DataFrame:
    """(qid, method, rbp, dcg, ndcg, ap) of judged rows.

    NDCG's ideal is the retrieved relevances in their best order unless an ideal (qid, rank, rel) is given, and AP
    divides by the relevant documents retrieved; both are 0 where nothing relevant was.
    """
    best = F.row_number().over(Window.partitionBy("qid", "method").orderBy(F.desc("rel"), "rank"))
    upto = F.sum("rel").over(Window.partitionBy("qid", "method").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("best", best).withColumn("upto", upto)
    rel, place = F.col("rel"), F.col("rank")
    out = rows.groupBy("qid", "method").agg(
        ((1 - p) * F.sum(rel * F.pow(F.lit(p), place - 1))).alias("rbp"),
        F.sum(gain(rel, place)).alias("dcg"),
        F.sum(gain(rel, F.col("best"))).alias("idcg"),
        F.coalesce(F.sum(F.col("upto") / place * rel) / F.nullif(F.sum(rel), F.lit(0)), F.lit(0.0)).alias("ap"),
    )
    if ideal is not None:
        out = out.drop("idcg").join(ideal.groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("idcg")), "qid", "left")
    return out.select("qid", "method", "rbp", "dcg", F.coalesce(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"), "ap")


def evaluate(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, methods: list[str], k: int = 1000, p: float = 0.8) -> DataFrame:
    """(method, rbp, dcg, ndcg, map): means over all queries; a query without results counts as 0."""
    found = per_query(judged(ranked, qrels, k), p)
    names = ranked.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    rows = queries.select("qid").distinct().crossJoin(F.broadcast(names))  # method names
    rows = rows.join(found, ["qid", "method"], "left").fillna(0.0)
    return rows.groupBy("method").agg(F.avg("rbp").alias("rbp"), F.avg("dcg").alias("dcg"), F.avg("ndcg").alias("ndcg"), F.avg("ap").alias("map"))


def best_methods(means: DataFrame, methods: list[str]) -> DataFrame:
    """(metric, method, value): the best method of each metric; the first of `methods` where they tie."""
    names = F.array(*[F.lit(m) for m in methods])
    long = means.unpivot(["method"], ["rbp", "dcg", "ndcg", "map"], "metric", "value")
    order = Window.partitionBy("metric").orderBy(F.round("value", 9).desc(), F.array_position(names, F.col("method")))
    return long.withColumn("at", F.row_number().over(order)).where("at = 1").select("metric", "method", "value")
