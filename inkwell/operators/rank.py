"""Ranked retrieval for a batch of queries (qid, query): TF-IDF, BM25 and its top-k by upper bounds."""

from __future__ import annotations

from inkwell.functions.text import query_terms
from inkwell.functions.weights import idf, log_tf, robertson, saturation
from inkwell.operators.index import Index
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: So many query terms are sent to the scan as a filter.
PUSHED = 500


def topk(scored: DataFrame, k: int, method: str) -> DataFrame:
    """(qid, doc_id, score) -> (qid, method, rank, doc_id, score): score descending, doc_id ascending, k a query.

    Scores are compared to nine digits, so the order of a sum doesn't decide a tie. Spark keeps k rows a query on the
    map side before the window's shuffle.
    """
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", F.lit(method).alias("method"), "rank", "doc_id", "score")


def matched(index: Index, queries: DataFrame, once: bool = False) -> DataFrame:
    """Postings of the queries' terms with qtf (1 if once), df, max_tf and the collection's n, avgdl, min_dl."""
    terms = query_terms(queries)
    if once:
        terms = terms.withColumn("qtf", F.lit(1))
    few = [r["term"] for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
    postings, known = index.postings, index.terms
    if len(few) <= PUSHED:
        postings, known = postings.where(F.col("term").isin(few)), known.where(F.col("term").isin(few))
    terms = terms.join(known.select("term", "df", "max_tf"), "term").crossJoin(F.broadcast(index.stats.select("n", "avgdl", "min_dl")))  # one row
    return postings.join(terms, "term")


def tfidf(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Sum over query occurrences of ln(N/df) (1 + ln tf). Documents with score 0 are results too."""
    hits = matched(index, queries)
    weight = F.col("qtf") * idf(F.col("n"), F.col("df")) * log_tf(F.col("tf"))
    return topk(hits.groupBy("qid", "doc_id").agg(F.sum(weight).alias("score")), k, "tfidf")


def bm25_scores(index: Index, queries: DataFrame, k1: float = K1, b: float = B, once: bool = False) -> DataFrame:
    """(qid, doc_id, score). Document lengths join the postings of query terms only."""
    hits = matched(index, queries, once).join(index.docs, "doc_id")
    weight = F.col("qtf") * robertson(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return hits.groupBy("qid", "doc_id").agg(F.sum(weight).alias("score"))


def bm25(index: Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    return topk(bm25_scores(index, queries, k1, b), k, "bm25")


def upper_bounds(index: Index, k1: float = K1, b: float = B) -> DataFrame:
    """(term, upper_bound): the most that a term can add to any document's BM25."""
    terms = index.terms.crossJoin(F.broadcast(index.stats.select("n", "avgdl", "min_dl")))  # one row
    return terms.select("term", (robertson(F.col("n"), F.col("df")) * saturation(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"), k1, b)).alias("upper_bound"))


def wand(index: Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, prune: bool = False) -> DataFrame:
    """BM25 over each query's distinct terms, with the same results whether or not documents are pruned by bounds.

    Pruned: a query's k-th best score by the rarest of its terms that has k documents is a threshold. Its terms of the
    least bounds, as long as those sum to less, can't bring a document there by themselves, so of their postings only
    those of documents with another term of the query are kept; a document whose bounds sum to less is left out too.
    Both come before lengths are joined and scores summed.
    """
    if not prune:
        return topk(bm25_scores(index, queries, k1, b, once=True), k, "wand")
    hits = matched(index, queries, once=True)
    bound = robertson(F.col("n"), F.col("df")) * saturation(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"), k1, b)
    part = robertson(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    terms = query_terms(queries).select("qid", "term").join(index.terms.select("term", "df", "max_tf"), "term").crossJoin(F.broadcast(index.stats.select("n", "avgdl", "min_dl")))  # one row
    terms = terms.select("qid", "term", "df", bound.alias("bound"))
    rare = terms.where(F.col("df") >= k).groupBy("qid").agg(F.min(F.struct("df", "term")).alias("r")).select("qid", F.col("r.term").alias("term"))
    first = hits.join(rare, ["qid", "term"]).join(index.docs, "doc_id").select("qid", part.alias("part"))
    at = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part")))
    theta = first.withColumn("at", at).where(F.col("at") == k).select("qid", (F.col("part") - 1e-9).alias("theta"))
    upto = F.sum("bound").over(Window.partitionBy("qid").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    terms = terms.withColumn("upto", upto).join(theta, "qid", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
    hits = hits.join(terms.select("qid", "term", "bound", "theta", (F.col("upto") >= F.col("theta")).alias("able")), ["qid", "term"])
    able = hits.where("able").groupBy("qid", "doc_id").agg(F.sum("bound").alias("most"), F.first("theta").alias("theta"))
    weak = terms.where(F.col("upto") < F.col("theta")).groupBy("qid").agg(F.sum("bound").alias("weak"))
    able = able.join(weak, "qid", "left").where(F.col("most") + F.coalesce("weak", F.lit(0.0)) >= F.col("theta")).select("qid", "doc_id")
    kept = hits.join(able, ["qid", "doc_id"], "left_semi").join(index.docs, "doc_id")
    return topk(kept.groupBy("qid", "doc_id").agg(F.sum(F.col("qtf") * part).alias("score")), k, "wand")
