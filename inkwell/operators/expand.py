"""Query expansion by pseudo-relevance feedback and by co-occurrence, for a batch of queries."""

from __future__ import annotations

from inkwell.functions.text import query_terms
from inkwell.functions.weights import log_tf, robertson
from inkwell.operators import rank
from inkwell.operators.index import Index
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_terms(weights: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("weight", 9).desc(), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("qid", "rank", "term", "weight")


def feedback_terms(index: Index, queries: DataFrame, seeds: DataFrame, top_docs: int = 10, most: int = 5, beta: float = 0.8) -> DataFrame:
    """Rocchio weights beta * sum over the seed documents of idf (1 + ln tf) / documents, of terms not in the query."""
    seeds = seeds.where(F.col("rank") <= top_docs).select("qid", "doc_id")
    few, postings = seeds.limit(rank.PUSHED + 1).collect(), index.postings
    if len(few) <= rank.PUSHED:  # found once, and sent to the scan as a filter
        seeds = seeds.sparkSession.createDataFrame(few, seeds.schema)
        postings = postings.where(F.col("doc_id").isin(sorted({r["doc_id"] for r in few})))
    sizes = seeds.groupBy("qid").agg(F.count("*").alias("r"))
    rows = postings.join(seeds.join(sizes, "qid"), "doc_id")
    rows = rows.join(query_terms(queries).select("qid", "term"), ["qid", "term"], "left_anti")
    rows = rows.join(index.terms.select("term", "df"), "term").crossJoin(F.broadcast(index.stats.select("n")))  # one row
    weight = F.lit(beta) * robertson(F.col("n"), F.col("df")) * log_tf(F.col("tf")) / F.col("r")
    return best_terms(rows.groupBy("qid", "term").agg(F.sum(weight).alias("weight")), most)


def cooccurring_terms(index: Index, queries: DataFrame, most: int = 5, min_df: int = 2) -> DataFrame:
    """PMI weights ln(together * N / (df of the query's documents * df of the term + 1e-9) + 1) of terms not in the query.

    The query's documents are those that hold any of its terms. All queries go over the postings in one pass: a document
    carries the set of its queries, and terms are counted by set before sets are taken apart.
    """
    terms = query_terms(queries).select("qid", "term")
    docs = rank.matched(index, queries, once=True).groupBy("doc_id").agg(F.sort_array(F.collect_set("qid")).alias("qids"))
    sizes = docs.groupBy("qids").agg(F.count("*").alias("n")).select(F.explode("qids").alias("qid"), "n").groupBy("qid").agg(F.sum("n").alias("df_union"))
    together = index.postings.select("term", "doc_id").join(docs, "doc_id").groupBy("term", "qids").agg(F.count("*").alias("n"))
    together = together.select("term", F.explode("qids").alias("qid"), "n").groupBy("qid", "term").agg(F.sum("n").alias("cooc"))
    together = together.join(terms, ["qid", "term"], "left_anti").join(index.terms.where(F.col("df") >= min_df).select("term", "df"), "term")
    together = together.join(sizes, "qid").crossJoin(F.broadcast(index.stats.select("n")))  # one row
    weight = F.ln(F.col("cooc") * F.col("n") / (F.col("df_union") * F.col("df") + 1e-9) + 1.0)
    return best_terms(together.select("qid", "term", weight.alias("weight")), most)


def expanded(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """queries with their new terms appended as text, best first, at weight 1 each."""
    new = terms.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("new"))
    return queries.join(new, "qid", "left").select("qid", F.concat_ws(" ", "query", F.array_join(F.coalesce("new", F.array().cast("array<string>")), " ")).alias("query"))


def feedback(index: Index, queries: DataFrame, seed: str = "bm25", top_docs: int = 10, most: int = 5, beta: float = 0.8) -> DataFrame:
    found = (rank.bm25 if seed == "bm25" else rank.tfidf)(index, queries, top_docs)
    return expanded(queries, feedback_terms(index, queries, found, top_docs, most, beta))


def cooccurrence(index: Index, queries: DataFrame, most: int = 5, min_df: int = 2) -> DataFrame:
    return expanded(queries, cooccurring_terms(index, queries, most, min_df))


def run(index: Index, queries: DataFrame, method: str, k: int = 10, lsi=None) -> DataFrame:
    """bm25, tfidf, lsi, prf+bm25, prf+tfidf, prf+lsi or cooc+bm25; prf and cooc alone stand for those with bm25.

    prf+lsi takes its feedback from TF-IDF, and without an LSI model searches by BM25, as lsi does.
    """
    method = {"prf": "prf+bm25", "cooc": "cooc+bm25"}.get(method, method)
    if method.startswith("prf+"):
        queries = feedback(index, queries, "bm25" if method == "prf+bm25" else "tfidf")
    elif method == "cooc+bm25":
        queries = cooccurrence(index, queries)
    last = method.rpartition("+")[2]
    if last == "lsi" and lsi is not None:
        found = lsi.retrieve(queries, k)
    elif last == "tfidf":
        found = rank.tfidf(index, queries, k)
    elif last in ("bm25", "lsi"):
        found = rank.bm25(index, queries, k)
    else:
        raise ValueError(f"unknown expansion method {method}")
    return found.withColumn("method", F.lit(method))
