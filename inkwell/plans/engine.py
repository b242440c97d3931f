"""The search engine: one object over an index, with all methods by name."""

from __future__ import annotations

import time

from inkwell.operators import analytics, codecs, expand, fusion, metrics, rank
from inkwell.operators.index import Index
from inkwell.operators.lsi import LSI
from inkwell.sources.readers import read_collection
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("tfidf", "bm25", "wand", "lsi", "prf", "prf+bm25", "prf+tfidf", "prf+lsi", "cooc", "cooc+bm25", "rrf", "condorcet", "combsum", "combmnz")


class SearchEngine:
    """Queries are DataFrames (qid, query) or one string; results are DataFrames too."""

    def __init__(self, spark: SparkSession, index: Index, lsi: LSI | None = None, paths: DataFrame | None = None) -> None:
        self.spark, self.index, self.lsi, self.paths = spark, index, lsi, paths

    @classmethod
    def index_directory(cls, spark: SparkSession, data: str, out: str, method: str = "bsbi") -> SearchEngine:
        """Index a tree of text files into a folder, over whatever index was there."""
        # many small files are read once, into columns
        read_collection(spark, data).write.mode("overwrite").parquet(f"{out}/texts")
        docs = spark.read.parquet(f"{out}/texts")
        Index.build(docs, out, method)
        return cls.open(spark, out)

    @classmethod
    def open(cls, spark: SparkSession, path: str, lsi: str | None = None) -> SearchEngine:
        return cls(spark, Index.load(spark, path), LSI.load(spark, lsi) if lsi else None, spark.read.parquet(f"{path}/texts").drop("text"))

    def queries(self, queries: DataFrame | str) -> DataFrame:
        return self.spark.createDataFrame([("q", queries)], "qid string, query string") if isinstance(queries, str) else queries

    def search(self, queries: DataFrame | str, method: str = "bm25", k: int = 10) -> DataFrame:
        """A method that isn't known is bm25. Fusion is over bm25 and wand, and lsi if there is a model."""
        queries = self.queries(queries)
        if method in fusion.STRATEGIES:
            return fusion.fuse(self.index, queries, k, self.base(), method, self.lsi)
        if method == "wand":
            return rank.wand(self.index, queries, k)
        return expand.run(self.index, queries, method if method in METHODS else "bm25", k, self.lsi)

    def base(self) -> list[str]:
        return ["bm25", "wand", *(["lsi"] if self.lsi else [])]

    def with_paths(self, ranked: DataFrame) -> DataFrame:
        return ranked if self.paths is None else ranked.join(self.paths, "doc_id", "left")

    def compare(self, query: str, k: int = 10) -> list[tuple[str, float, DataFrame]]:
        """(method, milliseconds, results) for the usual methods."""
        out = []
        for method in ["tfidf", "bm25", "wand", *(["lsi", "prf+bm25"] if self.lsi else []), "rrf"]:
            began = time.perf_counter()
            rows = self.search(query, method, k).cache()
            rows.count()
            out.append((method, 1000 * (time.perf_counter() - began), rows))
        return out

    def evaluate(self, queries: DataFrame, qrels: DataFrame, methods: list[str] | None = None, k: int = 1000) -> DataFrame:
        methods = methods or ["tfidf", "bm25", "wand", "prf+bm25", "rrf"]
        lists = fusion.union([self.search(queries, m, k).withColumn("method", F.lit(m)) for m in methods])
        return metrics.evaluate(lists, qrels, queries, methods, k)

    def difficulty(self, queries: DataFrame | str) -> tuple[DataFrame, DataFrame]:
        """A row per query, and a row per query term with its df and idf."""
        queries = self.queries(queries)
        return analytics.difficulty(self.index, queries), analytics.difficulty_terms(self.index, queries)

    def overlap(self, queries: DataFrame | str, k: int = 10, methods: list[str] | None = None) -> DataFrame:
        queries, methods = self.queries(queries), methods or self.base()
        return fusion.overlap(fusion.lists_of(self.index, queries, methods, k, self.lsi), methods, queries)

    def related(self, term: str, k: int = 10) -> DataFrame:
        if self.lsi is None:
            raise ValueError("related terms need an LSI model")
        return self.lsi.related(term, k)

    def prefix(self, prefix: str, limit: int = 50) -> DataFrame:
        """Terms with the prefix, which is lower-cased here as a convenience of the interface."""
        return self.index.prefix(prefix, limit, lower=True)

    def status(self) -> DataFrame:
        return self.index.stats.withColumn("lsi", F.lit(self.lsi is not None))

    def inspect(self, what: str = "all") -> dict[str, DataFrame]:
        found = analytics.report(self.index)
        return found if what == "all" else {k: v for k, v in found.items() if k.startswith(what)}

    def bench(self) -> DataFrame:
        return codecs.size_report(self.index.postings)


