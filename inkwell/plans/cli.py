"""Command line: index, search, eval, lsi, inspect, bench. `python -m inkwell.plans.cli --help`."""

from __future__ import annotations

import argparse

from inkwell.operators import codecs
from inkwell.operators.index import packed
from inkwell.operators.lsi import LSI
from inkwell.plans.engine import METHODS, SearchEngine
from inkwell.sources.readers import read_qrels, read_queries
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkwell")
    s = p.add_subparsers(dest="command", required=True)
    x = s.add_parser("index")
    x.add_argument("--data", default="collection")
    x.add_argument("--out", default="index")
    x.add_argument("--method", choices=("bsbi", "spimi"), default="bsbi")
    x = s.add_parser("search")
    x.add_argument("query")
    x.add_argument("--index", default="index")
    x.add_argument("--lsi")
    x.add_argument("--method", default="bm25", help=", ".join(METHODS))
    x.add_argument("-k", type=int, default=10)
    x.add_argument("--compare", action="store_true")
    x.add_argument("--difficulty", action="store_true")
    x = s.add_parser("eval")
    x.add_argument("--index", default="index")
    x.add_argument("--lsi")
    x.add_argument("--queries", required=True)
    x.add_argument("--qrels", required=True)
    x.add_argument("--methods", nargs="*")
    x.add_argument("-k", type=int, default=1000)
    x = s.add_parser("lsi")
    x.add_argument("action", choices=("build", "query", "related", "info"))
    x.add_argument("text", nargs="?", default="")
    x.add_argument("--index", default="index")
    x.add_argument("--model", default="lsi")
    x.add_argument("--components", type=int, default=100)
    x.add_argument("-k", type=int, default=10)
    x = s.add_parser("inspect")
    x.add_argument("what", nargs="?", default="all")
    x.add_argument("--index", default="index")
    x = s.add_parser("bench")
    x.add_argument("--index", default="index")
    x.add_argument("--verify", action="store_true")
    x.add_argument("--speed", action="store_true", help="time the codecs on synthetic postings")
    x = s.add_parser("demo")
    x.add_argument("queries", nargs="*", default=["the of and", "the with of", "zzqx the"])
    x.add_argument("--index", default="index")
    x.add_argument("-k", type=int, default=10)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("inkwell").getOrCreate()
    if a.command == "index":
        SearchEngine.index_directory(spark, a.data, a.out, a.method).status().show()
        return
    if a.command == "lsi" and a.action == "build":
        engine = SearchEngine.open(spark, a.index)
        LSI.build(engine.index, a.components, a.model).explained().show()
        return
    engine = SearchEngine.open(spark, a.index, a.model if a.command == "lsi" else getattr(a, "lsi", None))
    if a.command == "search":
        if a.compare:
            for method, ms, rows in engine.compare(a.query, a.k):
                print(f"{method}: {ms:.1f} ms")
                engine.with_paths(rows).orderBy("rank").show(a.k, False)
        else:
            engine.with_paths(engine.search(a.query, a.method, a.k)).orderBy("rank").show(a.k, False)
        if a.difficulty:
            for df in engine.difficulty(a.query):
                df.show(truncate=False)
    elif a.command == "eval":
        queries, qrels = read_queries(spark, a.queries), read_qrels(spark, a.qrels)
        engine.evaluate(queries, qrels, a.methods, a.k).show(truncate=False)
    elif a.command == "lsi":
        if a.action == "info":
            engine.lsi.explained().show(200)
        elif a.action == "related":
            engine.related(a.text, a.k).show(a.k, False)
        else:
            engine.with_paths(engine.search(a.text, "lsi", a.k)).orderBy("rank").show(a.k, False)
    elif a.command == "inspect":
        for name, df in engine.inspect(a.what).items():
            print(name)
            df.show(truncate=False)
    elif a.command == "demo":
        for text in a.queries:
            for method in ("tfidf", "bm25", "wand"):
                print(f"{text} by {method}")
                engine.with_paths(engine.search(text, method, a.k)).orderBy("rank").show(a.k, False)
    else:
        engine.bench().show()
        if a.speed:
            rows = packed(codecs.synthetic_postings(spark)).collect()  # 500 lists of 200 at most
            for r in codecs.speeds([([x["doc_id"] for x in row["list"]], [x["tf"] for x in row["list"]]) for row in rows]):
                print(r)
        if a.verify:
            codecs.roundtrip(engine.index.postings).select("codec", "lists", F.col("wrong") == 0).show()


if __name__ == "__main__":
    main()
