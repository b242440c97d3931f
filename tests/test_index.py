import pytest
from inkwell.functions import text
from inkwell.operators.index import Index, merge_postings, packed, postings_of
from inkwell.sources.readers import read_collection, read_qrels, read_queries
from inkwell.streaming.ingest import compact, ingest
from pyspark.sql import functions as F

TOY = [(1, "a b a c"), (2, "b c d"), (3, "a d d d e"), (4, "c")]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "doc_id long, text string")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_postings_and_statistics(toy):
    index = Index.build(toy)
    assert as_set(index.docs) == {(1, 4), (2, 3), (3, 5), (4, 1)}
    assert {r["term"]: (r["df"], r["cf"], r["max_tf"]) for r in index.terms.collect()} == {"a": (2, 3, 2), "b": (2, 2, 1), "c": (3, 3, 1), "d": (2, 4, 3), "e": (1, 1, 1)}
    s = index.stats.first()
    assert (s["n"], s["v"], s["tokens"], s["postings"], s["avgdl"], s["min_dl"]) == (4, 5, 13, 10, 3.25, 1)


def test_tokens_follow_unicode_white_space(spark):
    raw = "a b c\x1cd e\x85f \n g"
    rows = spark.createDataFrame([(1, raw), (2, "   "), (3, None), (4, "")], "doc_id long, text string")
    assert [r["term"] for r in text.tokens(rows).collect()] == raw.split()
    assert rows.select(text.words(F.col("text")).alias("w")).collect()[0]["w"] == raw.split()


def test_merging_equals_indexing_all(toy):
    whole = as_set(postings_of(toy))
    assert as_set(merge_postings(postings_of(toy.where("doc_id < 3")), postings_of(toy.where("doc_id >= 3")))) == whole


def test_merge_adds_frequencies(spark):
    a = spark.createDataFrame([("t", 1, 34), ("t", 3, 2), ("t", 4, 23)], "term string, doc_id long, tf int")
    b = spark.createDataFrame([("t", 1, 11), ("t", 2, 4), ("t", 4, 3), ("t", 6, 13)], "term string, doc_id long, tf int")
    assert {(r["doc_id"], r["tf"]) for r in merge_postings(a, b).collect()} == {(1, 45), (2, 4), (3, 2), (4, 26), (6, 13)}


def test_store_load_lookup_and_prefix(spark, toy, tmp_path):
    index = Index.build(toy, str(tmp_path / "i"), "spimi")
    again = Index.load(spark, str(tmp_path / "i"))
    assert as_set(again.postings) == as_set(postings_of(toy))
    assert as_set(again.lookup("d").select("doc_id", "tf")) == {(2, 1), (3, 3)}
    assert "EqualTo(term,d)" in again.lookup("d")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert [r["term"] for r in again.prefix("").collect()] == list("abcde")
    assert again.prefix("x").count() == 0
    assert [tuple(r) for r in again.term_ids().orderBy("term_id").collect()] == list(enumerate("abcde"))
    assert as_set(index.merge(Index.build(spark.createDataFrame([(9, "a z")], toy.schema))).lookup("a").select("doc_id")) == {(1,), (3,), (9,)}


def test_prefix_of_words(spark):
    docs = spark.createDataFrame([(1, "protein protease proteomics proton alpha")], "doc_id long, text string")
    assert [r["term"] for r in Index.build(docs).prefix("prot").collect()] == ["protease", "protein", "proteomics", "proton"]


def test_packed_lists_by_parts(toy):
    rows = {(r["term"], r["part"]): [tuple(x) for x in r["list"]] for r in packed(postings_of(toy), 2).collect()}
    assert rows["c", 0] == [(1, 1)] and rows["c", 1] == [(2, 1)] and rows["c", 2] == [(4, 1)]
    assert {r["term"]: len(r["list"]) for r in packed(postings_of(toy)).collect()}["c"] == 3


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc_id long, text string")
    index = Index.build(docs)
    assert index.postings.count() == 0 and index.stats.first()["n"] == 0


def test_common_prefix(spark):
    rows = spark.createDataFrame([("hell", "help", 3), ("", "a", 0), ("abc", "abc", 3), ("x", "y", 0)], "a string, b string, n int")
    assert all(r["n"] == r["m"] for r in rows.select("n", text.common_prefix(F.col("a"), F.col("b")).alias("m")).collect())


def test_readers(spark, tmp_path):
    for block, name, body in (("1", "7", "x y"), ("2", "10", "y\nz"), ("10", "3", "")):
        (tmp_path / "c" / block).mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / block / f"{name}.txt").write_text(body)
    docs = read_collection(spark, str(tmp_path / "c"))
    assert {(r["doc_id"], r["block"], r["docno"], r["text"]) for r in docs.collect()} == {(0, "1", "7", "x y"), (1, "2", "10", "y\nz")}
    (tmp_path / "q.txt").write_text("Q1 lipid  metabolism\n\nQ2 a\n")
    assert as_set(read_queries(spark, str(tmp_path / "q.txt"))) == {("Q1", "lipid metabolism"), ("Q2", "a")}
    (tmp_path / "r.txt").write_text("Q1 166\nQ1 166\nQ2 3\n")
    assert as_set(read_qrels(spark, str(tmp_path / "r.txt"))) == {("Q1", 166, 1), ("Q2", 3, 1)}


def test_streaming_ingest_equals_batch(spark, toy, tmp_path):
    for i, part in enumerate(("doc_id < 3", "doc_id >= 3")):
        toy.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(toy.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert as_set(compact(spark, str(tmp_path / "s"), str(tmp_path / "out")).postings) == as_set(postings_of(toy))


def test_zipf_equals_regression_over_every_rank(spark):
    from inkwell.operators import analytics
    from pyspark.sql import functions as F

    for counts in ([1] * 3000 + [2] * 700 + [5] * 90 + [40, 77, 900], [3, 1], [4, 4, 4], [7], list(range(1, 60))):
        index = Index(None, None, spark.createDataFrame([(c,) for c in counts], "cf long"), None)
        ranks = spark.createDataFrame(list(enumerate(sorted(counts, reverse=True), 1)), "rank long, cf long")
        y, x = F.ln("cf"), F.ln("rank")
        want = ranks.agg(-F.regr_slope(y, x), F.regr_intercept(y, x), F.regr_r2(y, x)).first()
        got = analytics.zipf(index).first()
        for a, b in zip(got, want, strict=False):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (counts[:5], got, want)
    sums = spark.range(1, 200).select("id", analytics.log_sum(F.col("id")).alias("s"), analytics.log_square_sum(F.col("id")).alias("q")).collect()
    import math

    for r in sums:
        logs = [math.log(k) for k in range(1, r["id"] + 1)]
        assert abs(r["s"] - sum(logs)) < 1e-9 and abs(r["q"] - sum(v * v for v in logs)) < 1e-8
