import itertools
import random
from collections import Counter

import pytest
from inkwell.operators import analytics, expand, fusion, metrics, rank
from inkwell.operators.index import Index
from inkwell.operators.lsi import LSI
from inkwell.plans.cli import main
from inkwell.plans.engine import METHODS, SearchEngine

TOY = [(1, "a b a c"), (2, "b c d"), (3, "a d d d e"), (4, "c")]


@pytest.fixture(scope="module")
def index(spark):
    i = Index.build(spark.createDataFrame(TOY, "doc_id long, text string"))
    for df in (i.postings, i.docs, i.terms, i.stats):
        df.cache()
    return i


def ask(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "qid string, query string")


def scores(df):
    return {r["doc_id"]: round(r["score"], 6) for r in df.collect()}


def test_scores_of_the_toy_corpus(spark, index):
    q = ask(spark, "a d a zz")
    assert scores(rank.tfidf(index, q)) == {3: 2.840942, 1: 2.3472, 2: 0.693147}
    assert scores(rank.bm25(index, q)) == {3: 2.112599, 1: 1.789978, 2: 0.715668}
    for prune in (False, True):
        assert scores(rank.wand(index, q, prune=prune)) == {3: 1.544575, 1: 0.894989, 2: 0.715668}
    assert {r["term"]: round(r["upper_bound"], 6) for r in rank.upper_bounds(index).collect()} == {"a": 1.183523, "b": 0.967025, "c": 0.497605, "d": 1.278968, "e": 1.679689}


def test_zero_scores_are_results_and_unknown_terms_are_not(spark):
    i = Index.build(spark.createDataFrame([(1, "x"), (2, "x y")], "doc_id long, text string"))
    assert scores(rank.tfidf(i, ask(spark, "x"))) == {1: 0.0, 2: 0.0}
    for method in ("tfidf", "bm25", "wand"):
        assert fusion.single(i, ask(spark, "zz", ""), method, 10).count() == 0
    assert rank.wand(i, ask(spark, "x"), k=0).count() == 0


def test_pruned_results_are_the_same(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(d, " ".join(r.choice("abcdefghij") * r.choice((1, 1, 2)) for _ in range(r.randint(1, 30)))) for d in range(80)], "doc_id long, text string")
    i = Index.build(docs)
    q = ask(spark, *(" ".join(r.sample("abcdefghij", 3)) for _ in range(12)))
    rows = lambda df: {(x["qid"], x["rank"], x["doc_id"], round(x["score"], 9)) for x in df.collect()}
    assert rows(rank.wand(i, q, 5)) == rows(rank.wand(i, q, 5, prune=True)) == rows(rank.bm25(i, q, 5))


def test_ties_go_by_doc_id(spark):
    i = Index.build(spark.createDataFrame([(d, "same text") for d in (5, 3, 9, 1)], "doc_id long, text string"))
    assert [r["doc_id"] for r in rank.bm25(i, ask(spark, "same"), 3).orderBy("rank").collect()] == [1, 3, 5]


def test_expansion(spark, index):
    q = ask(spark, "a")
    seeds = rank.bm25(index, q, 10)
    found = expand.feedback_terms(index, q, seeds, top_docs=1)
    assert {r["term"]: round(r["weight"], 6) for r in found.collect()} == {"b": 0.554518, "c": 0.28534}
    assert {r["term"]: round(r["weight"], 6) for r in expand.cooccurring_terms(index, q).collect()} == {"b": 0.693147, "d": 0.693147, "c": 0.510826}
    assert expand.cooccurrence(index, q).first()["query"] == "a b d c"
    assert expand.run(index, q, "prf").first()["method"] == "prf+bm25"
    assert scores(expand.run(index, q, "prf+lsi")) == scores(rank.bm25(index, expand.feedback(index, q, "tfidf")))
    with pytest.raises(ValueError):
        expand.run(index, q, "nothing")


def lists(spark, *named):
    rows = [("q", m, i + 1, ord(d), float(s)) for m, docs in named for i, (d, s) in enumerate(docs)]
    return spark.createDataFrame(rows, "qid string, method string, rank int, doc_id long, score double")


def letters(df):
    return {chr(r["doc_id"]): round(r["score"], 6) for r in df.collect()}


def test_fusion_fixtures(spark):
    two = lists(spark, ("m1", [("A", 3), ("B", 2), ("C", 1)]), ("m2", [("B", 3), ("E", 2), ("A", 1)]))
    assert letters(fusion.rrf(two)) == {"B": 0.032522, "A": 0.032266, "E": 0.016129, "C": 0.015873}
    assert letters(fusion.condorcet(two)) == {"B": 5, "A": 4, "E": 2, "C": 1}
    other = lists(spark, ("m1", [("A", 10), ("B", 8), ("C", 6)]), ("m2", [("B", 9), ("A", 7), ("D", 5)]))
    assert letters(fusion.combsum(other)) == {"A": 1.5, "B": 1.5, "C": 0, "D": 0}
    assert letters(fusion.combmnz(other)) == {"A": 3, "B": 3, "C": 0, "D": 0}
    q = spark.createDataFrame([("q",), ("none",)], "qid string")
    assert {r["qid"]: r["jaccard"] for r in fusion.overlap(two, ["m1", "m2"], q).collect()} == {"q": 0.5, "none": 1.0}
    assert letters(fusion.combsum(lists(spark, ("m1", [("A", 2), ("B", 2)])))) == {"A": 0, "B": 0}


def test_condorcet_equals_pairwise_duels(spark):
    r = random.Random(1)
    for _ in range(3):
        named = [(m, [(d, 0) for d in r.sample("ABCDEFGHIJ", r.randint(1, 8))]) for m in "xyz"]
        docs, wins = {d for _, x in named for d, _ in x}, Counter()
        for _, x in named:
            at = {d: i for i, (d, _) in enumerate(x)}
            for a, b in itertools.permutations(docs, 2):
                wins[a] += at.get(a, len(x)) < at.get(b, len(x))
        assert letters(fusion.condorcet(lists(spark, *named), 20)) == {d: n for d, n in wins.items() if n}


@pytest.mark.parametrize(
    ("rel", "k", "rbp", "dcg", "ndcg", "ap"),
    [
        ([1, 0, 1, 1, 0, 0], None, 0.4304, 1.930677, 0.906025, 0.805556),
        ([1, 0, 1, 1, 0, 0], 3, 0.328, 1.5, 0.919721, 0.833333),
        ([1, 1, 0, 0, 0], None, 0.36, 1.63093, 1.0, 1.0),
        ([0, 0, 1, 1, 0], None, 0.2304, 0.930677, 0.570642, 0.416667),
        ([1, 0, 1, 0, 1], None, 0.40992, 1.886853, 0.88546, 0.755556),
        ([0, 0], None, 0, 0, 0, 0),
    ],
)
def test_metrics(spark, rel, k, rbp, dcg, ndcg, ap):
    ranked = lists(spark, ("m", [(chr(65 + i), 0) for i in range(len(rel))]))
    qrels = spark.createDataFrame([("q", 65 + i, x) for i, x in enumerate(rel)], "qid string, doc_id long, rel int").where("rel > 0 or doc_id = 65")
    row = metrics.per_query(metrics.judged(ranked, qrels, k)).first()
    assert [round(row[c], 6) for c in metrics.NAMES] == [rbp, dcg, ndcg, ap]


def test_means_count_queries_without_results(spark):
    ranked = lists(spark, ("m", [("A", 1)]))
    qrels = spark.createDataFrame([("q", 65, 1)], "qid string, doc_id long, rel int")
    q = spark.createDataFrame([("q",), ("other",)], "qid string")
    assert metrics.evaluate(ranked, qrels, q, ["m", "n"]).where("method = 'm'").first()["map"] == 0.5
    best = metrics.best_methods(metrics.evaluate(ranked, qrels, q, ["n", "m"]), ["n", "m"])
    assert {r["method"] for r in best.collect()} == {"m"}


def test_difficulty(spark, index):
    rows = {r["qid"]: r for r in analytics.difficulty(index, ask(spark, "a d", "a zz", "")).collect()}
    a = rows["q0"]
    assert [round(a[c], 6) for c in ("avg_idf", "var_idf", "specificity")] == [0.693147, 0, 0.430677] and (a["label"], a["expected"]) == ("MEDIUM", 1)
    b = rows["q1"]
    assert [round(b[c], 6) for c in ("avg_idf", "var_idf", "specificity")] == [5.346574, 21.654377, 3.322013] and (b["label"], b["min_df"], b["expected"]) == ("MEDIUM", 0, 1)
    assert (rows["q2"]["label"], rows["q2"]["specificity"]) == ("UNKNOWN", 0.5)


def test_reports(spark, index):
    found = {k: v.collect() for k, v in analytics.report(index).items()}
    v = found["vocabulary"][0]
    assert (v["n"], v["v"], v["hapax"], v["rare"], v["tokens"]) == (4, 5, 1, 4, 13)
    assert tuple(found["df_percentiles"][0]) == (2, 3, 3)
    assert sum(r["docs"] for r in found["length_histogram"]) == 4 and len(found["length_histogram"]) == 10
    assert (found["lengths"][0]["mean"], found["lengths"][0]["p50"]) == (3.25, 3.5)
    assert [r["term"] for r in found["stopwords"]] == ["c"]


def test_lsi(spark, tmp_path):
    r = random.Random(2)
    topics = ["cat dog pet fur".split(), "star moon sun sky".split(), "bread salt soup rice".split()]
    docs = [(d, " ".join(r.choice(topics[d % 3]) for _ in range(12))) for d in range(30)]
    i = Index.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    m = LSI.build(i, 3, str(tmp_path / "m"))
    assert m.terms.count() == 12 and m.docs.count() == 30
    found = LSI.load(spark, str(tmp_path / "m")).retrieve(ask(spark, "cat dog", "zz"), 10).orderBy("rank").collect()
    assert {x["qid"] for x in found} == {"q0"} and {x["doc_id"] % 3 for x in found} == {0}
    assert all(-1.000001 <= x["score"] <= 1.000001 for x in found) and [x["score"] for x in found] == sorted((x["score"] for x in found), reverse=True)
    assert {x["term"] for x in m.related("star", 3).collect()} == {"moon", "sun", "sky"}
    e = m.explained().orderBy("i").collect()
    assert abs(sum(x["ratio"] for x in e) - 1) < 1e-9 and sum(x["true_ratio"] for x in e) <= 1 + 1e-9

    import numpy as np
    from inkwell.operators.lsi import weights

    w = weights(i).toPandas().pivot(index="term", columns="doc_id", values="w").fillna(0).to_numpy()
    assert np.allclose([x["s"] for x in e], np.linalg.svd(w, compute_uv=False)[:3], rtol=1e-4)


def test_engine_and_command_line(spark, tmp_path, capsys):
    for n, body in TOY:
        (tmp_path / "c" / "1").mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / "1" / f"{n}.txt").write_text(body)
    out, model = str(tmp_path / "out"), str(tmp_path / "lsi")
    main(["index", "--data", str(tmp_path / "c"), "--out", out], spark)
    main(["lsi", "build", "--index", out, "--model", model, "--components", "2"], spark)
    main(["search", "a d", "--index", out, "--method", "rrf", "--difficulty"], spark)
    main(["lsi", "related", "a", "--index", out, "--model", model], spark)
    main(["inspect", "vocab", "--index", out], spark)
    main(["bench", "--verify", "--speed", "--index", out], spark)
    main(["demo", "a d", "--index", out], spark)
    (tmp_path / "q.txt").write_text("Q1 a d\n")
    (tmp_path / "r.txt").write_text("Q1 2\n")
    main(["eval", "--index", out, "--queries", str(tmp_path / "q.txt"), "--qrels", str(tmp_path / "r.txt"), "--methods", "bm25"], spark)
    assert "specificity" in capsys.readouterr().out
    engine = SearchEngine.open(spark, out, model)
    for method in METHODS:
        assert engine.search("a d", method, 3).count() <= 3
    assert scores(engine.search("a d", "no such method")) == scores(engine.search("a d", "bm25"))
    assert engine.with_paths(engine.search("e")).first()["docno"] == "3"
    assert [m for m, _, _ in engine.compare("a")] == ["tfidf", "bm25", "wand", "lsi", "prf+bm25", "rrf"]
    assert engine.overlap("a").count() == 3 and engine.prefix("A").count() == 1 and engine.status().first()["lsi"]
    with pytest.raises(ValueError):
        SearchEngine.open(spark, out).related("a")


def test_lsi_straight_from_texts_keeps_no_vector_by_term(spark, tmp_path):
    """Repeated ids, blank and null texts, ids far apart, more than a slice of columns, and the model of the stored index."""
    from inkwell.operators import lsi

    r = random.Random(3)
    rows = [(d * 10**12, " ".join(r.choice("abcdefghijklmnop") for _ in range(9))) for d in range(-9, 30)] + [(0, "a zz zz"), (5, "   "), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    i = Index.build(docs, str(tmp_path / "i"))
    a, b = LSI.of_texts(docs, 4, str(tmp_path / "a")), LSI.build(i, 4, str(tmp_path / "b"))
    assert sorted(x.name for x in (tmp_path / "a").iterdir()) == ["blocks", "docs", "lengths", "sigma", "span"]
    for model in (a, b):
        assert model.n == 39 and model.total == pytest.approx(weights_squared(i))
    assert [x["s"] for x in a.explained().orderBy("i").collect()] == pytest.approx([x["s"] for x in b.explained().orderBy("i").collect()])
    q = ask(spark, "a zz", "none", "b c")
    assert scores(a.retrieve(q.where("qid = 'q0'"))) == scores(b.retrieve(q.where("qid = 'q0'")))
    for name in ("docs", "terms"):
        assert sorted(getattr(a.index(docs), name).collect()) == sorted(getattr(i, name).select(getattr(a.index(docs), name).columns).collect())
    assert a.index(docs).stats.first() == i.stats.first()
    vectors = {x["term"]: x["vec"] for x in a.terms.collect()}
    held, lsi.HELD = lsi.HELD, 20  # two slices
    try:
        assert all(vectors[x["term"]] == pytest.approx(x["vec"]) for x in a.terms.collect())
    finally:
        lsi.HELD = held
    assert [x["term"] for x in a.among(["zz", "b", "none"]).orderBy("term").collect()] == ["b", "zz"]


def weights_squared(index):
    from inkwell.operators.lsi import weights

    return sum(x["w"] ** 2 for x in weights(index).collect())


def test_feedback_by_lsi_from_the_models_own_index(spark, tmp_path):
    docs = spark.createDataFrame(TOY, "doc_id long, text string")
    i, m = Index.build(docs, str(tmp_path / "i")), LSI.of_texts(docs, 2, str(tmp_path / "m"))
    q = ask(spark, "a d", "zz")
    assert scores(expand.run(m.index(docs), q, "prf+lsi", lsi=m)) == scores(expand.run(i, q, "prf+lsi", lsi=m)) != {}


def test_nearest_by_products(spark):
    """Ties by id across parts, copies, a zero vector, and vectors that are no row of a matrix, as pair by pair."""
    from inkwell.operators import nearest

    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(300)] + [(300, [0.0] * 3), (301, None), (302, [1.0]), (303, [1.0, None, 2.0]), (304, [1.0, 2.0, float("nan")])]
    df = spark.createDataFrame(rows, "doc_id long, vec array<float>")
    queries = df.where("doc_id % 20 = 0 OR doc_id > 299").toDF("qid", "q")
    whole = rank.topk(nearest.pairs(df, queries), 10, "cosine")
    block, step = nearest.BLOCK, nearest.STEP
    nearest.BLOCK, nearest.STEP = 12, 7
    try:
        found = nearest.nearest(df, queries, 10)
        assert "CartesianProduct" not in nearest.nearest(df.where("doc_id < 300"), queries.where("qid < 300"))._jdf.queryExecution().toString()
        key = lambda x: (x["qid"], x["rank"], x["doc_id"], str(x["score"] if x["score"] is None else round(x["score"], 9) + 0.0))
        assert sorted(map(key, found.collect())) == sorted(map(key, whole.collect()))
    finally:
        nearest.BLOCK, nearest.STEP = block, step


def test_lsi_shuffles_small_rows_without_names_or_former_vectors(spark, tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from inkwell.operators import lsi

    monkeypatch.setattr(lsi, "ROUNDS", 1)
    monkeypatch.setattr(lsi, "ROW", 4)
    terms, docs = list("aaaaabbccdabcd"), np.array([1, 2, 3, 4, 5, 1, 2, 1, 3, 4, 9, 9, 9, 9])
    table = pa.Table.from_batches([lsi.piece(terms, docs, np.arange(1, 15), 1)])
    rows = lsi.merged(table.slice(1)).to_pylist()  # the first row has the lengths
    assert [(x["v"], x["postings"]) for x in rows] == [(1, 6), (1, 3), (1, 3), (1, 2)]
    monkeypatch.setattr(lsi, "ROW", 5)
    rows = lsi.merged(table.slice(1)).to_pylist()
    assert [lsi.loosened(x["terms"]) for x in rows] == [b"a", b"b", b"c\nd"] and sum(x["tokens"] for x in rows) == sum(range(1, 15))
    assert lsi.unpacked(rows[2]["counts"], np.int32).tolist() == [3, 2] and np.cumsum(lsi.unpacked(rows[2]["docs"], np.int64)).tolist() == [1, 3, 9, 4, 9]

    r = random.Random(5)
    texts = spark.createDataFrame([(d, " ".join(r.choice("abcdefghijkl") for _ in range(8))) for d in range(40)], "doc_id long, text string")
    a = LSI.of_texts(texts, 3, str(tmp_path / "a"))
    monkeypatch.setattr(lsi, "CHUNK", 300)  # a few documents each
    b = LSI.of_texts(texts, 3, str(tmp_path / "b"))
    assert b.span.count() > a.span.count()
    assert [x["s"] for x in a.explained().orderBy("i").collect()] == pytest.approx([x["s"] for x in b.explained().orderBy("i").collect()])
    q = ask(spark, "a b", "none")
    assert scores(a.retrieve(q)) == scores(b.retrieve(q)) != {}
    sent = lsi.dealt(b.blocks, lsi.turned(b.span, np.eye(3)), 2, 1, False).where("kind = 1").collect()
    assert sent and all(x["a"] is None and x["d"] for x in sent)
    assert all((x["was"] is not None) == keep for keep in (False, True) for x in lsi.product(b.blocks, b.span, np.eye(3), b.n, keep).collect())


def test_related_terms_are_cosines_of_all_terms_without_their_vectors(spark, tmp_path, monkeypatch):
    import numpy as np
    from inkwell.operators import lsi

    monkeypatch.setattr(lsi, "ROUNDS", 1)
    r = random.Random(6)
    texts = [(d, " ".join(r.choice("abcdefghijklmnop") for _ in range(9)) + f" only{d} also{d}") for d in range(30)]
    m = LSI.of_texts(spark.createDataFrame(texts, "doc_id long, text string"), 4, str(tmp_path / "m"))
    s = np.array([x["s"] for x in m.sigma.orderBy("i").collect()])
    vectors = {x["term"]: np.array(x["vec"]) * s for x in m.terms.collect()}
    own = vectors.pop("a")
    cosines = {t: float(v @ own / np.sqrt((v @ v) * (own @ own))) for t, v in vectors.items()}
    best = sorted(cosines, key=lambda t: (-round(cosines[t], 9), t))
    monkeypatch.setattr(lsi, "term_vectors", lambda blocks, chunks, width, n, only=None, *parts, f=lsi.term_vectors: f(blocks, chunks, width, n, only, *parts) if only else pytest.fail("vectors of all terms"))
    for held in (lsi.HELD, 30):  # one slice of columns, and two
        monkeypatch.setattr(lsi, "HELD", held)
        assert [x["term"] for x in m.related("a", 60).collect()] == best[:60]
        assert {x["term"]: x["similarity"] for x in m.related("a", 99).collect()} == pytest.approx(cosines)
    assert m.related("none").count() == 0
