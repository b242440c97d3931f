"""The pipeline's stages against brute force on a small table."""

import random

import corpus_pipeline
from inkwell.llm.queries import ORACLES, QUERIES


def tables(spark, folder):
    r = random.Random(1)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    item = text(2)
    docs, labels = [], []
    for i in range(300):
        good = i % 5 != 4
        body = text(8) if good else "\n".join("|".join(word().upper() for _ in range(12)) + "###" for _ in range(8))
        docs.append([i, body, "en", f"s{i % 3}", len(body)])
        labels.append((i, int(good), 0))
    for i in range(300, 320):
        docs.append([i, docs[i - 300][1].replace("e", "e", 1), "en", "s0", 0])  # exact copies
    for i in range(320, 330):
        docs.append([i, text(3) + "\n" + item + "\n" + text(3), "en", "s1", 0])
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    ids = lambda df: {x["doc_id"] for x in df.select("doc_id").collect()}
    by = dict(corpus_pipeline.STAGES)
    kept = by["quality"](spark, docs, folder)
    assert kept.columns == docs.columns
    bad = {i for i in range(300) if i % 5 == 4} | {i for i in range(300, 320) if (i - 300) % 5 == 4}
    assert ids(kept) == set(range(330)) - bad
    one = by["near_dedup"](spark, kept, folder)
    assert one.columns == docs.columns and ids(one) == ids(kept) - set(range(300, 320))
    clean = by["decontaminate"](spark, one, folder)
    assert ids(clean) == ids(one) - set(range(320, 330))
    mixed = by["mix"](spark, clean, folder)
    assert mixed.columns == docs.columns and ids(mixed) <= ids(clean)
    out = by["tokens"](spark, mixed, folder)
    assert sorted(x["doc_id"] for x in out.collect()) == sorted(x["doc_id"] for x in mixed.collect())
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out.collect()))
    assert len(rows) == 330


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(ORACLES) <= set(QUERIES)
