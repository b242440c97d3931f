import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from inkwell.operators import codecs
from inkwell.operators.codecs import CODECS
from inkwell.operators.index import packed
from pyspark.sql import functions as F

P, T = [34, 67, 89, 454, 2345738], [12, 10, 3, 4, 1]
GOLDEN = {
    "vbe": ("a2a19602ed010f12c4", "8c8a838481"),
    "elias": ("0000005b0460882e016e0000047928a0", "0000001b1a2c8540"),
    "eg-delta": ("0000004f98730a57896e8587928a", "0000001b1a2c8540"),
    "vbe-eg-tf": ("a2a19602ed010f12c4", "0000001b1a2c8540"),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_bytes(name):
    c = CODECS[name]
    assert (c.encode(P).hex(), c.encode_tf(T).hex()) == GOLDEN[name]


def test_standard_takes_eight_bytes():
    assert len(CODECS["standard"].encode(P)) == 40


@pytest.mark.parametrize("name", CODECS)
@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 1 << 40), max_size=60).map(sorted), tfs=st.lists(st.integers(1, 1 << 20), max_size=60))
def test_round_trip(name, ids, tfs):
    c = CODECS[name]
    assert c.decode(c.encode(ids)) == ids and c.decode_tf(c.encode_tf(tfs)) == tfs


@pytest.mark.parametrize("name", CODECS)
def test_empty_is_empty(name):
    c = CODECS[name]
    assert c.encode([]) == c.encode_tf([]) == b"" and c.decode(b"") == c.decode_tf(b"") == []


def test_sizes():
    ids = list(range(1, 200, 3))
    assert {n: len(CODECS[n].encode(ids)) for n in ("standard", "vbe", "elias", "eg-delta")} == {"standard": 536, "vbe": 67, "elias": 46, "eg-delta": 54}


def test_codes():
    assert [codecs.gamma(x) for x in (1, 2, 3, 4, 9, 16, 17)] == ["1", "010", "011", "00100", "0001001", "000010000", "000010001"]
    assert [codecs.delta(x) for x in (1, 2, 3, 4, 9, 16, 17)] == ["1", "0100", "0101", "01100", "00100001", "001010000", "001010001"]


def test_size_expressions_equal_bytes_made(spark):
    r = random.Random(5)
    rows = [(t, d, r.choice((1, 1, 2, 40, 5000))) for t in "abc" for d in sorted(r.sample(range(100000), 50))]
    postings = spark.createDataFrame(rows, "term string, doc_id long, tf int")
    said = {(x["codec"], x["term"]): x["bytes"] for x in codecs.sizes(postings).collect()}
    for row in packed(postings).collect():
        for name, c in CODECS.items():
            assert said[name, row["term"]] == len(c.encode([x["doc_id"] for x in row["list"]])) + len(c.encode_tf([x["tf"] for x in row["list"]]))
    assert {x["codec"]: x["wrong"] for x in codecs.roundtrip(postings).collect()} == dict.fromkeys(CODECS, 0)


def test_gaps_and_synthetic(spark):
    rows = codecs.synthetic_postings(spark, 20)
    assert rows.groupBy("term").count().count() == 20
    gaps = codecs.with_gaps(rows)
    assert gaps.agg(F.min("gap"), F.max("gap")).first()[0] >= 1 and gaps.where("gap > 50").count() == 0


def test_gaps_over_ranges(spark):
    rows = codecs.synthetic_postings(spark, 30)
    want = sorted(map(tuple, codecs.with_gaps(rows).collect()))
    assert sorted(map(tuple, codecs.with_gaps(rows, 16).collect())) == want
    first = {}
    for term, doc_id, _, gap in want:
        assert gap == doc_id - first.get(term, 0)
        first[term] = doc_id
    assert {x["wrong"] for x in codecs.roundtrip(rows, chunk=64).collect()} == {0}


def test_speeds():
    rows = codecs.speeds([(P, T)])
    assert [r["codec"] for r in rows] == list(CODECS) and all(r["same"] for r in rows) and rows[0]["ratio"] == 1
