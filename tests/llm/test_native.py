"""Mixing, sharding, line chunks and sketches: edge cases, and brute force on small tables."""

import hashlib
import random
import zlib

import pytest
from inkwell.llm.linechunks import dedup_lines, line_report
from inkwell.llm.mixing import mix, mixing_report, targets
from inkwell.llm.ring import place, ring, shard_documents, walk
from inkwell.llm.sketch import containment, fingerprint_documents, from_digest, merge, resemblance, with_sketch
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None)[:5] if len(r) == 4 else (r[0], r[1], None, r[2] if len(r) > 2 else None, None) for r in rows], DOCS)


def some(seed=0, n=120, sources="abcd"):
    r = random.Random(seed)
    return [(i, " ".join(r.choice("one two three four five six seven".split()) for _ in range(r.choice((0, 1, 3, 30, 200)))), r.choice(sources)) for i in range(n)]


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (None, "no id here", "b"), (5, "same text", "b"), (5, "same text", "b"), (6, "word " * 30000, None), (7, "x", None)]


# -- mixing -----------------------------------------------------------------------------------------------------------


def test_targets_are_capped_and_reshared(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 90)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in targets(sizes).collect()}
    # weights 1, 2, 3, 1 of 1200: b's 2/7 stops at 30; the rest is shared 1 : 3 : 1
    assert found == {"a": pytest.approx(234), "b": 30, "c": pytest.approx(702), None: pytest.approx(234)}
    assert sum(found.values()) == pytest.approx(1200)


def test_mix_comes_near_its_targets_and_repeats(spark):
    rows = docs(spark, some(n=400))
    one, two = (sorted(map(tuple, mixing_report(rows.repartition(n)).collect())) for n in (1, 5))
    assert one == two
    by = {}
    for (doc_id, _, source), (i, size, source_size, target, taken) in zip(some(n=400), one, strict=True):
        assert doc_id == i and 0 <= taken <= 3 * size
        t = by.setdefault(source, [target, 0, source_size])
        t[1] += taken
    assert all(abs(got - target) <= 0.02 * target for target, got, _ in by.values())
    mixed = mix(rows)
    assert mixed.columns == rows.columns
    assert mixed.where("text <> ''").count() == sum(r[4] // r[1] for r in one if r[1])


def test_mix_of_odd_rows(spark):
    got = mixing_report(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got} == {0, 1, 2, 3, 30000}
    assert mixing_report(docs(spark, ODD[:2])).agg(F.sum("taken")).first()[0] == 0
    assert mixing_report(docs(spark, []).where("false")).count() == 0
    clash = docs(spark, some(n=30)).withColumns({c: F.lit(7) for c in ("size", "rest", "q", "cell", "copies", "target", "doc", "copy")})
    out = mix(clash)
    assert out.columns == clash.columns and out.where("q <> 7 or doc <> 7").count() == 0


def near_targets(got, part=0.01):
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        by.setdefault(r["target"], []).append(r["taken"])
    return all(abs(sum(taken) - target) <= part * target for target, taken in by.items())


def test_mix_with_null_equal_and_repeated_ids(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randrange(1, 60))) for _ in range(600)]
    rows = [(None if i % 2 else 7, t, "ab"[i % 3 == 0]) for i, t in enumerate(texts)]
    assert near_targets(mixing_report(docs(spark, rows)).collect())
    same = [(None, "one text for all of them", "ab"[i % 3 == 0]) for i in range(900)]
    for table in (same, same + rows):
        got = mixing_report(docs(spark, table).repartition(5)).collect()
        assert len(got) == len(table) and near_targets(got)
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing_report(docs(spark, table)).collect()), key=str)
    assert mix(docs(spark, same)).count() == sum(x["taken"] // x["size"] for x in mixing_report(docs(spark, same)).collect())


def test_long_documents_are_likelier_to_be_taken(spark):
    """Inclusion frequencies over seeds follow the probabilities of the length classes."""
    rows = [(i, "w " * (1 << i % 4 * 2), "ab"[i % 5 == 0]) for i in range(1600)]
    taken, tried, expected = {}, {}, {}
    from inkwell.llm.mixing import mixing_plan, sized

    table = docs(spark, rows).cache()
    plan = {r["source"]: r for r in mixing_plan(table.select(*sized(table))).collect()}
    for seed in range(3):
        for r in mixing_report(table, seed=seed).collect():
            source = "ab"[r["doc_id"] % 5 == 0]
            if plan[source]["p"]:
                at = source, r["size"].bit_length()
                taken[at] = taken.get(at, 0) + r["taken"] // r["size"] - plan[source]["copies"]
                tried[at] = tried.get(at, 0) + 1
                expected[at] = plan[source]["p"][at[1]]
    assert len({round(p, 6) for p in expected.values()}) > 2
    for at, n in tried.items():
        error = (expected[at] * (1 - expected[at]) / n) ** 0.5
        assert abs(taken[at] / n - expected[at]) <= 5 * error + 0.02, at


def test_mix_equals_its_sql(spark, tmp_path):
    import duckdb
    from inkwell.llm.queries import ORACLES

    r = random.Random(5)
    rows = [(None if i % 7 == 0 else i % 250, " ".join(r.choice("abc") for _ in range(r.choice((0, 1, 2, 3, 90)))), r.choice(("a", "b", None))) for i in range(500)]
    docs(spark, rows).write.parquet(str(tmp_path / "d"))
    documents = duckdb.read_parquet(str(tmp_path / "d/*.parquet"))  # noqa: F841
    want = [tuple(x) for x in duckdb.sql(ORACLES["op6_mixing"]).fetchall()]
    got = [tuple(x) for x in mixing_report(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# -- sharding ---------------------------------------------------------------------------------------------------------


def test_ring_walk_visits_every_shard_once():
    _, owners = ring(5)
    assert all(sorted(w) == list(range(5)) and w[0] == owners[a] for a, w in enumerate(walk(owners, 5)))


def test_overflow_goes_clockwise():
    import numpy as np

    route = np.array([[2, 0, 1], [0, 1, 2]])
    assert place([(0, 4, 8), (1, 3, 3)], np.arange(2), route, 5) == [(0, 0, 2, 2), (0, 2, 2, 0), (1, 0, 1, 0), (1, 1, 2, 1)]
    assert place([(0, 1, 9)], np.arange(1), route, 5) == [(0, 0, 1, 0)]


def test_shards_are_even_and_slots_gapless(spark):
    r = random.Random(4)
    rows = [(i, "x" * int(r.paretovariate(1.2) * 20)) for i in range(3000)] + [(5000 + i, "copy of one text") for i in range(1500)]
    got = shard_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    load, slots = {}, {}
    for x in got:
        assert x["size"] == len(text[x["doc_id"]]) + 1 and x["text_crc32"] == zlib.crc32(text[x["doc_id"]].encode()) and x["law"] == "bytes" and x["grown_shard"] is None
        load[x["shard"]] = load.get(x["shard"], 0) + x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert len(load) == 8 and max(load.values()) <= 1.03 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {x["doc_id"]: x["shard"] for x in shard_documents(docs(spark, rows).repartition(7)).collect()}
    assert sum(again[x["doc_id"]] != x["shard"] for x in got) <= 16  # but for rows of a bucket that is cut


def test_sharding_by_brute_force(spark):
    """Where nothing overflows a text's rows are in the shard after its hash; of the others each is in a later one of its route."""
    import numpy as np

    rows = [(i, f"text {i % 700} " * (i % 17)) for i in range(2000)]
    places, owners = ring(8)
    routes, table = walk(owners, 8), docs(spark, rows)
    arcs = {r["doc_id"]: int(np.searchsorted(places, r["h"])) % len(places) for r in table.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    got = {r["doc_id"]: r["shard"] for r in shard_documents(table).collect()}
    load = np.zeros(8)
    for i, text in rows:
        load[got[i]] += len(text) + 1
    full = load >= load.mean() * 0.99
    for i, s in got.items():
        route = routes[arcs[i]].tolist()
        assert all(full[x] for x in route[: route.index(s)])
    loose = {r["doc_id"]: r["shard"] for r in shard_documents(table, slack=9.0).collect()}
    assert all(owners[arcs[i]] == s for i, s in loose.items())
    assert sum(loose[i] == s for i, s in got.items()) > 0.5 * len(rows)


def test_equal_rows_spread_over_shards(spark):
    for table in ([(None, "one text")] * 600, [(3, "w" * (i % 9)) for i in range(900)] + [(None, "x" * 40)] * 300):
        got = shard_documents(docs(spark, table).repartition(5)).collect()
        load, slots = {}, {}
        for x in got:
            load[x["shard"]] = load.get(x["shard"], 0) + x["size"]
            slots.setdefault(x["shard"], []).append(x["slot"])
        assert len(got) == len(table) and len(load) == 8 and max(load.values()) <= 1.03 * min(load.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_of_odd_rows(spark):
    got = shard_documents(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {x["size"] for x in got if x["doc_id"] in (1, 2)} == {1}
    assert shard_documents(docs(spark, []).where("false")).count() == 0


# -- line chunks ------------------------------------------------------------------------------------------------------


def passage(r, lines, words=12):
    return [" ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(words)) for _ in range(lines)]


def test_repeated_passages_go_and_clean_documents_stay(spark):
    r = random.Random(7)
    shared = passage(r, 8)
    rows, own = [], {}
    for i in range(40):
        before, after = passage(r, r.randint(2, 6)), passage(r, r.randint(2, 6))
        own[i] = before + after
        rows.append((i, "\n".join(before + (shared if i % 4 == 0 else []) + after)))
    got = {x["doc_id"]: x for x in line_report(docs(spark, rows)).collect()}
    assert got[0]["text"] == rows[0][1]  # the first place
    removed = 0
    for i in range(1, 40):
        kept = got[i]["text"].split("\n")
        assert [x for x in kept if x not in shared] == own[i]  # no line of its own went
        assert got[i]["n_lines"] - got[i]["n_removed"] == len(kept)
        removed += got[i]["n_removed"]
        assert i % 4 == 0 or got[i]["n_removed"] == 0
    assert removed >= 9 * 8 * 0.75


def test_insertions_do_not_shift_chunks(spark):
    r = random.Random(8)
    lines = passage(r, 40)
    shifted = [*passage(r, 1), *lines[:20], *passage(r, 1), *lines[20:]]
    got = {x["doc_id"]: x for x in line_report(docs(spark, [(1, "\n".join(lines)), (2, "\n".join(shifted))])).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] >= 36


def test_short_passages_in_unrelated_documents_go(spark):
    r = random.Random(11)
    # words a line; the last ones have lines at an end that no run from the other end reaches
    shapes = [(51,), (30,), (26, 25), (40, 11), (17, 17, 17), (13, 13, 13, 13), (51, 3), (3, 51), (20, 1, 30), (1, 51, 1, 2)]
    rows, own, shared = [], {}, {}
    for k, shape in enumerate(shapes * 4):
        shared[k] = [passage(r, 1, n)[0] for n in shape]
        for i in (1000 + k, 2000 + k):
            before, after = passage(r, r.randint(1, 4)), passage(r, r.randint(1, 4))
            own[i] = before, after
            rows.append((i, "\n".join(before + shared[k] + after)))
    got = {x["doc_id"]: x for x in line_report(docs(spark, rows)).collect()}
    for k, shape in enumerate(shapes * 4):
        assert got[1000 + k]["n_removed"] == 0
        before, after = own[2000 + k]
        if shape == (30,):  # no more than 50 words, under 256 bytes
            assert got[2000 + k]["n_removed"] == 0
        else:
            assert got[2000 + k]["text"].split("\n") == before + after, shape


def test_runs_that_overlap_their_first_place_stay(spark):
    line = passage(random.Random(12), 1, 20)[0]
    for n, kept in ((5, 5), (6, 3), (7, 3)):  # three lines are the shortest run
        got = dedup_lines(docs(spark, [(1, "\n".join([line] * n))])).first()
        assert got["text"].split("\n") == [line] * kept, n


def test_line_chunks_against_brute_force(spark):
    """Lines go only within a run of several lines or over 50 words that stands elsewhere earlier; all runs over 50 words go."""
    r = random.Random(15)
    pool = [passage(r, r.randint(1, 6), r.choice((3, 12, 30))) for _ in range(12)]
    rows = []
    for i in range(50):
        parts = [r.choice(pool) if r.random() < 0.5 else passage(r, r.randint(1, 2), r.choice((2, 9))) for _ in range(r.randint(1, 5))]
        rows.append((i, "\n".join(x for part in parts for x in part)))
    got = {x["doc_id"]: x["text"] for x in line_report(docs(spark, rows)).collect()}
    lines = [t.split("\n") for _, t in rows]
    size = lambda run: sum(len(x.split()) for x in run)
    first: dict[tuple, int] = {}
    for i, x in enumerate(lines):
        must, may = [False] * len(x), [False] * len(x)
        runs = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)]
        for a, b in runs:
            run = tuple(x[a:b])
            if first.get(run, i) < i or sum(lines[i][c : c + b - a] == x[a:b] for c in range(a)):
                if size(run) > 50 or b - a > 1:
                    may[a:b] = [True] * (b - a)
                if size(run) > 50 and first.get(run, i) < i:
                    must[a:b] = [True] * (b - a)
        for a, b in runs:
            first.setdefault(tuple(x[a:b]), i)
        kept, at = (got[i].split("\n") if got[i] else []), 0
        gone = []
        for k, line in enumerate(x):  # all lines are kept or gone in order
            if at < len(kept) and kept[at] == line:
                at += 1
                gone.append(False)
            else:
                gone.append(True)
        assert at == len(kept)
        left = [line for line, g in zip(x, gone, strict=True) if not g]
        assert left == kept
        want = [line for line, m in zip(x, must, strict=True) if not m]
        assert len(kept) <= len(want) and all(kept.count(z) >= sum(z == y and not m for y, m in zip(x, may, strict=True)) for z in set(x))
    assert sum(len(t) for t in got.values()) < sum(len(t) for _, t in rows)


def test_line_chunks_of_odd_rows(spark):
    rows = docs(spark, ODD).withColumns({c: F.lit(3) for c in ("lines", "gone", "kept", "th", "first", "last", "h")})
    got = dedup_lines(rows)
    assert got.columns == [*rows.columns, "dedup_lines", "dedup_removed"]
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in got.collect()) == sorted((x["doc_id"] or 0, x["text"] or "") for x in rows.collect())
    assert line_report(docs(spark, []).where("false")).count() == 0


# -- sketches ---------------------------------------------------------------------------------------------------------


def shingles(text, width=5):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_sketch_estimates(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(5000)}" for _ in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    df = spark.createDataFrame([(a, b, " ".join(words))], "a string, b string, c string")
    for c in "abc":
        df = with_sketch(df, c, f"s{c}")
    row = df.select(resemblance(F.col("sa"), F.col("sb")).alias("j"), containment(F.col("sa"), F.col("sc")).alias("c")).first()
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs(row["j"] - true) < 0.15 and row["c"] > 0.85


def test_parts_merge_to_the_whole(spark):
    df = spark.createDataFrame([("a b c d e f g", "d e f g h i j k", "a b c d e f g h i j k")], "a string, b string, c string")
    for c in "abc":
        df = with_sketch(df, c, f"s{c}")
    assert df.select(merge(F.col("sa"), F.col("sb")) == F.col("sc")).first()[0]


def test_fingerprints_against_brute_force(spark):
    rows = some(3, 60) + [(500 + i, f"alpha beta é {i} " * 10) for i in range(20)]
    text = dict((i, t) for i, t, *_ in rows)
    got = {x["doc_id"]: x for x in fingerprint_documents(docs(spark, [(i, t) for i, t in text.items()])).collect()}
    ids = sorted(text)
    for k, i in enumerate(ids):
        t, n = text[i], text[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", n)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got[i][name] - true) < (0.2 if len(a | b) > 128 else 1e-9), (i, name)
    seen = {}
    for i in ids:
        assert seen.setdefault(text[i], got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_neighbours_over_many_ranges(spark, monkeypatch):
    import inkwell.llm.sketch as sketch

    monkeypatch.setattr(sketch, "ROWS", 3)
    text = {i * i - 50: f"t{i} " * 8 for i in range(40)}
    got = {x["doc_id"]: x for x in fingerprint_documents(docs(spark, list(text.items()))).collect()}
    ids = sorted(text)
    for k, i in enumerate(ids):
        t, n = text[i], text[ids[(k + 1) % len(ids)]]
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()


def test_digest_round_trip_and_odd_rows(spark):
    got = fingerprint_documents(docs(spark, ODD).withColumns({c: F.lit(1) for c in ("sketch", "mark", "edited")}))
    rows = got.collect()
    assert len(rows) == len(ODD)
    assert {x["fingerprint"] for x in rows if x["doc_id"] in (1, 2, 3)} == {""}
    assert len({x["fingerprint"] for x in rows if x["doc_id"] == 5}) == 1
    assert got.where(F.size(from_digest(F.col("fingerprint"))) != F.length("fingerprint") / 10).count() == 0
    assert fingerprint_documents(docs(spark, []).where("false")).count() == 0
    alone = fingerprint_documents(docs(spark, [(1, "abcdefgh")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
