"""Language ID, line CRF, decontamination, Re-Pair and personal data."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from inkwell.llm import pii, qgrams, repair
from inkwell.llm.langid import Scorer, Trie, blocks, expected, forward, identify, train, vocabulary
from inkwell.llm.linecrf import LineCRF, good_documents, line_features, marginals, quality_scores
from inkwell.llm.shared import connected_components
from inkwell.llm.simhash import BKTree, distances, forest, near_duplicates, near_fingerprints, shingle_hashes, simhash_components
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, "no id here at all", "en", None, 5), (5, "same text", "en", "b", 9), (5, "same text", "en", "b", 9), (6, "word " * 30000, "en", None, None)]


def docs(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows], DOCS)


def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(1) for c in ("score", "fp", "keys", "h", "label", "quality", "held_out")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- language ID ------------------------------------------------------------------------------------------------------


def segmentations(word, pieces):
    if not word:
        return [[]]
    return [[p, *rest] for p in pieces if word.startswith(p) for rest in segmentations(word[len(p) :], pieces)]


def test_forward_sums_all_segmentations_and_em_counts_match():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"bb"]
    trie, r = Trie(pieces), np.random.default_rng(1)
    p = r.random((len(pieces), 2))
    words = [b"a", b"abab", b"bbaab", b"abababab", b"b"]
    for w, got in zip(words, forward(trie, words, p), strict=True):
        for k in range(2):
            assert np.exp(got[k]) == pytest.approx(sum(np.prod([p[pieces.index(x), k] for x in s]) for s in segmentations(w, pieces)))
    weight = np.arange(1.0, 6.0)
    truth = np.zeros(len(pieces))
    for w, n in zip(words, weight, strict=True):
        ways = segmentations(w, pieces)
        odds = np.array([np.prod([p[pieces.index(x), 0] for x in s]) for s in ways])
        for s, o in zip(ways, odds / odds.sum(), strict=True):
            for x in s:
                truth[pieces.index(x)] += n * o
    assert np.allclose(expected(trie, words, weight, p[:, 0]), truth)


def test_training_tells_languages_apart():
    pieces = vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert {bytes([b]) for b in range(256)} <= set(pieces)
    langs, p = train({"x": {b" abba": 5, b" baba": 3}, "y": {b" nino": 4, b" inni": 2}}, pieces)
    assert langs == ["x", "y"] and np.allclose(p.sum(axis=0), 1)
    a, b = forward(Trie(pieces), [b" abab", b" onin"], p)
    assert a[0] > a[1] and b[1] > b[0]


def test_blocks():
    assert blocks("Ab, cd2é!") == [b" ab", b" cd", b" \xc3\xa9"]
    assert blocks("x" * 1000) == [b" " + b"x" * 1000]


def test_long_words_of_unseen_scripts_have_scores():
    """Odds of a letter down to 1e-9, words of up to 30,000 letters: no sum underflows, and posteriors are in 0 to 1."""
    pieces = vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    r = random.Random(1)
    words = {lang: {(" " + "".join(r.choice(s) for _ in range(r.randrange(1, 4)))).encode(): r.randrange(1, 30_000) for _ in range(2500)} for lang, s in (("x", ["ka", "lo", "mi", "su"]), ("y", ["tsch", "er", "ung", "bei"]))}
    words["x"][(" " + "kalo" * 40).encode()] = 5
    langs, p = train(words, pieces)
    assert np.allclose(p.sum(axis=0), 1) and p.min() < 1e-8
    scorer = Scorer(langs, pieces, p)
    texts = ["漢" * 200, "語" * 30_000, "".join(chr(0x0E01 + i % 40) for i in range(300)), "ж" * 41, "kalo" * 900, "erung" * 900, "zzzz qqqq", "\U0001d51e" * 100]
    lang, score = scorer.predict(texts)
    assert all(0.5 <= x <= 1 for x in score) and lang[4:6] == ["x", "y"]
    # scaled sums equal those of logs, a letter at a time
    odds = {w: k for k, w in enumerate(pieces)}
    word = " 漢字かな".encode() * 9
    logs = [np.zeros(2)] + [np.full(2, -np.inf)] * len(word)
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in odds:
                logs[j] = np.logaddexp(logs[j], logs[i] + np.log(p[odds[word[i:j]]]))
    assert np.allclose(forward(Trie(pieces), [word, b" a"], p)[0], logs[-1])


def test_identify(spark):
    r = random.Random(2)
    make = lambda syllables: " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(40))
    words = {"aa": ["ka", "lo", "mi"], "bb": ["tsch", "er", "ung"]}
    rows = [(i, make(words[lang]), lang) for i in range(120) for lang in [["aa", "bb"][i % 2]]] + [(900, "123 !?", "aa"), (901, None, "bb"), (902, "", None)]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = {x["doc_id"]: x for x in identify(docs(spark, rows), path).collect()}
    for i, _, lang in rows[:120]:
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert {(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)} == {("und", 0.0)}
    flipped = [(i, t, lang if zlib.crc32(str(i).encode()) % 3 != 1 else "zz") for i, t, lang in rows]
    assert {x["doc_id"]: x["lang_pred"] for x in identify(docs(spark, flipped), path).collect()} == {i: x["lang_pred"] for i, x in got.items()}
    assert identify(odd(spark), path).count() == len(ODD) and identify(empty(spark), path).count() == 0


# -- SimHash ----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, width=3):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_shingle_hash_is_that_of_spark(spark):
    text = "The Quick  brown\tfox É jumps"
    row = spark.sql("select xxhash64('quick brown fox') a").first()
    assert row["a"] & (2**64 - 1) in shingle_hashes(text.encode(), 3).tolist()


def test_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(5)
    x = np.unique(r.integers(0, 64, 900, dtype=np.uint64) * np.uint64(0x0101010101010101) ^ (np.uint64(1) << r.integers(0, 64, 900, dtype=np.uint64)))[:, None]
    tree = BKTree(np.concatenate((x, x[:50], x[:9])))  # equal rows as well
    x = tree.words
    who, found = tree.within(x[::17], 2)
    for k, q in enumerate(range(0, len(x), 17)):
        assert sorted(found[who == k].tolist()) == np.flatnonzero(distances(x, x[q]) <= 2).tolist()
    wide = np.random.default_rng(6).integers(0, 2**63, (300, 4), dtype=np.int64).astype(np.uint64)
    who, found = BKTree(wide).within(wide[:20], 118)
    assert sorted(zip(who.tolist(), found.tolist(), strict=True)) == [(i, j) for i in range(20) for j in np.flatnonzero(distances(wide, wide[i]) <= 118).tolist()]
    assert not len(BKTree(x[:0]).within(x[:3], 2)[0])


def test_search_follows_few_edges():
    """As many fingerprints as a shard holds: a search visits a few hundredths of the tree, by edges of distance-keyed children."""
    x = np.unique(np.random.default_rng(7).integers(0, 2**63, 4096, dtype=np.int64).astype(np.uint64))[:, None]
    np.random.default_rng(8).shuffle(x)
    tree = BKTree(x)
    tree.within(x[:512], 2)
    assert tree.followed > 512 * 20 and tree.skipped > tree.followed and tree.followed < 512 * len(x) * 0.05
    assert len(tree.code) == len(x) - 1 and (tree.code % tree.keys > 0).all()


def test_components_equal_brute_force(spark):
    r = random.Random(6)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice((40, 200, 400)))] for _ in range(25)]
    rows = []
    for i in range(160):
        words = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2))):
            words[r.randrange(len(words))] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "one"), (303, "ONE"), (304, "one two")]
    got = {x["doc_id"]: x for x in simhash_components(docs(spark, rows)).collect()}
    fp = [brute_fingerprint(t) for _, t in rows]
    truth = components(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    for (i, _), f, c in zip(rows, fp, truth, strict=True):
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == rows[c][0]


def test_cut_buckets_lose_no_link(spark, monkeypatch):
    import inkwell.llm.simhash as simhash

    monkeypatch.setattr(simhash, "SHARD", 8)
    r = random.Random(3)
    x = sorted({0x1234 << 40 ^ sum(1 << b for b in r.sample(range(24), r.randint(0, 3))) for _ in range(150)})
    links = near_fingerprints(spark.createDataFrame([([v],) for v in x], "fp array<long>"), 2).collect()
    at = {v: i for i, v in enumerate(x)}
    pairs = {(at[row["a"][0]], at[row["b"][0]]) for row in links}
    assert all((x[i] ^ x[j]).bit_count() <= 2 for i, j in pairs)
    assert components(len(x), lambda i, j: (i, j) in pairs or (j, i) in pairs) == components(len(x), lambda i, j: (x[i] ^ x[j]).bit_count() <= 2)


def test_forest_between_shards():
    r = np.random.default_rng(2)
    x = np.unique(r.integers(0, 2**10, 200, dtype=np.uint64))[:, None]
    side = r.random(len(x)) < 0.5
    links = forest(x, side, ~side, 1)
    assert len(links) < len(x) and all(side[j] and not side[i] and distances(x[i : i + 1], x[j])[0] <= 1 for i, j in links)


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(2001, 2200)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    linked = {frozenset(e) for e in edges}
    truth = components(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in linked)
    assert got == {n: nodes[c] for n, c in zip(nodes, truth, strict=True)}


def test_near_duplicates(spark):
    r = random.Random(8)
    rows, group = [], {}
    for g in range(20):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice((120, 300, 600)))]
        for k in range(4):
            copy = list(words)
            for _ in range(0 if k < 2 else len(words) // 90):  # Jaccard similarity of about 0.9
                copy[r.randrange(len(copy))] = f"x{r.randrange(99999)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(docs(spark, rows)).collect()}
    assert all(got[i] == 4 * g for i, g in group.items())
    assert near_duplicates(odd(spark)).count() == len(ODD) and near_duplicates(empty(spark)).count() == 0
    assert simhash_components(odd(spark)).count() == len(ODD) and simhash_components(empty(spark)).count() == 0


def test_near_duplicates_equal_exact_classes(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    sets, rows, links, close = {}, [], [], 0
    for family in range(60):
        base, mine = [word() for _ in range(r.choice((8, 9, 40, 120)))], []
        for k in range(8):
            w = list(base)
            if k % 2:  # longer by a little
                w += [word() for _ in range(r.randint(1, max(1, len(w) // 3)))]
            for _ in range(r.randint(0, len(w) // 30) if k else 0):
                w[r.randrange(len(w))] = word()
            i = family * 8 + k
            rows.append((i, " ".join(w)))
            sets[i] = set(shingle_hashes(rows[-1][1].encode(), 5).tolist())
            for other in mine:
                j = len(sets[i] & sets[other]) / len(sets[i] | sets[other])
                close += 0.7 <= j < 0.8
                if j >= 0.8:
                    links.append((i, other))
            mine.append(i)
    root = {i: i for i in sets}
    for _ in sets:
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    assert len(links) > 100 and close > 50
    assert {x["doc_id"]: x["component_id"] for x in near_duplicates(docs(spark, rows)).collect()} == root


# -- line CRF ---------------------------------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    n = [1, 4, 3]
    node, edge = r.normal(size=(3, 4, 2)), r.normal(size=(2, 2))
    real = np.arange(4) < np.array(n)[:, None]
    got, pairs = marginals(node, real, edge)
    total = np.zeros((2, 2))
    for d in range(3):
        weight, seen, two = 0.0, np.zeros((4, 2)), np.zeros((2, 2))
        for code in range(2 ** n[d]):
            y = [code >> t & 1 for t in range(n[d])]
            w = np.exp(sum(node[d, t, y[t]] for t in range(n[d])) + sum(edge[y[t - 1], y[t]] for t in range(1, n[d])))
            weight += w
            for t in range(n[d]):
                seen[t, y[t]] += w
            for t in range(1, n[d]):
                two[y[t - 1], y[t]] += w
        assert np.allclose(got[d][: n[d]], (seen / weight)[: n[d]])
        total += two / weight
    assert np.allclose(pairs, total)


def make_lines(r, good):
    line = " ".join("".join(r.choice("etaoin") for _ in range(5)) for _ in range(12)) + "."
    return line if good else " | ".join(line.upper().split()) + " ###"


def test_quality_of_lines_and_held_out_documents(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = r.random() < 0.7
        lines = [make_lines(r, good or r.random() < 0.3) for _ in range(6)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality_scores(docs(spark, rows), table).collect()}
    held = [i for i, q, _ in labels if got[i]["held_out"]]
    assert {i for i in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.95 * len(held)
    assert all(x["predicted"] == (x["score"] >= 0.3) and 0 <= x["score"] <= 1 for x in got.values())
    other = spark.createDataFrame([(i, 1 - q if i in held else q, 0) for i, q, _ in labels], table.schema)
    assert {x["doc_id"]: x["score"] for x in quality_scores(docs(spark, rows), other).collect()} == {i: x["score"] for i, x in got.items()}
    assert quality_scores(odd(spark), table).count() == len(ODD)
    assert {x["score"] for x in quality_scores(docs(spark, rows[:3]), table.where("false")).collect()} == {1.0}
    assert quality_scores(empty(spark), table).count() == 0


def test_good_documents_of_odd_rows(spark):
    r = random.Random(6)
    rows = [(i, "\n".join(make_lines(r, i % 3 > 0) for _ in range(5))) for i in range(60)] + [(3, None), (None, "x"), (4, "word " * 60_000), (4, "word " * 60_000)]
    table = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    clash = docs(spark, rows).withColumns({c: F.lit(1) for c in ("__score", "__predicted", "score", "predicted", "held_out", "doc", "quality")})
    scores = {(x["doc_id"], x["predicted"]) for x in quality_scores(clash, table).collect()}
    kept = good_documents(clash, table)
    assert kept.columns == clash.columns and {x["doc_id"] for x in kept.collect()} == {i for i, p in scores if p}
    assert sum(x["doc_id"] == 4 and len(x["text"]) > 9999 for x in kept.collect()) in (0, 2)
    assert good_documents(empty(spark), table).count() == 0


def test_long_documents_count_by_length():
    model = LineCRF(line_features([b"a"])[0].shape[1])
    model.weight[:] = 0
    assert model.documents(*line_features([b"a\nbb\n\nccc", b""])) == pytest.approx([0.5, 0.5])


# -- decontamination --------------------------------------------------------------------------------------------------


def distance(a, b):
    """Least edits of a against any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return min(row)


def test_banded_alignment_equals_full_alignment():
    r = random.Random(4)
    for _ in range(60):
        a = bytes(r.choice(b"abcd") for _ in range(40))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice(([], [97], [98, 99]))
        text = b"x" * 7 + bytes(b) + b"y" * 9
        assert min(5, qgrams.banded(a, text, 4, 7, 5)) == min(5, distance(a, text))


def test_leaks_against_brute_force():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.choice((6, 20, 50))))) for i in range(25)]
    index = qgrams.Index(items)
    for i, text in items:
        part = text[: max(60, len(text))]
        letters = list(part)
        for _ in range(int(0.04 * len(letters))):
            letters[r.randrange(len(letters))] = r.choice("xyz")
        own = " ".join(word() for _ in range(200))
        around = own[:600] + " " + "".join(letters).upper().replace(" ", "!! ") + " " + own[600:]
        assert i in {x for x, _, _ in index.leaks(around)}
        assert index.leaks(own) == []
        t = qgrams.normal(around)
        for p, edits in zip(index.passages, index.edits, strict=True):
            if distance(p, t) <= edits:
                assert index.item[index.passages.index(p)] in {x for x, _, _ in index.leaks(around)}
                break


def test_every_length_is_found_at_its_full_budget():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    for m in range(1, 121):
        for _ in range(6):
            letters = "".join(r.choice("qrstuvwxyz") for _ in range(m))
            index = qgrams.Index([(7, " ".join(re.findall(".{1,5}", letters)))])
            b, room = list(letters), min(m, qgrams.PASSAGE)
            one_way = r.random() < 0.4
            for _ in range(int(room * qgrams.RATE)):
                k = r.randrange(min(room, len(b)))
                b[k : k + 1] = [] if one_way else r.choice(([], ["#"], [b[k], "7"], ["7", b[k]], ["8"]))
            b = "".join(b).replace("#", "9")
            own = " ".join(word() for _ in range(60))
            where = r.choice((0, 150, len(own)))
            text = own[:where] + " " + b + " " + own[where:]
            assert {x for x, _, _ in index.leaks(text)} == {7}, (m, letters, b)
            assert index.leaks(own) == []
    assert qgrams.Index([(1, "yes")]).leaks("no yesterday") == [] and qgrams.Index([(1, "Yes, no")]).leaks("well YES! no.") == [(1, 4, 9)]


def test_found_equals_distance():
    """Few letters, so that much is near: an item is found if and only if a passage is within its edits."""
    r = random.Random(13)
    for _ in range(150):
        items = [(i, "".join(r.choice("ab") for _ in range(r.choice((8, 9, 12, 20, 30, 41, 64, 90))))) for i in range(4)]
        index = qgrams.Index(items)
        text = "".join(r.choice("ab") for _ in range(120))
        near = {index.item[k] for k, p in enumerate(index.passages) if distance(p, text.encode()) <= index.edits[k]}
        assert {x for x, _, _ in index.leaks(text)} == near


def test_benchmark_in_blocks(spark, monkeypatch):
    r = random.Random(14)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = docs(spark, [(i % 5, f"so {texts[i % 12]} and {texts[(i * 5) % 12]}") for i in range(20)] + [(None, texts[3]), (9, "clean")])
    one, kept = (sorted(map(str, x.collect())) for x in (qgrams.find_leaks(rows, bench), qgrams.decontaminate(rows, bench)))
    monkeypatch.setattr(qgrams, "MOST", 500)
    assert sorted(map(str, qgrams.find_leaks(rows, bench).collect())) == one and len(one) == 21
    assert sorted(map(str, qgrams.decontaminate(rows, bench).collect())) == kept and len(kept) == 1


def test_decontaminate_tables(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again"), (2, None), (None, "x" * 90), (3, "short"), (4, "")], "item_id long, text string")
    rows = docs(spark, [(1, "so THE QUICK, brown fox jumps over the lazy dog again and again, he said"), (2, "clean"), (3, None), (4, "")]).withColumn("item_id", F.lit(5))
    assert [(x["doc_id"], list(x["item_ids"])) for x in qgrams.find_leaks(rows, bench).collect()] == [(1, [1])]
    kept = qgrams.decontaminate(rows, bench)
    assert kept.columns == rows.columns and {x["doc_id"] for x in kept.collect()} == {2, 3, 4}
    assert qgrams.find_leaks(odd(spark), bench).count() == 0 and qgrams.find_leaks(empty(spark), bench).count() == 0
    assert qgrams.find_leaks(rows, bench.where("false")).count() == 0


# -- Re-Pair ----------------------------------------------------------------------------------------------------------


END = 50


def packed(ids):
    joined = np.concatenate([np.array([*x, END], np.uint32) for x in ids])
    return repair.Block(repair.pack(list(range(len(ids))), joined, np.array([len(x) + 1 for x in ids]), END))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=80), min_size=1, max_size=12))
def test_blocks_round_trip(ids):
    block = packed(ids)
    assert [x.tolist() for x in block.decode_all()] == [[*x, 0] for x in ids]
    assert [block.decode(i).tolist() for i in range(len(ids))] == [[*x, 0] for x in ids]


def test_rules_shorten_repetitive_blocks():
    block = packed([[5, 6, 7, 8] * 500] * 3)
    assert len(block.seq) + len(block.rules) < 60 and block.lengths.max() > 100


def apart(seq, end):
    """How often each pair occurs, places of a run of one symbol apart from each other."""
    count, last = {}, {}
    for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
        if end not in pair and last.get(pair, -2) != i - 1:
            count[pair], last[pair] = count.get(pair, 0) + 1, i
    return count


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6) | st.just(END), max_size=600), st.integers(1, 4))
def test_no_frequent_pair_remains(ids, times):
    seq, rules, lengths = repair.compress(np.array(ids * times, np.uint32), END)
    assert max(apart(seq.tolist(), END).values(), default=0) < repair.LEAST
    whole = [END] * END + [1] + [0] * len(rules)
    for r, (x, y) in enumerate(rules.tolist()):
        assert max(x, y) < END + 1 + r and END not in (x, y)
        whole[END + 1 + r] = sum(lengths[z - END - 1] if z > END else 1 for z in (x, y))
    assert lengths.tolist() == whole[END + 1 :]


def test_vocabularies_of_any_size():
    for end in (3, 70_000, 1 << 31):
        ids = np.array([[end - 1, 1, end - 2, end] * 9] * 40, np.uint32).ravel()
        block = repair.Block(repair.pack([1] * 360, ids, np.full(360, 4), end))
        assert len(block.rules) == 2 and all(x.tolist() == [end - 1, 1, end - 2, 0] for x in block.decode_all())


TEXTS = ["a  b", "\n x", "w \nx  y", " lead", "end ", "it's 'tis don't", "a\nb c\n", "x \ny z", "é  a b", "a　 b c", "x \n\n  y", "<|endoftext|> a <|endoftext|>", "", " ", "é ñ 漢字 🙂", "!!! ! !"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'.,! \n\t éß×÷\u0301漢1s\u00a0\u3000\u200a\x1f_"), max_size=30), max_size=8))
def test_pieces_encode_as_whole_texts(texts):
    e = repair.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, n = e.encode(pa.array([x.encode() for x in texts + TEXTS], pa.binary()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*x.tolist(), e.end] for x in e.ids(texts + TEXTS)]


def test_forgotten_pieces_encode_alike(monkeypatch):
    monkeypatch.setattr(repair, "PIECES", 40)
    e, r = repair.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    for _ in range(12):
        texts = [" ".join(r.choice(["the", "and", f"w{r.randrange(60)}", "é,", "\n x"]) for _ in range(20)) for _ in range(3)]
        ids, n = e.encode(pa.array([x.encode() for x in texts], pa.binary()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*x.tolist(), e.end] for x in e.ids(texts)]
        assert len(e.known) < 140


def test_other_tokenizers_encode_whole_texts():
    e = repair.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, n = e.encode(pa.array([x.encode() for x in TEXTS], pa.binary()).slice(1))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*x.tolist(), e.end] for x in e.ids(TEXTS[1:])]


def test_token_output(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(i * 7 % 101, f"text number {i} " * (i % 9)) for i in range(101)] + [(200, None), (201, "")]
    got = {x["doc_id"]: x for x in repair.token_output(docs(spark, rows), path).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert repair.token_output(odd(spark), path).count() == len(ODD) and repair.token_output(empty(spark), path).count() == 0


# -- personal data ----------------------------------------------------------------------------------------------------


def brute_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a@.+-1 2(9)0\n%é"), max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + ".") == []
    assert pii.Tokens(["a" * 300_000 + " " + "b" * 300_000], [[]]).doc.size == 0


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_messages_equal_enumeration_on_a_tree():
    model, r = pii.SkipChain(), np.random.default_rng(4)
    model.node, model.chain, model.skip = r.normal(size=model.node.shape), r.normal(size=model.chain.shape), r.normal(size=model.skip.shape)
    model.chain, model.skip = model.chain + model.chain.T, model.skip + model.skip.T
    g = pii.Tokens(["12 34 x9"], [[]])
    assert g.chain.tolist() == [[0, 1], [1, 2]] and not len(g.skip)
    z, total, seen = g.x @ model.node, 0.0, np.zeros((3, pii.LABELS))
    for a in range(pii.LABELS):
        for b in range(pii.LABELS):
            for c in range(pii.LABELS):
                w = np.exp(z[0, a] + z[1, b] + z[2, c] + model.chain[a, b] + model.chain[b, c])
                total += w
                seen[0, a] += w
                seen[1, b] += w
                seen[2, c] += w
    assert np.allclose(model.marginals(g), seen / total, atol=1e-3)


def test_repeated_tokens_share_labels():
    texts = ["mail bob@example.org now, bob@example.org again", "card 4111111111111111 and 7 4111111111111111 8"]
    g = pii.Tokens(texts, [pii.base_spans(t) for t in texts])
    assert len(g.skip) >= 2


def test_spans_are_added_outside_base_ones():
    model = pii.SkipChain()
    model.node[0, 0], model.node[4, 3] = 4, 12  # none by default, a card by its digits
    texts = ["card 12 4111111111111111 56", "4111111111111111"]  # the first one's base match is too long
    base = [pii.base_spans(t) for t in texts]
    assert base == [[], [(2, 0, 16)]]
    assert model.added(pii.Tokens(texts, base), base) == [[(2, 8, 24)], []]


def personal(i):
    return [f"u{i}.x@mail.example.org", f"10.{i % 250}.3.41", "4111 1111 1111 1111" if i % 2 else "5500000000000004", f"+49 30 {1000000 + 7919 * i}"][i % 4]


def prose(r, n):
    return " ".join(r.choice(["one", "two", "three", "four", str(r.randrange(3000)), f"{r.randrange(10**9)}"] if r.random() < 0.1 else ["one", "two", "three"]) for _ in range(n))


def test_likeness_alone_adds_spans(spark):
    """With a fitted model a variant is found if its span stands in the document, and neither it nor a decoy without it."""
    r = random.Random(2)
    rows = [(i, prose(r, 15) + f" {personal(i)} " + prose(r, 15)) for i in range(400)]
    model = pii.fitted(docs(spark, rows))
    found = wrong = alone = total = 0
    for i in range(1000, 1200):
        span = personal(i)
        v = pii.variant(i % 4, span, r)
        d = pii.decoy(v, r)
        text = f"{prose(r, 9)} {v} {prose(r, 9)} {span} {prose(r, 9)} {d} {prose(r, 9)}"
        base = [pii.base_spans(text)]
        added = model.added(pii.Tokens([text], base), base)[0]
        at = text.index(f" {v} ") + 1
        total += 1
        found += any(k == i % 4 and at <= s < at + len(v) for k, s, _ in added)
        wrong += any(not (at <= s < at + len(v)) for _, s, _ in added)
        text = text.replace(span, "nothing")
        base = [pii.base_spans(text)]
        alone += bool(model.added(pii.Tokens([text], base), base)[0])
    assert found >= 0.9 * total and wrong <= 0.03 * total and alone <= 0.03 * total, (found, wrong, alone, total)
    text = "mail anna.berg7@example.org or ask Anna.Berg7 today; anna.berg8 is another"
    base = [pii.base_spans(text)]
    assert pii.joined(model.added(pii.Tokens([text], base), base)[0]) == "email:35:45"


def test_find_personal(spark):
    r = random.Random(1)
    rows = []
    for i in range(200):
        extra = [f"u{i}@mail.example.org", f"10.{i}.3.4", "4111111111111111", f"+49 30 {1000000 + i}", f"year {1900 + i}", ""][i % 6]
        rows.append((i, " ".join(r.choice(["one", "two", "three"]) for _ in range(20)) + f" {extra} end"))
    got = {x["doc_id"]: x for x in pii.find_personal(docs(spark, rows)).collect()}
    for i, text in rows:
        base = brute_spans(text)
        want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == n for b in base) for n in range(4)]
        assert set(want.split(",")) <= set(got[i]["spans"].split(","))
        if i < 200 and i % 6 > 3:
            assert got[i]["spans"] == ""
    assert pii.find_personal(odd(spark)).count() == len(ODD) and pii.find_personal(empty(spark)).count() == 0
