"""Line dedup by content-defined chunks of lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.shared import cut

#: A chunk has so many lines on average; the base and modulus of the rolling hash, whose products fit 64 bits.
LINES, BASE, MODULUS = 3, 1_000_003, (1 << 31) - 1
#: Every passage of over so many words is found, whatever stands around it.
WORDS = 50


def line_hashes(text: str = "text") -> Column:
    return F.transform(F.split(F.col(text), "\n"), lambda x: F.xxhash64(x))


def rolling(hashes: Column) -> Column:
    """The polynomial rolling hash of each two lines in a row, by the hashes of the lines."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    digit = lambda x: F.pmod(x, F.lit(MODULUS))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.pmod(digit(a) * BASE + digit(b), F.lit(MODULUS)))


def starts(rolled: Column) -> Column:
    """The lines, from 1, at which chunks start, but for the first: those behind two lines whose hash is a multiple of LINES.

    A boundary depends on the two lines before it alone, so what is inserted elsewhere does not shift it.
    """
    return F.filter(F.transform(rolled, lambda r, k: F.when(F.pmod(r, F.lit(LINES)) == 0, k + 3).otherwise(0)), lambda s: s > 0)


def word_lines(text: str = "text") -> Column:
    """The line, from 1, of each word of the text."""
    return F.flatten(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.array_repeat(i + 1, F.regexp_count(x, F.lit(r"\S+")))))


def span(first: Column, last: Column) -> Column:
    """A run of lines as one number, as sets of structs are compared each with each."""
    return F.shiftleft(first.cast("long"), 32).bitwiseOR(last.cast("long"))


def opened(x: Column) -> tuple[Column, Column]:
    return F.shiftright(x, 32).cast("int"), x.bitwiseAND(0xFFFFFFFF).cast("int")


def shortest_runs(at: Column) -> Column:
    """The shortest run of lines with over WORDS words from each line on, and up to each line, by the lines of the words.

    They depend on no line outside, and those within a passage of over WORDS words cover all of its lines with words.
    """
    ends = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda p: ~F.get(at, p + 1).eqNullSafe(F.get(at, p)))

    def runs(ends: Column) -> Column:
        on = F.transform(F.filter(F.concat(F.array(F.lit(-1)), ends), lambda p: p + 1 + WORDS < F.size(at)), lambda p: span(F.get(at, p + 1), F.get(at, p + 1 + WORDS)))
        back = F.transform(F.filter(ends, lambda p: p >= WORDS), lambda p: span(F.get(at, p - WORDS), F.get(at, p)))
        return F.concat(on, back)

    # the ends are found once: the one element of an array
    return F.when(F.size(at) > WORDS, F.flatten(F.transform(F.array(ends), runs))).otherwise(F.array().cast("array<bigint>"))


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, th, first, last, h): chunks of several lines and the shortest runs of docs (doc_id, th, text), lines from 1.

    Rows with a null text have none; repeated rows repeat theirs.
    """
    docs = docs.select("doc_id", "th", line_hashes().alias("lh"), word_lines().alias("at"))
    docs = docs.select("doc_id", "th", "lh", shortest_runs(F.col("at")).alias("runs"), starts(rolling(F.col("lh"))).alias("starts"))
    firsts, lasts = F.concat(F.array(F.lit(1)), "starts"), F.concat(F.transform("starts", lambda s: s - 1), F.array(F.size("lh")))
    # a boundary behind the last line starts nothing; chunks of one line count as runs only, by their words
    x = F.filter(F.zip_with(firsts, lasts, span), lambda c: opened(c)[1] > opened(c)[0])
    docs = docs.where("size(lh) > 0").select("doc_id", "th", "lh", F.explode(F.array_union(x, F.col("runs"))).alias("x"))
    first, last = opened(F.col("x"))
    return docs.select("doc_id", "th", first.alias("first"), last.alias("last"), F.xxhash64(F.slice("lh", first, last - first + 1)).alias("h"))


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, th, first, last) of chunks whose bytes also stand in an earlier place, by (doc_id, th, line).

    Null doc_ids come first; rows that repeat doc_id and text share their places.
    """
    found = cut(chunks(docs), "chunks")  # read twice
    place = F.struct("doc_id", "th", "first", "last")
    known = found.groupBy("h").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a run may overlap its own first place (a line repeated at once), of which nothing goes then
    inside = F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("th") == F.col("origin.th")) & (F.col("first") > F.col("origin.first")) & (F.col("first") <= F.col("origin.last"))
    some = cut(found.join(known, "h").where(~inside).select("doc_id", "th", "first", "last", "h", "origin"), "repeats")
    # the text of the chunks that repeat, fetched once a document; a hot chunk is joined to its one origin
    asked = some.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last", "h", "origin")).alias("asked"))
    docs, same = docs.select("doc_id", "th", "text"), [F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")), F.col("d.th") == F.col("a.th")]
    # both joins with texts are merge joins at every size, so that a large table runs as a small one does
    texts = docs.alias("d").join(asked.hint("merge").alias("a"), same[0] & same[1]).select("d.doc_id", "d.th", F.split("d.text", "\n").alias("lines"), F.explode("a.asked").alias("x"))
    body = F.array_join(F.slice("lines", F.col("x.first"), F.col("x.last") - F.col("x.first") + 1), "\n")
    texts = cut(texts.select("doc_id", "th", "x.first", "x.last", "x.h", "x.origin", body.alias("body")), "bodies")
    own = F.struct("doc_id", "th", "first", "last")
    origins = texts.where(own.eqNullSafe(F.col("origin"))).groupBy("h").agg(F.first("body").alias("origin_body"))  # of one document
    later = texts.where(~own.eqNullSafe(F.col("origin")))
    return later.join(origins, "h").where("body = origin_body").select("doc_id", "th", "first", "last")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the lines of globally repeated chunks removed, and dedup_lines, dedup_removed added.

    A chunk is a run of lines between boundaries that a rolling hash over line hashes chooses, so an insertion elsewhere
    doesn't shift it; it counts if it has several lines. The shortest runs of over 50 words from and to each line are
    chunks too, one line maybe, so a repeated passage of whole lines of over 50 words is found whatever its neighbours. A chunk stays
    at its first place by (doc_id, hash of the text, line) and goes elsewhere once its bytes have been compared. Rows
    that repeat doc_id and text count as one document and are treated alike. Null texts stay null with 0 lines; an
    empty text has one line; a text whose lines all go becomes empty. All columns of docs stay, whatever their names.
    """
    names = docs.columns
    held = docs.select(F.struct(*names).alias("__doc"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th"))
    keyed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    gone = repeated(keyed).groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    gone = cut(gone, "gone").hint("merge").alias("g")
    out = held.join(gone, F.col("__id").eqNullSafe(F.col("g.doc_id")) & (F.col("__th") == F.col("g.th")), "left")
    lines = F.split(F.col("__doc.text"), "\n")
    out = out.select("__doc", lines.alias("lines"), F.coalesce(F.col("g.gone"), F.array()).alias("gone"))
    kept = F.filter("lines", lambda x, i: ~F.exists("gone", lambda r: (r["first"] <= i + 1) & (i + 1 <= r["last"])))
    out = out.withColumn("kept", F.when(F.size("gone") == 0, F.col("lines")).otherwise(kept))
    text = F.when(F.size("gone") == 0, F.col("__doc.text")).otherwise(F.array_join("kept", "\n"))
    n = F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0))
    columns = [(text if c == "text" else F.col(f"__doc.`{c}`")).alias(c) for c in names]
    return out.select(*columns, n.alias("dedup_lines"), (n - F.coalesce(F.when(F.col("kept").isNotNull(), F.size("kept")), F.lit(0))).alias("dedup_removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, and the text that stays."""
    out = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", F.col("dedup_lines").cast("long").alias("n_lines"), F.col("dedup_removed").cast("long").alias("n_removed"), "text")
