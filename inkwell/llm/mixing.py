"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the rank variable per source; only the cell where a source's target falls is ordered row by row.
CELLS = 4096


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, source_size) -> with target double: weights 1, 2, 3 repeating by code point, null last, share the sum.

    A target stops at `most` times its source's size and the excess is shared by weight among the rest until none is
    above. In closed form: with sources in order of size / weight, those before the first that stays below are capped.
    The windows are over one row per source.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("weight", (F.pmod(F.row_number().over(w) - 1, F.lit(3)) + 1).cast("double"))
    df = df.withColumn("cap", most * F.col("source_size").cast("double"))
    level = F.col("cap") / F.col("weight")
    before = Window.orderBy(level, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("share", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    df = df.withColumn("free", level > F.col("share"))
    # shares of the first source that is not capped hold for all behind it
    first = F.min(F.when(F.col("free"), F.struct(level.alias("level"), F.col("share").alias("share")))).over(whole)["share"]
    df = df.withColumn("at", first)
    return df.withColumn("target", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight")))).select("source", "source_size", "target")


def uniform(seed: int) -> Column:
    """In (0, 1), fixed by doc_id, text (th) and seed: 52 bits of an MD5, which SQL engines share."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "th", F.lit(seed))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def sized(docs: DataFrame) -> list[Column]:
    """doc_id, source, th (an MD5 of the text) and size of docs; a null text counts as an empty one."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5(F.coalesce("text", F.lit(""))).alias("th"), size.alias("size")]


def length_class() -> Column:
    """The binary digits of a size, which weigh its inclusion: of two documents the longer is a little likelier."""
    return F.length(F.bin("size"))


def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null matching null."""
    right = right.withColumnRenamed("source", "__source")
    return left.join(right, left["source"].eqNullSafe(right["__source"]), how).drop("__source")


def inclusion(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, p): the inclusion probability of a further copy by length class, where a source has some of one to give.

    Probabilities are a constant times the class, 1 at most, such that the words expected of a source are its rest. In
    closed form: with classes from the longest down, those before the first that stays below 1 are certain.
    """
    k = rows.where("size > 0").groupBy("source", length_class().alias("k")).agg(F.sum("size").alias("words"))
    k = by_source(k, plan.where("rest > 0 and rest < source_size").select("source", "rest"))
    down = Window.partitionBy("source").orderBy(F.desc("k"))  # a row per class
    before, after = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    k = k.withColumn("c", (F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("words") * F.col("k")).over(after))
    free = F.max(F.when(F.col("c") * F.col("k") <= 1, F.struct("k", "c"))).over(Window.partitionBy("source"))
    k = k.withColumn("free", free).withColumn("p", F.when(F.col("k") > F.col("free.k"), 1.0).otherwise(F.col("free.c") * F.col("k")))
    return k.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias("p"))


def ranked(df: DataFrame, seed: int) -> DataFrame:
    """Add q, the random odds over the inclusion odds, and its cell; documents without a further copy to win have none."""
    u, p = uniform(seed), F.element_at("p", length_class())
    q = F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - p)))
    df = df.withColumn("q", F.when(F.col("size") > 0, q))
    return df.withColumn("cell", F.floor(F.col("q") / (1 + F.col("q")) * CELLS).cast("int"))


def key() -> Column:
    """What documents are told apart by; rows that share it repeat one."""
    return F.struct("q", "doc_id", "th")


def mixing_plan(rows: DataFrame, most: float = 3.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, th, size) -> one row per source that decides every document of it (see `chosen`).

    Each document gets floor(target / size of its source) whole copies. For the rest of the target, documents are
    ranked by q = (u / (1 - u)) / (p / (1 - p)) with p the inclusion probability of a further copy, and taken in that
    order until the sample has its size, which is counted in words: the one at the edge if at least half of it fits.
    One further document per source is then added or left out, the one whose size comes nearest to what is missing or
    too much. Sums per cell of q find the edge's cell, so only that cell's rows of a source meet in a task, repeated
    rows as one. Of rows that repeat a document, `fit` are taken at the edge, and one changes as the further document.
    """
    totals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    copies = F.when(F.col("target") >= most * F.col("source_size"), F.lit(most)).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = totals.withColumn("copies", copies).withColumn("rest", F.when(F.col("copies") >= most, 0.0).otherwise(F.col("target") - F.col("copies") * F.col("source_size")))
    plan = cut(plan, "targets")
    plan = cut(by_source(plan, inclusion(rows, plan), "left"), "inclusion")
    rows = ranked(by_source(rows, plan.select("source", "rest", "p").where("p is not null")), seed).where("q is not null").select("source", "doc_id", "th", "size", "rest", "q", "cell")
    by = Window.partitionBy("source").orderBy("cell")
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("upto", F.sum("words").over(by))
    edge = cells.where("upto >= rest").groupBy("source").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("below"))).alias("e")).select("source", F.col("e.cell").alias("edge"), F.col("e.below").alias("below"))
    edge = cut(edge, "edge")
    inside = by_source(rows, edge).where("cell = edge").groupBy("source", "q", "doc_id", "th", "size", "rest", "below").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("q", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("sofar", F.col("below") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
    fit = F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("rest") - F.col("sofar")) / F.col("size") + 0.5)))
    inside = inside.withColumn("fit", fit.cast("long"))
    stop = inside.groupBy("source").agg(
        F.max(F.when(F.col("fit") == F.col("n"), key())).alias("last"),
        F.max(F.when((F.col("fit") > 0) & (F.col("fit") < F.col("n")), key())).alias("part"),
        F.max(F.when((F.col("fit") > 0) & (F.col("fit") < F.col("n")), F.col("fit"))).alias("fit"),
        (F.first("rest") - F.first("below") - F.sum(F.col("fit") * F.col("size"))).alias("off"),
    )
    stop = cut(by_source(edge, stop, "left"), "stop")
    # a document to add when words are missing, to leave out when there are too many
    marked = by_source(rows, stop.withColumnRenamed("off", "__off")).withColumn("off", F.col("__off"))
    swap = marked.where((chosen() == (F.col("off") < 0)) & ~at_part() & (F.abs(F.abs("off") - F.col("size")) < F.abs("off")))
    swap = swap.groupBy("source").agg(F.min(F.struct(F.abs(F.abs("off") - F.col("size")).alias("d"), "q", "doc_id", "th")).alias("s")).select("source", F.struct("s.q", "s.doc_id", "s.th").alias("swap"))
    swap = cut(swap, "swap")
    times = by_source(rows, swap).where(key().eqNullSafe(F.col("swap"))).groupBy("source").agg(F.count("*").alias("times"))
    plan = by_source(by_source(by_source(plan, stop.drop("off"), "left"), swap, "left"), times, "left")
    return cut(plan, "plan")


def chosen() -> Column:
    return F.coalesce((F.col("cell") < F.col("edge")) | ((F.col("cell") == F.col("edge")) & (key() <= F.col("last"))), F.lit(False))


def at_part() -> Column:
    return F.coalesce(key().eqNullSafe(F.col("part")) & F.col("part").isNotNull(), F.lit(False))


def swapped() -> Column:
    return F.coalesce(key().eqNullSafe(F.col("swap")) & F.col("swap").isNotNull(), F.lit(False))


def numbered(rows: DataFrame) -> DataFrame:
    """Add nth, from 1, to the rows of a source that repeat its document at the edge or its further one.

    Rows are written with numbers that rise within a task; sums per task, of which there are few, make them gapless,
    so not even a third of all rows meets in one task.
    """
    rows = cut(rows.withColumn("of", F.when(at_part(), 0).otherwise(1)).withColumn("id", F.monotonically_increasing_id()), "repeated")
    rows = rows.withColumn("task", F.shiftright("id", 33))
    tasks = rows.groupBy("source", "of", "task").agg(F.count("*").alias("n"))
    tasks = cut(tasks.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("source", "of").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "tasks")
    rows = by_source(rows, tasks.select("source", F.col("of").alias("__of"), F.col("task").alias("__task"), "ahead")).where("of = __of and task = __task")
    return rows.withColumn("nth", F.col("ahead") + F.row_number().over(Window.partitionBy("source", "of", "task").orderBy("id")))


def with_copies(held: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """held (doc_id, source, th, size, ...) with source_size, target and copies, how often a row is taken.

    A null text has size 0; null is a source of its own; sources whose texts have no words take nothing. Rows that
    repeat doc_id and text share their rank and are taken or left together, but for those where the sample ends. An
    empty table stays empty.
    """
    names = held.columns
    out = ranked(by_source(held, plan, "left"), seed)
    extra = F.when(chosen() != swapped(), 1).otherwise(0)
    some = plan.where("part is not null or times > 1").limit(1).count()
    rest = out.where(~(at_part() | (swapped() & (F.col("times") > 1)))) if some else out
    rest = rest.select(*names, "source_size", "target", (F.col("copies") + extra).alias("copies"))
    if not some:
        return rest
    again = numbered(out.where(at_part() | (swapped() & (F.col("times") > 1))))
    extra = F.when(at_part(), (F.col("nth") <= F.col("fit")).cast("int")).otherwise((chosen() != (F.col("nth") == 1)).cast("int"))
    return rest.union(again.select(*names, "source_size", "target", (F.col("copies") + extra).alias("copies")))


def mix(docs: DataFrame, most: float = 3.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of docs.

    Nulls, ties, repeated rows and empty tables: as in with_copies. Columns may have any name.
    """
    names = docs.columns
    plan = mixing_plan(cut(docs.select(*sized(docs)), "sizes"), most, seed)
    held = docs.select(*sized(docs), F.struct(*names).alias("doc"))
    out = with_copies(held, plan, seed).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*[F.col(f"doc.`{c}`").alias(c) for c in names])


def mixing_report(docs: DataFrame, most: float = 3.0, seed: int = 17) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken, its words times its copies.

    Texts are read once: the report comes from the stored sizes. Odd rows: as in with_copies.
    """
    held = cut(docs.select(*sized(docs)), "sizes")
    out = with_copies(held, mixing_plan(held, most, seed), seed)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
