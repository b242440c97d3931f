"""Reports on an index: vocabulary, Zipf's law, document lengths, compression and query difficulty."""

from __future__ import annotations

import math

from inkwell.functions.text import query_tokens
from inkwell.functions.weights import robertson
from inkwell.operators.index import Index
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: IDF of a term that no document has, and the share of documents that it counts as.
OOV_IDF, OOV_SHARE = 10.0, 0.001


def vocabulary(index: Index) -> DataFrame:
    """One row: n, v, hapax (df 1), hapax_ratio, rare (df <= 2), avg_term_len, tokens."""
    t = index.terms.agg(
        F.count("*").alias("v"),
        F.count_if(F.col("df") == 1).alias("hapax"),
        F.count_if(F.col("df") <= 2).alias("rare"),
        F.avg("term_len").alias("avg_term_len"),
        F.coalesce(F.sum("cf"), F.lit(0)).cast("long").alias("tokens"),
    )
    return index.stats.select("n").crossJoin(F.broadcast(t)).select("n", "v", "hapax", (F.col("hapax") / F.col("v")).alias("hapax_ratio"), "rare", "avg_term_len", "tokens")  # one row each


def df_histogram(index: Index) -> DataFrame:
    """(df, terms, above): terms with that df and with a greater one. Windows run over different dfs, not over terms."""
    counts = index.terms.groupBy("df").agg(F.count("*").alias("terms"))
    above = Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("above", F.coalesce(F.sum("terms").over(above), F.lit(0)))


def df_percentiles(index: Index) -> DataFrame:
    """One row: df_p50, df_p90, df_p99, the df at positions V/2, V/10 and V/100 of the descending order; df_p99 is the
    greatest df where V is under 100."""
    h = df_histogram(index).crossJoin(F.broadcast(index.stats.select("v")))  # one row

    def at(part: int):
        place = F.floor(F.col("v") / part)
        return F.max(F.when((F.col("above") <= place) & (place < F.col("above") + F.col("terms")), F.col("df")))

    return h.agg(at(2).alias("df_p50"), at(10).alias("df_p90"), F.when(F.max("v") < 100, F.max("df")).otherwise(at(100)).alias("df_p99"))


def top_terms(index: Index, k: int = 20) -> DataFrame:
    """The k terms of the greatest df, with their Robertson IDF."""
    rows = index.terms.orderBy(F.desc("df"), "term").limit(k).crossJoin(F.broadcast(index.stats.select("n")))  # one row
    return rows.select("term", "df", "cf", robertson(F.col("n"), F.col("df")).alias("idf"))


def vocabulary_summary(index: Index) -> DataFrame:
    """One row: documents, vocabulary, hapax_ratio to four digits, df_p50, df_p90, tokens."""
    v = vocabulary(index).crossJoin(F.broadcast(df_percentiles(index)))  # one row each
    return v.select(F.col("n").alias("documents"), F.col("v").alias("vocabulary"), F.round("hapax_ratio", 4).alias("hapax_ratio"), "df_p50", "df_p90", "tokens")


def cf_ranks(index: Index) -> DataFrame:
    """(cf, terms, first): terms of that collection frequency take ranks first to first + terms - 1."""
    counts = index.terms.groupBy("cf").agg(F.count("*").alias("terms"))
    above = Window.orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("terms").over(above), F.lit(0)) + 1)


#: Ranks up to which logs are summed one by one; beyond, Euler-Maclaurin sums are exact to twelve digits.
EXACT = 32


def _log_square_constant(n: int = 1000) -> float:
    """What the Euler-Maclaurin sum of ln squared lacks, the same for every n."""
    log = math.log(n)
    return math.fsum(math.log(r) ** 2 for r in range(1, n + 1)) - (n * (log * log - 2 * log + 2) + log * log / 2 + log / (6 * n) - (4 * log - 6) / (720 * n**3))


def log_sum(n: Column) -> Column:
    """ln 1 + ... + ln n, without a row or an element per rank."""
    x = n.cast("double")
    whole = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    few = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(EXACT)).cast("int")), F.lit(0.0), lambda a, r: a + F.ln(r))
    return F.when(n < 1, 0.0).when(n <= EXACT, few).otherwise(whole)


def log_square_sum(n: Column) -> Column:
    """(ln 1) squared + ... + (ln n) squared."""
    x = n.cast("double")
    log = F.ln(x)
    whole = x * (log * log - 2 * log + 2) + log * log / 2 + log / (6 * x) - (4 * log - 6) / (720 * x * x * x) + _log_square_constant()
    few = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(EXACT)).cast("int")), F.lit(0.0), lambda a, r: a + F.ln(r) * F.ln(r))
    return F.when(n <= EXACT, few).otherwise(whole)


def zipf(index: Index) -> DataFrame:
    """One row: alpha, intercept, r2, verdict of the least-squares line of ln cf on ln rank.

    Terms of one frequency share a range of ranks, whose logs are summed in closed form, so the work is a row per
    frequency. Null fits where there is no term or one; r2 is 1 where all frequencies are the same.
    """
    y, m = F.ln("cf"), F.col("terms")
    logs = log_sum(F.col("first") + m - 1) - log_sum(F.col("first") - 1)
    s = cf_ranks(index).agg(F.sum(m).alias("n"), F.sum(m * y).alias("y"), F.sum(m * y * y).alias("yy"), F.sum(y * logs).alias("xy"), F.count("*").alias("values"))
    s = s.withColumn("x", log_sum(F.col("n"))).withColumn("xx", log_square_sum(F.col("n")))
    n = F.col("n")
    sxx, sxy, syy = F.col("xx") - F.col("x") * F.col("x") / n, F.col("xy") - F.col("x") * F.col("y") / n, F.col("yy") - F.col("y") * F.col("y") / n
    s = s.select("n", "x", "y", "values", F.when(n > 1, sxx).alias("sxx"), sxy.alias("sxy"), syy.alias("syy"))
    slope = F.col("sxy") / F.col("sxx")
    r2 = F.when(F.col("sxx").isNull(), F.lit(None)).when(F.col("values") == 1, 1.0).otherwise(F.col("sxy") * slope / F.nullif(F.col("syy"), F.lit(0.0)))
    fit = s.select((-slope).alias("alpha"), ((F.col("y") - slope * F.col("x")) / F.col("n")).alias("intercept"), r2.cast("double").alias("r2"))
    off = F.abs(F.col("alpha") - 1)
    return fit.withColumn("verdict", F.when(off < 0.1, "excellent").when(off < 0.3, "good").otherwise("deviation"))


def zipf_top(index: Index, k: int = 10) -> DataFrame:
    """The k most frequent terms with their frequency and the line's: exp(intercept) / rank ** alpha."""
    top = index.terms.orderBy(F.desc("cf"), "term").limit(k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cf"), "term")))  # k rows
    return top.crossJoin(F.broadcast(zipf(index))).select("rank", "term", "cf", (F.exp("intercept") / F.pow("rank", "alpha")).alias("predicted"))


def lengths(index: Index) -> DataFrame:
    """One row: mean, population std, min, max and interpolated percentiles of document length."""
    at = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    row = index.docs.agg(F.avg("dl").alias("mean"), F.stddev_pop("dl").alias("std"), F.min("dl").alias("min"), F.max("dl").alias("max"), F.percentile("dl", at).alias("p"))
    return row.select("mean", "std", "min", "max", *[F.col("p")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(at)])


def length_histogram(index: Index, bins: int = 10) -> DataFrame:
    """(bin, low, high, docs): bins of equal width, the last one closed, empty ones included."""
    ends = index.docs.agg(F.min("dl").alias("lo"), F.max("dl").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("dl") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counts = index.docs.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("docs"))  # one row
    rows = index.docs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    return rows.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("docs", F.lit(0)).alias("docs"))


def length_outliers(index: Index) -> DataFrame:
    """One row: documents shorter than half of p10 and longer than twice p99."""
    edges = index.docs.agg(F.percentile("dl", [0.1, 0.99]).alias("p"))
    return index.docs.crossJoin(F.broadcast(edges)).agg(F.count_if(F.col("dl") < 0.5 * F.col("p")[0]).alias("short"), F.count_if(F.col("dl") > 2 * F.col("p")[1]).alias("long"))


def compression(index: Index, codec: str = "vbe") -> DataFrame:
    """One row: postings, raw_bytes at 8 each, encoded_bytes, ratio, avg_list."""
    from inkwell.operators.codecs import sizes

    s = sizes(index.postings, [codec]).agg(F.sum("n").alias("postings"), F.sum("bytes").alias("encoded_bytes"), F.count("*").alias("v"))
    return s.select("postings", (F.col("postings") * 8).alias("raw_bytes"), "encoded_bytes", (F.col("postings") * 8 / F.col("encoded_bytes")).alias("ratio"), (F.col("postings") / F.col("v")).alias("avg_list"))


def stopwords(index: Index, share: float = 0.5, k: int = 10) -> DataFrame:
    """The k most frequent terms in over that share of documents."""
    rows = index.terms.crossJoin(F.broadcast(index.stats.select("n")))  # one row
    return rows.where(F.col("df") > share * F.col("n")).orderBy(F.desc("df"), "term").limit(k).select("term", "df", (F.col("df") / F.col("n")).alias("share"))


def difficulty_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, pos, term, df, idf) per query occurrence."""
    rows = query_tokens(queries).join(index.terms.select("term", "df"), "term", "left").crossJoin(F.broadcast(index.stats.select("n")))  # one row
    known = F.col("df").isNotNull()
    return rows.select("qid", "pos", "term", F.coalesce("df", F.lit(0)).alias("df"), F.when(known, robertson(F.col("n"), F.col("df"))).otherwise(OOV_IDF).alias("idf"))


def difficulty(index: Index, queries: DataFrame) -> DataFrame:
    """Per query: avg_idf, var_idf, min_df, max_df, expected matches, specificity and a label."""
    rows = difficulty_terms(index, queries).crossJoin(F.broadcast(index.stats.select("n")))  # one row
    share = F.when(F.col("df") > 0, F.col("df") / F.col("n")).otherwise(OOV_SHARE)
    g = rows.groupBy("qid").agg(
        F.avg("idf").alias("avg_idf"),
        F.var_pop("idf").alias("var_idf"),
        F.min("df").alias("min_df"),
        F.max("df").alias("max_df"),
        F.first("n").alias("n"),
        F.aggregate(F.array_sort(F.collect_list(share)), F.lit(1.0), lambda a, x: a * x).alias("product"),
    )
    g = queries.select("qid").distinct().join(g, "qid", "left")
    spec = F.when(F.col("avg_idf").isNull(), F.lit(0.5)).otherwise(F.col("avg_idf") / F.ln(F.col("n") + 1.0))
    g = g.withColumn("specificity", spec)
    label = (
        F.when(F.col("avg_idf").isNull(), "UNKNOWN")
        .when((F.col("specificity") > 0.7) & (F.col("min_df") > 0), "EASY")
        .when(F.col("specificity") > 0.4, "MEDIUM")
        .when(F.col("min_df") == 0, "HARD-OOV")
        .otherwise("HARD-common")
    )
    expected = F.greatest(F.lit(1), F.floor(F.col("n") * F.col("product") + 1e-9)).cast("long")
    return g.select("qid", "avg_idf", "var_idf", "min_df", "max_df", expected.alias("expected"), "specificity", label.alias("label"))


def report(index: Index) -> dict[str, DataFrame]:
    """All reports by name."""
    return {"vocabulary": vocabulary(index), "df_percentiles": df_percentiles(index), "top_terms": top_terms(index), "zipf": zipf(index), "zipf_top": zipf_top(index), "lengths": lengths(index), "length_histogram": length_histogram(index), "length_outliers": length_outliers(index), "compression": compression(index), "stopwords": stopwords(index)}
