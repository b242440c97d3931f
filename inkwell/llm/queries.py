"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.shared import read_table


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.simhash import simhash_components

    return simhash_components(read_table(spark, sf_dir, "documents"))


def op1_language(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers
    from inkwell.llm.langid import identify

    return identify(read_table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.linecrf import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_qgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.qgrams import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_repair(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers
    from inkwell.llm.repair import token_output

    return token_output(read_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.mixing import mixing_report

    return mixing_report(read_table(spark, sf_dir, "documents"))


def op7_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.ring import shard_documents

    return shard_documents(read_table(spark, sf_dir, "documents"))


def op8_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.pii import find_personal

    return find_personal(read_table(spark, sf_dir, "documents"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.linechunks import line_report

    return line_report(read_table(spark, sf_dir, "documents"))


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.sketch import fingerprint_documents

    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_simhash": op2_simhash,
    "op3_line_crf": op3_line_crf,
    "op5_qgrams": op5_qgrams,
    "op4_repair": op4_repair,
    "op6_mixing": op6_mixing,
    "op7_ring": op7_ring,
    "op8_skip_chain": op8_skip_chain,
    "op9_line_chunks": op9_line_chunks,
    "op10_bottom_k": op10_bottom_k,
}
#: Sums run over all documents of a source in rank order here; the operator finds the same edge by cells.
ORACLES: dict[str, str] = {
    "op6_mixing": r"""
WITH sizes AS (SELECT doc_id, source, md5(coalesce(text, '')) AS th, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 AS DOUBLE) * source_size AS cap FROM totals),
shared AS (SELECT *, cap / weight AS level, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, coalesce(least(cap, (SELECT share FROM shared WHERE level > share ORDER BY level, share LIMIT 1) * weight), cap) AS target FROM shared),
plan AS (SELECT *, CASE WHEN copies >= 3 THEN 0 ELSE target - copies * source_size END AS rest
  FROM (SELECT *, CASE WHEN target >= CAST(3 AS DOUBLE) * source_size THEN 3 WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets)),
classes AS (SELECT s.source, rest, length(bin(size)) AS k, CAST(sum(size) AS BIGINT) AS words
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source WHERE size > 0 AND rest > 0 AND rest < source_size GROUP BY s.source, rest, length(bin(size))),
scaled AS (SELECT *, (rest - CAST(coalesce(sum(words) OVER before, 0) AS DOUBLE)) / CAST(sum(words * k) OVER after AS DOUBLE) AS c FROM classes
  WINDOW before AS (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (PARTITION BY source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
odds AS (SELECT a.source, a.k, CASE WHEN a.k > f.k THEN 1 ELSE f.c * a.k END AS p
  FROM scaled a JOIN (SELECT source, max(k) AS k, arg_max(c, k) AS c FROM scaled WHERE c * k <= 1 GROUP BY source) f ON a.source IS NOT DISTINCT FROM f.source),
drawn AS (SELECT doc_id, th, s.source, size, source_size, target, copies, rest, p, (CAST(CAST('0x' || substr(md5(concat_ws(':', doc_id, th, 17)), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN odds o ON s.source IS NOT DISTINCT FROM o.source AND size > 0 AND o.k = length(bin(size))),
ranked AS (SELECT *, CASE WHEN p >= 1 THEN 0 ELSE (u / (1 - u)) / (p / (1 - p)) END AS q, row_number() OVER (PARTITION BY source, doc_id, th) AS nth FROM drawn),
placed AS (SELECT *, q IS NOT NULL AND coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, th, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / CAST(2 AS DOUBLE) <= rest AS chosen FROM ranked),
missing AS (SELECT *, rest - sum(CASE WHEN chosen THEN size ELSE 0 END) OVER (PARTITION BY source) AS missing, bool_and(chosen) OVER repeats = bool_or(chosen) OVER repeats AS whole FROM placed WINDOW repeats AS (PARTITION BY source, doc_id, th)),
able AS (SELECT *, q IS NOT NULL AND whole AND chosen = (missing < 0) AND abs(abs(missing) - size) < abs(missing) AS able FROM missing),
swaps AS (SELECT *, able AND row_number() OVER (PARTITION BY source, able ORDER BY abs(abs(missing) - size), q, doc_id NULLS FIRST, th, nth) = 1 AS swapped FROM able)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN chosen <> swapped THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM swaps""",
}
