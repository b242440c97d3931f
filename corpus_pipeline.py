"""The corpus pipeline: quality, near duplicates, contamination, mixing, token output."""

from __future__ import annotations

import public_tokenizers
from inkwell.llm.linecrf import good_documents
from inkwell.llm.mixing import mix
from inkwell.llm.qgrams import decontaminate
from inkwell.llm.repair import token_output
from inkwell.llm.shared import cut, read_table
from inkwell.llm.simhash import near_duplicates
from pyspark.sql import DataFrame, SparkSession

#: A path to the tokenizer of the last stage; its files are never part of the repository.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF doesn't reject.

    Rows without a text are scored as empty ones, repeated rows alike; an empty table stays empty; all columns stay.
    """
    return good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id, once if its row is repeated.

    Rows that share that doc_id but not the text all stay, as do rows without a doc_id, which can't be told from one
    another by it. Null and empty texts are one class. An empty table stays empty; all columns stay.
    """
    classes = near_duplicates(docs)
    keep = cut(classes.where("doc_id = component_id").select("doc_id").distinct(), "keep")
    # a merge join at every size; what it deals by doc_id serves the distinct rows too, so texts are shuffled once
    once = docs.join(keep.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).union(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts stay, repeated rows go or stay alike."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times each; texts without a word never.

    A null source is a source of its own. Rows that repeat doc_id and text share their rank. An empty table stays empty.
    """
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed corpus, as read back: a row per document and copy, null ids first, a null text as empty."""
    return token_output(docs, TOKENIZER)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed), ("tokens", tokens)]
#: Learnt models and fingerprints over XXH64 have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
