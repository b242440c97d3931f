"""Streaming ingest: each micro-batch of documents becomes postings beside the ones there are."""

from __future__ import annotations

from inkwell.operators.index import Index, merge_postings, postings_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def ingest(docs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index a stream of (doc_id, text) into path/batches. A batch that runs again overwrites its own part only."""

    def put(batch: DataFrame, number: int) -> None:
        postings_of(batch).write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    writer = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def compact(spark: SparkSession, path: str, out: str) -> Index:
    """Merge all batches so far into a stored index."""
    rows = spark.read.parquet(f"{path}/batches").select("term", "doc_id", "tf")
    return Index.store(merge_postings(rows), out)
