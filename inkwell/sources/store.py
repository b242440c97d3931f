"""Where intermediate tables go: a folder that all executors share."""

from __future__ import annotations

import hashlib
import os
import tempfile

from inkwell.operators.index import Index
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark is local, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found.rstrip("/") if found else "file://" + os.path.join(tempfile.gettempdir(), f"inkwell-{os.getpid()}")


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the application's file system closes."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)


_stored: dict[tuple[str, str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str, table: str = "documents") -> Index:
    """The index of a table of (doc_id, text), built and stored once an application and then read."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _stored:
        path = f"{shared_dir(spark)}/index-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}"
        Index.build(spark.read.parquet(f"{sf_dir}/{table}.parquet").select("doc_id", "text"), path)
        forget_at_end(spark, path)
        _stored[key] = path
    return Index.load(spark, _stored[key])
