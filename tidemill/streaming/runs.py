"""Folders that driver and executors share, and running a stream over what is there."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def no_empty_batches(spark: SparkSession) -> Iterator[None]:
    """Queries started inside run a batch only when there is input. Operators in processing time would else have batches
    without end; one that sets no timers has nothing to do in them."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain(query: StreamingQuery) -> None:
    """Waits until a query without empty batches has taken all input, however long that is, then stops it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
