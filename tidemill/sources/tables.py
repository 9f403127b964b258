"""Batch sources: adapters of the bundled tables to events, empty tables, fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import HOUR_MS
from tidemill.sources.contracts import LEDGER, OFFLINE, RAW, RAW_BATCH


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; times without zone are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _millis(column: str) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("customer_id"), F.col("value").alias("amount"), _millis("ts").alias("event_timestamp_ms"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_totalprice").alias("amount"), _millis("o_orderdate").alias("event_timestamp_ms"))


def fixture_events(spark: SparkSession, hour_ms: int) -> DataFrame:
    """Six events, one of them twice, in order of `arrival`; `hour_ms` is the hour that ends them."""
    base = hour_ms - 4 * HOUR_MS
    minute = 60_000
    # fixed values: the events that all expectations are about
    rows = [
        ("evt-001", "customer-001", 10.0, base + 10 * minute),
        ("evt-002", "customer-001", 20.0, base + 40 * minute),
        ("evt-003", "customer-001", 30.0, base + 80 * minute),
        ("evt-002", "customer-001", 20.0, base + 40 * minute),
        ("evt-004", "customer-002", 7.5, base + 60 * minute),
        ("watermark-001", "watermark-driver", 0.0, hour_ms),
    ]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], RAW + ", arrival bigint")


def ensure_tables(spark: SparkSession, data_dir: str) -> None:
    """Empty raw, offline and ledger tables where there are none yet."""
    for path, ddl in (("raw/transactions", RAW_BATCH), ("offline/customer_30d", OFFLINE), ("ledger/pushed_windows", LEDGER)):
        spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{data_dir}/{path}.parquet")
