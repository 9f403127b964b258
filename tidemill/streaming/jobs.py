"""The two streaming queries: ingest (validate, de-duplicate) and features (windows, late events)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemill.functions.validation import validated
from tidemill.sources.contracts import RAW_FIELDS
from tidemill.streaming.processors import deduplicated, features
from tidemill.streaming.runs import no_empty_batches, use_rocksdb
from tidemill.streaming.sinks import both, split_by_kind

Sink = Callable[[DataFrame, int], None]

FEATURE_COLUMNS = ["customer_id", "total_amount_30d", "tx_count_30d", "window_start_ms", "window_end_ms"]
FEATURE_DDL = "customer_id string, total_amount_30d double, tx_count_30d bigint, window_start_ms bigint, window_end_ms bigint"


def ingest(spark: SparkSession, payloads: DataFrame, base: str, checkpoint: str, every: str = "10 seconds", *more: Sink) -> StreamingQuery:
    """Payloads (value) to base/valid and base/invalid, and to the sinks `more`."""
    use_rocksdb(spark)
    sink = both(split_by_kind(base, {"valid": list(RAW_FIELDS), "invalid": ["value"]}), *more)
    writer = deduplicated(validated(payloads)).writeStream.queryName("ingest").option("checkpointLocation", checkpoint).outputMode("append")
    with no_empty_batches(spark):
        return writer.trigger(processingTime=every).foreachBatch(sink).start()


def rolling(spark: SparkSession, events: DataFrame, base: str, checkpoint: str, every: str | None = None, *more: Sink) -> StreamingQuery:
    """De-duplicated events to base/feature and base/late, and to the sinks `more`; without `every`, all that is there, then
    it ends."""
    use_rocksdb(spark)
    sink = both(split_by_kind(base, {"feature": FEATURE_COLUMNS, "late": list(RAW_FIELDS)}), *more)
    writer = features(events).writeStream.queryName("features").option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(sink)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
