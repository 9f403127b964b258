"""Time and JSON forms of events and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.config import HOUR_MS, PUSH_SOURCE, PUSH_TO
from tidemill.sources.contracts import PUSH_FIELDS, RAW_FIELDS


def floor_ms(ms: Column, step: int = HOUR_MS) -> Column:
    return ms - F.pmod(ms, F.lit(step))


def event_time(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso_timestamp(ms: Column) -> Column:
    """ISO 8601 in UTC (under the UTC session zone), with as many digits of a second as it needs."""
    ts = F.timestamp_millis(ms)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.pmod(ms, F.lit(1000)) == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'000Z'"))


def event_json() -> Column:
    return F.to_json(F.struct(*RAW_FIELDS))


def feature_json() -> Column:
    return F.to_json(F.struct("customer_id", "total_amount_30d", "tx_count_30d", "window_start_ms", "window_end_ms", "event_timestamp", "created_timestamp"))


def fingerprint() -> Column:
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in RAW_FIELDS])), 256)


def batch_rows(events: DataFrame) -> DataFrame:
    """Events with both timestamps, which are the event's time."""
    return events.withColumns({"event_timestamp": event_time(F.col("event_timestamp_ms")), "created_timestamp": event_time(F.col("event_timestamp_ms"))})


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def with_metadata(features: DataFrame) -> DataFrame:
    """Features with the window's end as text and the time of their making."""
    return features.withColumns({"event_timestamp": iso_timestamp(F.col("window_end_ms")), "created_timestamp": now_text()})


def push_payloads(features: DataFrame, batch: Column) -> DataFrame:
    """One column-oriented payload for each value of `batch` (which must bound the records of a payload);
    records in the order of customer and window. No records give no payload."""
    own = F.array_sort(F.collect_list(F.struct("customer_id", "window_end_ms", *PUSH_FIELDS[1:])))
    rows = features.groupBy(batch.alias("batch")).agg(own.alias("own"))
    return rows.select("batch", F.lit(PUSH_SOURCE).alias("push_source_name"), F.struct(*[F.col(f"own.{c}").alias(c) for c in PUSH_FIELDS]).alias("df"), F.lit(PUSH_TO).alias("to"))
