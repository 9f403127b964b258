"""Strict validation of JSON events and of aggregate records, by Variant expressions only.

A payload is one JSON object with exactly the four fields. Unlike lenient parsers this takes NaN,
Infinity and repeated keys for malformed, and an integer outside 64 bits for no timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.contracts import RAW_FIELDS, REQUIRED_AGGREGATE_FIELDS

_NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"
_NOT_BLANK = r"(?U)\S"


def _kind(v: str, name: str) -> Column:
    return F.expr(f"schema_of_variant(try_variant_get({v}, '$.{name}', 'variant'))")


def validated(events: DataFrame, value: str = "value") -> DataFrame:
    """The columns of `events`, the four typed fields and `error`, which is null for a valid payload."""
    # a generator's output is not worked out again by filters that are moved below it
    df = events.withColumn("_v", F.explode(F.array(F.expr(f"try_parse_json(`{value}`)")))).withColumn("_keys", F.expr("array_sort(map_keys(try_cast(_v AS map<string, variant>)))"))
    text = {c: F.expr(f"try_variant_get(_v, '$.{c}', 'string')") for c in ("event_id", "customer_id")}
    names = F.array(*[F.lit(c) for c in sorted(RAW_FIELDS)])
    blank = {c: (_kind("_v", c) != "STRING") | _kind("_v", c).isNull() | ~text[c].rlike(_NOT_BLANK) for c in text}
    error = (
        F.when(F.col("_v").isNull(), "invalid JSON: malformed document")
        .when(F.col("_keys").isNull() | (F.col("_keys") != names), f"expected exactly these fields: {sorted(RAW_FIELDS)}")
        .when(blank["event_id"], "event_id must be a non-empty string")
        .when(blank["customer_id"], "customer_id must be a non-empty string")
        .when(~_kind("_v", "amount").rlike(_NUMERIC), "amount must be numeric")
        .when(_kind("_v", "event_timestamp_ms") != "BIGINT", "event_timestamp_ms must be an int64")
    )
    fields = F.struct(
        text["event_id"].alias("event_id"),
        text["customer_id"].alias("customer_id"),
        F.expr("try_variant_get(_v, '$.amount', 'double')").alias("amount"),
        F.expr("try_variant_get(_v, '$.event_timestamp_ms', 'bigint')").alias("event_timestamp_ms"),
        error.alias("error"),
    )
    return df.select(*events.columns, F.explode(F.array(fields)).alias("_f")).select(*events.columns, "_f.*")


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNull()).select(*RAW_FIELDS)


def invalid(checked: DataFrame, value: str = "value") -> DataFrame:
    """One string for each invalid payload: its error and the payload."""
    return checked.where(F.col("error").isNotNull()).select(F.concat(F.col("error"), F.lit("; payload="), F.coalesce(F.col(value), F.lit("null"))).alias("value"))


def record_error(value: Column) -> Column:
    """Null if the JSON text is an object with all required aggregate fields, else what is wrong."""
    keys = F.map_keys(F.try_parse_json(value).try_cast("map<string, variant>"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in REQUIRED_AGGREGATE_FIELDS]), keys))
    return F.when(keys.isNull(), "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("Missing aggregate fields: ['"), F.array_join(missing, "', '"), F.lit("']")))
