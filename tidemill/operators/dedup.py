"""De-duplication of events by event_id, in batch.

Rows are first counted by (event_id, fingerprint), before any shuffle as far as possible, so an id that
stands in many rows is a few rows where ids meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.forms import fingerprint
from tidemill.sources.contracts import RAW_FIELDS


def _versions(events: DataFrame, arrival: str) -> DataFrame:
    own = events.select(*RAW_FIELDS, F.col(arrival).alias("arrival"), fingerprint().alias("print"))
    own = own.groupBy("event_id", "print").agg(F.min("arrival").alias("arrival"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in RAW_FIELDS[1:]])
    return own.withColumn("version", F.row_number().over(Window.partitionBy("event_id").orderBy("arrival", "print")))


def first_events(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The first event of each event_id by `arrival`."""
    return _versions(events, arrival).where("version = 1").select(*RAW_FIELDS)


def conflicts(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One string for each event that differs from the first one of its event_id."""
    later = _versions(events, arrival).where("version > 1")
    return later.select(F.concat(F.lit("conflicting duplicate event_id="), "event_id").alias("value"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("_n")).drop("_n")


def upsert_ignore(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """`table` and the first row of each new key of `incoming` (the columns of `keys` only are compared)."""
    new = incoming.select(*table.columns).dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new.select(*table.columns))
