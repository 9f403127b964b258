"""Agreement of two feature tables, and point-in-time retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.config import HOUR_MS
from tidemill.functions.forms import floor_ms


def close(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for each (customer_id, window_end_ms) of either table: both totals and counts, and whether they agree."""
    a = left.select("customer_id", "window_end_ms", F.col("total_amount_30d").alias("left_total"), F.col("tx_count_30d").alias("left_count"))
    b = right.select("customer_id", "window_end_ms", F.col("total_amount_30d").alias("right_total"), F.col("tx_count_30d").alias("right_count"))
    same = F.coalesce(close(F.col("left_total"), F.col("right_total")) & (F.col("left_count") == F.col("right_count")), F.lit(False))
    return a.join(b, ["customer_id", "window_end_ms"], "full_outer").withColumn("same", same)


def mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    return parity(left, right).where(~F.col("same"))


def as_of(entities: DataFrame, runs: DataFrame, ttl_ms: int, key: str = "customer_id", time: str = "at_ms", slide: int = HOUR_MS) -> DataFrame:
    """Each entity row with window_end_ms and the values of the last window that ended at or before its time, within the time
    to live; null if there is none. `runs` holds windows as runs (first_end, last_end) of equal values, so no window
    is dealt out. Both tables are dealt by key and passed over once, in the order of time."""
    values = [c for c in runs.columns if c not in (key, "first_end", "last_end")]
    names = [c for c in entities.columns if c not in (key, time)]
    rows = runs.select(key, F.col("first_end").alias("t"), F.lit(0).alias("kind"), F.struct("last_end", *values).alias("f"), *[F.lit(None).cast(entities.schema[c].dataType).alias(f"e_{c}") for c in names])
    asked = entities.select(key, F.col(time).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["f"].dataType).alias("f"), *[F.col(c).alias(f"e_{c}") for c in names])
    w = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(asked).withColumn("f", F.last("f", ignorenulls=True).over(w)).where("kind = 1")
    end = F.when(F.col("f").isNotNull(), F.least(F.col("f.last_end"), floor_ms(F.col("t"), slide)))
    fresh = end >= F.col("t") - ttl_ms
    return out.select(key, F.col("t").alias(time), *[F.col(f"e_{c}").alias(c) for c in names], F.when(fresh, end).alias("window_end_ms"), *[F.when(fresh, F.col(f"f.{c}")).alias(c) for c in values])
