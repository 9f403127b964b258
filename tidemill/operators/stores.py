"""Offline and online tables, the ledger of pushed windows and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.config import ONLINE_TTL
from tidemill.operators.dedup import upsert_ignore

LEDGER_KEY = ["customer_id", "window_end_ms"]


def latest(features: DataFrame, key: str = "customer_id", order: tuple[str, ...] = ("window_end_ms",)) -> DataFrame:
    """The last row of each key by `order`: one aggregation, partial before the shuffle."""
    rest = [c for c in features.columns if c != key]
    return features.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def lookup(entities: DataFrame, online: DataFrame, now_ms: int | None = None, key: str = "customer_id", ttl_ms: int = int(ONLINE_TTL.total_seconds() * 1000)) -> DataFrame:
    """Each entity row with its online values; null for unknown entities and, given `now_ms`, for values
    whose window ended more than the time to live before it."""
    values = [c for c in online.columns if c != key]
    out = entities.join(online, key, "left")
    if now_ms is None:
        return out
    fresh = F.col("window_end_ms") >= now_ms - ttl_ms
    return out.select(*[c for c in out.columns if c not in values], *[F.when(fresh, F.col(c)).alias(c) for c in values])


def unpushed(features: DataFrame, ledger: DataFrame) -> DataFrame:
    return features.join(ledger, LEDGER_KEY, "left_anti")


def already_pushed(features: DataFrame, ledger: DataFrame) -> DataFrame:
    return features.join(ledger, LEDGER_KEY, "left_semi")


def mark_pushed(ledger: DataFrame, features: DataFrame) -> DataFrame:
    return upsert_ignore(ledger, features.select(*LEDGER_KEY), LEDGER_KEY)


def push_online(online: DataFrame, pushed: DataFrame, order: tuple[str, ...] = ("window_end_ms",)) -> DataFrame:
    """The online table after a push: the last row of each key of both."""
    return latest(online.unionByName(pushed), order=order)


def dead_letters(rejected: DataFrame, reason: Column) -> DataFrame:
    """Envelopes of messages with topic, partition, offset and value, a string or bytes."""
    return rejected.select(reason.alias("reason"), F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), text_of(F.col("value")).alias("value"))


def text_of(value: Column) -> Column:
    """A message's string or bytes as text; U+FFFD stands for what is no UTF-8."""
    return F.make_valid_utf8(value.cast("string"))


def numbered_batches(records: DataFrame, most: int, n: int, key: tuple[str, ...] = ("customer_id", "window_end_ms")) -> DataFrame:
    """`records`, about `n` of them, with a column batch; no batch has more than `most`. They are dealt by a hash and numbered
    inside of its parts, so no task numbers all."""
    parts = max(1, n // (64 * most))
    own = records.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*key)) - 1
    return own.withColumn("batch", F.concat_ws("-", "_part", F.floor(row / most))).drop("_part")


def next_offsets(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("offset"))
