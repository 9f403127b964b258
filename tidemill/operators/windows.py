"""Rolling event-time windows [end - window, end), for every multiple of `slide` that is an end with at
least one event.

All forms first aggregate events into tiles of one slide. rolling() then merges two running aggregates for each window
and takes nothing back, so it serves sums of doubles, minima and maxima alike; rolling_delta() needs two change points
for each tile and a running sum over them, for exact numbers only; rolling_native() is Spark's own window() and
serves as a cross-check on small inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.config import DAY_MS, HOUR_MS
from tidemill.functions.forms import floor_ms

WINDOW_MS = 30 * DAY_MS

#: How two values of a kind are merged by an aggregate, and as columns of which one may be null.
MERGE = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}
SUM_COUNT = {"s": "sum", "n": "sum"}


def tiles(events: DataFrame, key: str = "customer_id", slide: int = HOUR_MS, kind: str = "double") -> DataFrame:
    """(key, tile, s, n): sum (of amounts as `kind`) and count of each tile, named by its start."""
    return tiles_of(events, {"s": F.sum(F.col("amount").cast(kind)), "n": F.count("*")}, key, slide)


def tiles_of(events: DataFrame, values: dict[str, Column], key: str = "customer_id", slide: int = HOUR_MS) -> DataFrame:
    """(key, tile, values): aggregates of each tile."""
    return events.groupBy(key, floor_ms(F.col("event_timestamp_ms"), slide).alias("tile")).agg(*[v.alias(name) for name, v in values.items()])


def rolling(tiled: DataFrame, merges: dict[str, str], key: str = "customer_id", window: int = WINDOW_MS, slide: int = HOUR_MS) -> DataFrame:
    """(key, values, window_end_ms): the values of tiles, merged as MERGE says, for each window."""
    ends = F.sequence("first_end", "last_end", F.lit(slide).cast("bigint"))
    return rolling_runs(tiled, merges, key, window, slide).select(key, *merges, F.explode(ends).alias("window_end_ms"))


def rolling_runs(tiled: DataFrame, merges: dict[str, str], key: str = "customer_id", window: int = WINDOW_MS, slide: int = HOUR_MS) -> DataFrame:
    """(key, first_end, last_end, values): the windows of rolling(), a row for each run of them with the same tiles.

    Time is cut into blocks of one window. A window is the end of one block and the start of the next, so running
    aggregates of each block, forwards and backwards, give every window by one merge. Both change at a few
    points for each tile only. Keys meet once, as tiles, of which a key has no more than its time has slides.
    """
    if window % slide:
        raise ValueError("the window is a multiple of the slide")
    forth, back = Window.partitionBy(key, "block").orderBy("tile"), Window.partitionBy(key, "block").orderBy(F.desc("tile"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    running = lambda w: F.struct(*[MERGE[how][0](v).over(w.rowsBetween(*so_far)).alias(v) for v, how in merges.items()])
    own = tiled.withColumn("block", F.col("tile") - F.pmod("tile", F.lit(window))).repartition(key)
    own = own.select("*", running(forth).alias("to"), F.lag("tile").over(forth).alias("before"), F.lead("tile").over(forth).alias("after")).withColumn("from", running(back))
    kind = own.schema["to"].dataType
    none = F.lit(None).cast(kind)

    def point(at: Column, rank: int, start: Column | None = None, end: Column | None = None) -> Column:
        """From `at` on, the start or the end of windows is another one; a set one stands above (rank 1) one that ends."""
        boxed = lambda x: F.struct(x.alias("v")) if x is not None else F.lit(None).cast(f"struct<v: {kind.simpleString()}>")
        return F.struct(at.alias("point"), F.lit(rank).alias("rank"), boxed(start).alias("start"), boxed(end).alias("end"))

    tile, block = F.col("tile"), F.col("block")
    first_end, last = F.coalesce("before", block) + window + slide, F.col("after").isNull()
    points = F.array(
        point(tile + slide, 1, start=F.col("to")),
        F.when(first_end <= tile + window, point(first_end, 1, end=F.col("from"))),
        F.when(last, point(block + window + slide, 0, start=none)),
        F.when(last, point(tile + window + slide, 0, end=none)),
    )
    order = Window.partitionBy(key).orderBy("point", "rank")
    rows = own.select(key, F.explode(F.filter(points, lambda p: p.isNotNull())).alias("p")).select(key, "p.*")
    rows = rows.select(key, "point", F.last("start", True).over(order.rowsBetween(*so_far)).alias("start"), F.last("end", True).over(order.rowsBetween(*so_far)).alias("end"), F.lead("point").over(order).alias("until"))
    rows = rows.where((F.col("until") > F.col("point")) & (F.col("start.v").isNotNull() | F.col("end.v").isNotNull()))
    values = [MERGE[how][1](F.col(f"start.v.{v}"), F.col(f"end.v.{v}")).alias(v) for v, how in merges.items()]
    return rows.select(key, F.col("point").alias("first_end"), (F.col("until") - slide).alias("last_end"), *values)


def last_windows(tiled: DataFrame, merges: dict[str, str], key: str = "customer_id", window: int = WINDOW_MS, slide: int = HOUR_MS, after_ms: int | None = None, up_to_ms: int | None = None) -> DataFrame:
    """The row of rolling() with each key's last window end, of those after `after_ms` and up to `up_to_ms`; no other
    window is worked out."""
    if up_to_ms is not None:
        tiled = tiled.where(F.col("tile") + slide <= up_to_ms)
    newest = F.max("tile").over(Window.partitionBy(key)) + window
    if up_to_ms is not None:
        newest = F.least(newest, F.lit(up_to_ms - up_to_ms % slide).cast("bigint"))
    own = tiled.withColumn("window_end_ms", newest).where(F.col("tile") >= F.col("window_end_ms") - window)
    if after_ms is not None:
        own = own.where(F.col("window_end_ms") > after_ms)
    return own.groupBy(key, "window_end_ms").agg(*[MERGE[how][0](v).alias(v) for v, how in merges.items()])


def _running(points: DataFrame, key: str, slide: int, values: list[str]) -> DataFrame:
    """(key, window_end_ms, values): running sums of change points, repeated until the next point, where n > 0."""
    order = Window.partitionBy(key).orderBy("point")
    held = points.select(key, "point", *[F.sum(v).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(v) for v in values], F.lead("point").over(order).alias("until"))
    held = held.where(F.col("n") > 0)
    return held.select(key, *values, F.explode(F.sequence("point", F.col("until") - slide, F.lit(slide).cast("bigint"))).alias("window_end_ms"))


def rolling_delta(tiled: DataFrame, key: str = "customer_id", window: int = WINDOW_MS, slide: int = HOUR_MS) -> DataFrame:
    """Rolling sum and count from tiles of an exact type by change points."""
    first, after = F.col("tile") + slide, F.col("tile") + window + slide
    points = tiled.select(key, F.explode(F.array(F.struct(first.alias("point"), "s", "n"), F.struct(after.alias("point"), (-F.col("s")).alias("s"), (-F.col("n")).alias("n")))).alias("p")).select(key, "p.*")
    points = points.groupBy(key, "point").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return features(_running(points, key, slide, ["s", "n"]), key, window)


def features(rolled: DataFrame, key: str = "customer_id", window: int = WINDOW_MS) -> DataFrame:
    """Rows of s and n in the form of feature records."""
    return rolled.select(F.col(key), F.col("s").cast("double").alias("total_amount_30d"), F.col("n").cast("bigint").alias("tx_count_30d"), (F.col("window_end_ms") - window).alias("window_start_ms"), "window_end_ms")


def rolling_native(events: DataFrame, key: str = "customer_id", window: int = WINDOW_MS, slide: int = HOUR_MS, kind: str = "double") -> DataFrame:
    w = F.window(F.timestamp_millis("event_timestamp_ms"), f"{window} milliseconds", f"{slide} milliseconds")
    out = events.groupBy(key, w.alias("w")).agg(F.sum(F.col("amount").cast(kind)).alias("s"), F.count("*").alias("n"))
    return features(out.withColumn("window_end_ms", F.unix_millis("w.end")), key, window)


def rolling_sum_count(events: DataFrame, key: str = "customer_id", window: int = WINDOW_MS, slide: int = HOUR_MS, kind: str | None = None) -> DataFrame:
    """Rolling sum and count of events. Amounts are doubles, of any size, and added as such; `kind` declares an exact type that
    all of them fit, like decimal(18,2) for cents."""
    if kind is None:
        return features(rolling(tiles(events, key, slide), SUM_COUNT, key, window, slide), key, window)
    return rolling_delta(tiles(events, key, slide, kind), key, window, slide)


def sum_count_runs(events: DataFrame, key: str = "customer_id", window: int = WINDOW_MS, slide: int = HOUR_MS) -> DataFrame:
    """(key, first_end, last_end, total_amount_30d, tx_count_30d): rolling_sum_count(), a row for each run of equal windows."""
    runs = rolling_runs(tiles(events, key, slide), SUM_COUNT, key, window, slide)
    return runs.select(key, "first_end", "last_end", F.col("s").alias("total_amount_30d"), F.col("n").alias("tx_count_30d"))


def latest_sum_count(events: DataFrame, key: str = "customer_id", window: int = WINDOW_MS, slide: int = HOUR_MS, after_ms: int | None = None, up_to_ms: int | None = None) -> DataFrame:
    """The last row of each key that rolling_sum_count() has, see last_windows()."""
    return features(last_windows(tiles(events, key, slide), SUM_COUNT, key, window, slide, after_ms, up_to_ms), key, window)


def rolling_distinct(events: DataFrame, value: str, key: str = "customer_id", window: int = WINDOW_MS, slide: int = HOUR_MS) -> DataFrame:
    """(key, window_end_ms, n): how many different values a window holds. The windows that hold a value
    are merged into intervals, whose ends are the change points."""
    own = events.where(F.col(value).isNotNull()).select(key, value, floor_ms(F.col("event_timestamp_ms"), slide).alias("tile")).distinct()
    order = Window.partitionBy(key, value).orderBy("tile")
    own = own.withColumn("apart", F.coalesce(F.col("tile") - F.lag("tile").over(order) > window, F.lit(True)))
    own = own.withColumn("run", F.sum(F.col("apart").cast("int")).over(order))
    runs = own.groupBy(key, value, "run").agg((F.min("tile") + slide).alias("first"), (F.max("tile") + window + slide).alias("after"))
    points = runs.select(key, F.explode(F.array(F.struct(F.col("first").alias("point"), F.lit(1).alias("n")), F.struct(F.col("after").alias("point"), F.lit(-1).alias("n")))).alias("p")).select(key, "p.*")
    return _running(points.groupBy(key, "point").agg(F.sum("n").alias("n")), key, slide, ["n"])


def windows_of(ms: Column, window: int = WINDOW_MS, slide: int = HOUR_MS) -> Column:
    """The ends of all windows that hold a time."""
    first = floor_ms(ms, slide) + slide
    return F.sequence(first, first + window - slide, F.lit(slide).cast("bigint"))
