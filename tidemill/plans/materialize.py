"""The batch path: from stored events to the rows of an online table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.config import HOUR_MS, FeatureView
from tidemill.operators import stores
from tidemill.operators.windows import WINDOW_MS, latest_sum_count, rolling, rolling_distinct, tiles_of


def materialize(events: DataFrame, start_ms: int, end_ms: int, slide: int = HOUR_MS) -> DataFrame:
    """The last feature row of each customer with start < window end <= end. Events outside of
    [start - window, end) are not read."""
    own = events.where((F.col("event_timestamp_ms") >= start_ms - WINDOW_MS) & (F.col("event_timestamp_ms") < end_ms))
    return latest_sum_count(own, slide=slide, after_ms=start_ms, up_to_ms=end_ms)


def publish(view: FeatureView, rows: DataFrame, online: str, offline: str) -> None:
    """Writes feature rows where the view says: its last rows to the folder `online`, all of them to `offline`."""
    if view.online:
        stores.latest(rows, view.entity.join_key).write.mode("overwrite").parquet(online)
    if view.offline:
        rows.write.mode("append").parquet(offline)


def served(view: FeatureView, entities: DataFrame, online: DataFrame, now_ms: int) -> DataFrame:
    """Each entity with its online values, null if older than the view's time to live."""
    return stores.lookup(entities, online, now_ms, view.entity.join_key, int(view.ttl.total_seconds() * 1000))


#: For each function the tile values it needs, as (name, aggregate of a column, merge), and its result from them.
_FUNCTIONS = {
    "sum": ((("sum", lambda c: F.sum(c.cast("double")), "sum"),), lambda v: v("sum")),
    "count": ((("count", F.count, "sum"),), lambda v: v("count")),
    "min": ((("min", F.min, "min"),), lambda v: v("min")),
    "max": ((("max", F.max, "max"),), lambda v: v("max")),
    "avg": ((("sum", lambda c: F.sum(c.cast("double")), "sum"), ("count", F.count, "sum")), lambda v: F.when(v("count") > 0, v("sum") / v("count"))),
}


def compute(view: FeatureView, events: DataFrame) -> DataFrame:
    """The aggregates of a view for each window, named and typed by its output_schema(): (key, window_end_ms, ...).

    All but count_distinct come from one aggregation to tiles and one pass over them; each count_distinct goes by
    intervals of its own. A window counts if it has an event with a value in one of the columns. All aggregations of a
    view share one window and slide.
    """
    key, kinds = view.entity.join_key, dict(view.output_schema())
    if len({(a.window, a.slide) for a in view.aggregations}) != 1:
        raise ValueError("the aggregations of a view share one window and slide")
    first = view.aggregations[0]
    window, slide = (int(x.total_seconds() * 1000) for x in (first.window, first.slide))
    merged = [a for a in view.aggregations if a.function != "count_distinct"]
    if wrong := [a.function for a in merged if a.function not in _FUNCTIONS]:
        raise ValueError(f"unknown aggregate function: {wrong[0]}")
    parts = []
    if merged:
        columns = sorted({a.column for a in merged})
        name = lambda a, part: f"{part}_{columns.index(a.column)}"
        values = {name(a, part): (agg(F.col(a.column)), how) for a in merged for part, agg, how in _FUNCTIONS[a.function][0]}
        used = events.where(reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in columns]))
        rolled = rolling(tiles_of(used, {n: v for n, (v, _) in values.items()}, key, slide), {n: how for n, (_, how) in values.items()}, key, window, slide)
        result = [_FUNCTIONS[a.function][1](lambda part, a=a: F.col(name(a, part))).cast(kinds[a.resolved_name()]).alias(a.resolved_name()) for a in merged]
        parts.append(rolled.select(key, "window_end_ms", *result))
    for a in view.aggregations:
        if a.function == "count_distinct":
            n = F.col("n").cast(kinds[a.resolved_name()]).alias(a.resolved_name())
            parts.append(rolling_distinct(events, a.column, key, window, slide).select(key, "window_end_ms", n))
    out = reduce(lambda x, y: x.join(y, [key, "window_end_ms"], "full_outer"), parts)
    return out.select(key, "window_end_ms", *[a.resolved_name() for a in view.aggregations])
