"""All queries of the feature engine by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import DAY_MS, HOUR_MS, Aggregation, Entity, FeatureView
from tidemill.functions import forms
from tidemill.functions.validation import invalid, record_error, valid, validated
from tidemill.operators import dedup, stores, windows
from tidemill.plans import materialize as plans
from tidemill.plans.parity import as_of, close, mismatches, parity
from tidemill.sources import tables
from tidemill.sources.contracts import RAW, RAW_FIELDS
from tidemill.sources.streams import StreamSource
from tidemill.streaming import jobs, runs, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Shared parts of the SQL: events in the raw form, manufactured repeats and the rolling features.
_RAW = "raw AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id, value AS amount, epoch_us(ts) // 1000 AS event_timestamp_ms FROM events)"
#: Sums of doubles depend on the order of adding in their last bits, so totals are compared to six places.
_TILES = "tiles AS (SELECT user_id, date_trunc('hour', ts) AS h, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2)"
_ROLLED = _TILES + """,
dealt AS (SELECT user_id, s, n, unnest(generate_series(h + INTERVAL 1 HOUR, h + INTERVAL 30 DAY, INTERVAL 1 HOUR)) AS we FROM tiles),
rolled AS (SELECT CAST(user_id AS VARCHAR) AS customer_id, round(sum(s), 6) AS total_amount_30d, CAST(sum(n) AS BIGINT) AS tx_count_30d,
  epoch_ms(we) - 2592000000 AS window_start_ms, epoch_ms(we) AS window_end_ms FROM dealt GROUP BY user_id, we)"""
_LATEST = _ROLLED + ", latest AS (SELECT * FROM rolled QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY window_end_ms DESC) = 1)"
#: Exact repeats of every tenth event and conflicting ones of every twenty-fifth, arriving later.
_REPEATS = _RAW + """,
repeats AS (SELECT *, CAST(event_id AS BIGINT) AS arrival FROM raw
  UNION ALL SELECT *, 10000000000 + CAST(event_id AS BIGINT) FROM raw WHERE CAST(event_id AS BIGINT) % 10 = 0
  UNION ALL SELECT event_id, customer_id, amount + 1, event_timestamp_ms, 20000000000 + CAST(event_id AS BIGINT) FROM raw WHERE CAST(event_id AS BIGINT) % 25 = 0)"""
_PAYLOADS = """payloads AS (SELECT event_id AS id, CASE event_id % 10 WHEN 0 THEN 'not-json' WHEN 1 THEN concat('{"event_id":"', event_id, '"}')
  WHEN 2 THEN concat('{"event_id":"', event_id, '","customer_id":"', user_id, '","amount":"1","event_timestamp_ms":', epoch_us(ts) // 1000, '}')
  WHEN 3 THEN concat('{"event_id":"', event_id, '","customer_id":"', user_id, '","amount":true,"event_timestamp_ms":', epoch_us(ts) // 1000, '}')
  WHEN 4 THEN concat('{"event_id":"', event_id, '","customer_id":"', user_id, '","amount":1,"event_timestamp_ms":', epoch_us(ts) // 1000, '.5}')
  WHEN 5 THEN concat('{"event_id":"', event_id, '","customer_id":"  ","amount":1,"event_timestamp_ms":', epoch_us(ts) // 1000, '}')
  ELSE concat('{"event_id":"', event_id, '","customer_id":"', user_id, '","amount":', CAST(round(value * 100) AS BIGINT), ',"event_timestamp_ms":', epoch_us(ts) // 1000, '}') END AS value,
  user_id, epoch_us(ts) // 1000 AS ms, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""
_INVALID = _PAYLOADS + """,
invalid AS (SELECT CASE id % 10 WHEN 0 THEN 'invalid JSON: malformed document' WHEN 1 THEN 'expected exactly these fields: [''amount'', ''customer_id'', ''event_id'', ''event_timestamp_ms'']'
  WHEN 2 THEN 'amount must be numeric' WHEN 3 THEN 'amount must be numeric' WHEN 4 THEN 'event_timestamp_ms must be an int64' WHEN 5 THEN 'customer_id must be a non-empty string' END || '; payload=' || value AS value
  FROM payloads WHERE id % 10 <= 5)"""
_CONFLICTS = """conflicts AS (SELECT 'conflicting duplicate event_id=' || event_id AS value FROM repeats WHERE arrival >= 20000000000)"""


def _query(name: str, sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _six(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns (total_amount_30d, if none is named) to six places, for comparison."""
    return rows.withColumns({c: F.round(c, 6) for c in columns or ("total_amount_30d",)})


def _rolled(spark: SparkSession, d: str) -> DataFrame:
    return _six(windows.rolling_sum_count(tables.events(spark, d)))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    """The row of each customer's last window."""
    return _six(windows.latest_sum_count(tables.events(spark, d)))


def _repeats(spark: SparkSession, d: str) -> DataFrame:
    raw, number = tables.events(spark, d), F.col("event_id").cast("bigint")
    same = raw.where(number % 10 == 0).withColumn("arrival", number + 10_000_000_000)
    other = raw.where(number % 25 == 0).withColumn("amount", F.col("amount") + 1).withColumn("arrival", number + 20_000_000_000)
    return raw.withColumn("arrival", number).unionByName(same).unionByName(other)


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    full = lambda customer, amount, ms: F.concat(F.lit('{"event_id":"'), "event_id", F.lit('","customer_id":"'), customer, F.lit('","amount":'), amount, F.lit(',"event_timestamp_ms":'), ms, F.lit("}"))
    user, ms, kind = F.col("user_id").cast("string"), F.col("ms").cast("string"), F.col("event_id") % 10
    value = (
        F.when(kind == 0, F.lit("not-json"))
        .when(kind == 1, F.concat(F.lit('{"event_id":"'), "event_id", F.lit('"}')))
        .when(kind == 2, full(user, F.lit('"1"'), ms))
        .when(kind == 3, full(user, F.lit("true"), ms))
        .when(kind == 4, full(user, F.lit("1"), F.concat(ms, F.lit(".5"))))
        .when(kind == 5, full(F.lit("  "), F.lit("1"), ms))
        .otherwise(full(user, F.col("cents").cast("string"), ms))
    )
    return e.select("event_id", value.alias("value"))


@_query("scan_events", f"WITH {_RAW} SELECT * FROM raw")
def scan_events(spark, d):
    return tables.events(spark, d)


@_query("event_time", "SELECT event_id, epoch_us(ts) // 1000 AS event_timestamp_ms, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi FROM events")
def event_time(spark, d):
    e = tables.events(spark, d).withColumn("t", forms.event_time(F.col("event_timestamp_ms")))
    return e.select(F.col("event_id").cast("bigint").alias("event_id"), F.unix_millis("t").alias("event_timestamp_ms"), *[F.expr(f"CAST({f}(t) AS BIGINT)").alias(n) for f, n in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"), ("minute", "mi"))])


@_query("batch_row", f"WITH {_RAW} SELECT *, event_timestamp_ms AS event_ms, event_timestamp_ms AS created_ms FROM raw")
def batch_row(spark, d):
    rows = forms.batch_rows(tables.events(spark, d))
    return rows.select(*RAW_FIELDS, F.unix_millis("event_timestamp").alias("event_ms"), F.unix_millis("created_timestamp").alias("created_ms"))


@_query("event_json", f"WITH {_RAW} SELECT event_id, customer_id, amount, event_timestamp_ms FROM raw")
def event_json(spark, d):
    return tables.events(spark, d).select(F.from_json(forms.event_json(), RAW).alias("r")).select("r.*")


@_query("feature_json", f"WITH {_LATEST} SELECT customer_id, total_amount_30d, tx_count_30d, window_start_ms, window_end_ms FROM latest")
def feature_json(spark, d):
    text = forms.with_metadata(_latest(spark, d)).select(forms.feature_json().alias("j"))
    return text.select(F.from_json("j", jobs.FEATURE_DDL).alias("r")).select("r.*")


@_query("validate_valid", f"WITH {_PAYLOADS} SELECT CAST(id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id, CAST(cents AS DOUBLE) AS amount, ms AS event_timestamp_ms FROM payloads WHERE id % 10 > 5")
def validate_valid(spark, d):
    return valid(validated(_payloads(spark, d).select("value")))


@_query("validate_invalid", f"WITH {_INVALID} SELECT value FROM invalid")
def validate_invalid(spark, d):
    return invalid(validated(_payloads(spark, d).select("value")))


@_query("hour_tiles", f"WITH {_TILES} SELECT CAST(user_id AS VARCHAR) AS customer_id, epoch_ms(h) AS tile, round(s, 6) AS s, CAST(n AS BIGINT) AS n FROM tiles")
def hour_tiles(spark, d):
    return _six(windows.tiles(tables.events(spark, d)), "s")


@_query("tile_merge", f"WITH {_TILES} SELECT CAST(user_id AS VARCHAR) AS customer_id, epoch_ms(date_trunc('day', h)) AS day_ms, round(sum(s), 6) AS s, CAST(sum(n) AS BIGINT) AS n FROM tiles GROUP BY ALL")
def tile_merge(spark, d):
    t = windows.tiles(tables.events(spark, d))
    return t.groupBy("customer_id", forms.floor_ms(F.col("tile"), DAY_MS).alias("day_ms")).agg(F.round(F.sum("s"), 6).alias("s"), F.sum("n").alias("n"))


@_query("agg_sum_count", "SELECT CAST(user_id AS VARCHAR) AS customer_id, round(sum(value), 6) AS total_amount, count(*) AS tx_count FROM events GROUP BY 1")
def agg_sum_count(spark, d):
    return tables.events(spark, d).groupBy("customer_id").agg(F.round(F.sum("amount"), 6).alias("total_amount"), F.count("*").alias("tx_count"))


@_query("customer_30d", f"WITH {_ROLLED} SELECT * FROM rolled")
def customer_30d(spark, d):
    return _rolled(spark, d)


@_query("customer_30d_tiled", f"WITH {_ROLLED} SELECT customer_id, window_end_ms, total_amount_30d, tx_count_30d FROM rolled")
def customer_30d_tiled(spark, d):
    """From the tiles of customers and hours that a tiled view keeps."""
    tiled = windows.tiles(tables.events(spark, d))
    return _six(windows.features(windows.rolling(tiled, windows.SUM_COUNT))).select("customer_id", "window_end_ms", "total_amount_30d", "tx_count_30d")


@_query("customer_30d_cents", f"WITH {_ROLLED} SELECT * FROM rolled")
def customer_30d_cents(spark, d):
    """Amounts that are declared as cents go by change points."""
    return _six(windows.rolling_sum_count(tables.events(spark, d), kind="decimal(18,2)"))


#: Amounts of four places, and three events of an enormous amount beside a small one for every 500th.
_WIDE = """wide AS (SELECT CAST(user_id AS VARCHAR) AS customer_id, value / 100 + event_id % 10 * 0.0001 AS amount, epoch_us(ts) // 1000 AS ms FROM events
  UNION ALL SELECT concat('w', event_id), unnest([1e17, 0.125, 1e300]), epoch_us(ts) // 1000 + unnest([0, 86400000, 5184000000]) FROM events WHERE event_id % 500 = 0),
wide_tiles AS (SELECT customer_id, ms // 3600000 * 3600000 AS h, sum(amount) AS s, count(*) AS n FROM wide GROUP BY 1, 2),
wide_rolled AS (SELECT customer_id, sum(s) AS total, CAST(sum(n) AS BIGINT) AS n, we AS window_end_ms
  FROM (SELECT customer_id, s, n, unnest(generate_series(h + 3600000, h + 2592000000, 3600000)) AS we FROM wide_tiles) GROUP BY customer_id, we)"""


@_query("customer_30d_wide", f"WITH {_WIDE} SELECT customer_id, window_end_ms, CASE WHEN total < 1e12 THEN round(total, 6) ELSE total END AS total, n FROM wide_rolled")
def customer_30d_wide(spark, d):
    e = tables.read(spark, d, "events").select("event_id", "user_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("event_timestamp_ms"))
    own = e.select(F.col("user_id").cast("string").alias("customer_id"), (F.col("value") / 100 + F.col("event_id") % 10 * F.lit(0.0001)).alias("amount"), "event_timestamp_ms")
    more = F.explode(F.array(*[F.struct(F.lit(a).alias("amount"), F.lit(days * DAY_MS).alias("later")) for a, days in ((1e17, 0), (0.125, 1), (1e300, 60))]))
    whales = e.where("event_id % 500 = 0").select(F.concat(F.lit("w"), "event_id").alias("customer_id"), "event_timestamp_ms", more.alias("m"))
    whales = whales.select("customer_id", "m.amount", (F.col("event_timestamp_ms") + F.col("m.later")).alias("event_timestamp_ms"))
    rows = windows.rolling_sum_count(own.unionByName(whales))
    total = F.when(F.col("total_amount_30d") < 1e12, F.round("total_amount_30d", 6)).otherwise(F.col("total_amount_30d"))
    return rows.select("customer_id", "window_end_ms", total.alias("total"), F.col("tx_count_30d").alias("n"))


@_query(
    "customer_30d_orders",
    """WITH t AS (SELECT o_custkey AS k, date_trunc('day', o_orderdate) AS h, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1, 2),
x AS (SELECT k, s, n, unnest(generate_series(h + INTERVAL 1 DAY, h + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS we FROM t)
SELECT CAST(k AS VARCHAR) AS customer_id, round(sum(s), 6) AS total_amount_30d, CAST(sum(n) AS BIGINT) AS tx_count_30d, epoch_ms(we) - 2592000000 AS window_start_ms, epoch_ms(we) AS window_end_ms FROM x GROUP BY k, we""",
)
def customer_30d_orders(spark, d):
    return _six(windows.rolling_sum_count(tables.orders(spark, d), slide=DAY_MS))


@_query("view_aggregates", f"""WITH {_TILES.replace("count(*) AS n", "count(*) AS n, min(value) AS lo, max(value) AS hi")},
x AS (SELECT user_id, s, n, lo, hi, unnest(generate_series(date_trunc('day', h) + INTERVAL 1 DAY, date_trunc('day', h) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS we FROM tiles)
SELECT CAST(user_id AS VARCHAR) AS customer_id, epoch_ms(we) AS window_end_ms, round(sum(s), 6) AS total_7d, CAST(sum(n) AS BIGINT) AS n_7d, min(lo) AS least_7d, max(hi) AS most_7d FROM x GROUP BY user_id, we""")
def view_aggregates(spark, d):
    from datetime import timedelta

    how = {"window": timedelta(days=7), "slide": timedelta(days=1)}
    names = (("sum", "total_7d"), ("count", "n_7d"), ("min", "least_7d"), ("max", "most_7d"))
    view = FeatureView("week", Entity(), tuple(Aggregation("amount", f, name=n, **how) for f, n in names), (("amount", "double"),))
    return _six(plans.compute(view, tables.events(spark, d)), "total_7d")


@_query("iso_window_end", f"WITH {_ROLLED} SELECT DISTINCT window_end_ms, strftime(make_timestamp(window_end_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS event_timestamp FROM rolled")
def iso_window_end(spark, d):
    return _rolled(spark, d).select("window_end_ms").distinct().withColumn("event_timestamp", forms.iso_timestamp(F.col("window_end_ms")))


@_query("window_boundaries", """WITH p AS (SELECT event_id, unnest([epoch_ms(date_trunc('hour', ts)), epoch_ms(date_trunc('hour', ts)) + 3599999, epoch_ms(date_trunc('hour', ts)) + 3600000]) AS ms FROM events)
SELECT event_id, ms, ms // 3600000 * 3600000 + 3600000 AS first_end, ms // 3600000 * 3600000 + 2592000000 AS last_end FROM p""")
def window_boundaries(spark, d):
    e = tables.events(spark, d).select(F.col("event_id").cast("bigint").alias("event_id"), forms.floor_ms(F.col("event_timestamp_ms")).alias("h"))
    e = e.select("event_id", F.explode(F.array(F.col("h"), F.col("h") + HOUR_MS - 1, F.col("h") + HOUR_MS)).alias("ms")).withColumn("ends", windows.windows_of(F.col("ms")))
    return e.select("event_id", "ms", F.element_at("ends", 1).alias("first_end"), F.element_at("ends", -1).alias("last_end"))


@_query("windows_per_event", "SELECT event_id, CAST(720 AS BIGINT) AS n FROM events")
def windows_per_event(spark, d):
    e = tables.events(spark, d)
    return e.select(F.col("event_id").cast("bigint").alias("event_id"), F.size(windows.windows_of(F.col("event_timestamp_ms"))).cast("bigint").alias("n"))


@_query("dedup_first", f"WITH {_RAW} SELECT * FROM raw")
def dedup_first(spark, d):
    return dedup.first_events(_repeats(spark, d))


@_query("dedup_conflicts", f"WITH {_REPEATS}, {_CONFLICTS} SELECT value FROM conflicts")
def dedup_conflicts(spark, d):
    return dedup.conflicts(_repeats(spark, d))


@_query("dedup_total", "SELECT CAST(user_id AS VARCHAR) AS customer_id, round(sum(value), 6) AS total_amount, count(*) AS n FROM events GROUP BY 1")
def dedup_total(spark, d):
    return dedup.first_events(_repeats(spark, d)).groupBy("customer_id").agg(F.round(F.sum("amount"), 6).alias("total_amount"), F.count("*").alias("n"))


@_query("union_invalid", f"WITH {_INVALID}, {_REPEATS}, {_CONFLICTS} SELECT value FROM invalid UNION ALL SELECT value FROM conflicts")
def union_invalid(spark, d):
    return invalid(validated(_payloads(spark, d).select("value"))).unionByName(dedup.conflicts(_repeats(spark, d)))


#: Events 20 and 62 days older than every 25th: partly late and fully late once all events were seen.
_OLD = _RAW + """,
old AS (SELECT concat('o20-', event_id) AS event_id, customer_id, amount, event_timestamp_ms - 1728000000 AS event_timestamp_ms FROM raw WHERE CAST(event_id AS BIGINT) % 25 = 0
  UNION ALL SELECT concat('o62-', event_id), customer_id, amount, event_timestamp_ms - 5356800000 FROM raw WHERE CAST(event_id AS BIGINT) % 25 = 0),
mark AS (SELECT max(event_timestamp_ms) - 3600000 AS m FROM raw)"""


def _old(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(events so old, a single row with the watermark)."""
    raw = tables.events(spark, d)
    own = raw.where(F.col("event_id").cast("bigint") % 25 == 0)
    old = [own.select(F.concat(F.lit(f"o{days}-"), "event_id").alias("event_id"), "customer_id", "amount", (F.col("event_timestamp_ms") - days * DAY_MS).alias("event_timestamp_ms")) for days in (20, 62)]
    return old[0].unionByName(old[1]), raw.agg((F.max("event_timestamp_ms") - HOUR_MS).alias("m"))


@_query("late_events", f"WITH {_OLD} SELECT old.* FROM old, mark WHERE event_timestamp_ms // 3600000 * 3600000 + 2592000000 <= m")
def late_events(spark, d):
    old, mark = _old(spark, d)
    return old.join(F.broadcast(mark), forms.floor_ms(F.col("event_timestamp_ms")) + windows.WINDOW_MS <= F.col("m")).drop("m")


@_query("on_time_partial", f"""WITH {_OLD}, kept AS (SELECT old.*, m FROM old, mark WHERE event_timestamp_ms // 3600000 * 3600000 + 2592000000 > m)
SELECT event_id, greatest(event_timestamp_ms // 3600000 * 3600000 + 3600000, m // 3600000 * 3600000 + 3600000) AS first_open, event_timestamp_ms // 3600000 * 3600000 + 2592000000 AS last_open FROM kept""")
def on_time_partial(spark, d):
    old, mark = _old(spark, d)
    hour = forms.floor_ms(F.col("event_timestamp_ms"))
    kept = old.join(F.broadcast(mark), hour + windows.WINDOW_MS > F.col("m"))
    return kept.select("event_id", F.greatest(hour, forms.floor_ms(F.col("m"))).alias("h"), (hour + windows.WINDOW_MS).alias("last_open")).select("event_id", (F.col("h") + HOUR_MS).alias("first_open"), "last_open")


@_query("offline_scan", f"WITH {_ROLLED} SELECT customer_id, total_amount_30d, tx_count_30d, window_end_ms AS event_ms FROM rolled")
def offline_scan(spark, d):
    path = runs.shared_folder(spark, "offline")
    rows = forms.with_metadata(_rolled(spark, d)).select("customer_id", "total_amount_30d", "tx_count_30d", F.to_timestamp("event_timestamp").alias("event_timestamp"), F.to_date(F.timestamp_millis("window_end_ms")).alias("day"))
    rows.repartition("day").write.partitionBy("day").parquet(f"{path}/customer_30d")
    back = spark.read.parquet(f"{path}/customer_30d")
    return back.select("customer_id", "total_amount_30d", "tx_count_30d", F.unix_millis("event_timestamp").alias("event_ms"))


@_query("online_latest", f"WITH {_LATEST} SELECT * FROM latest")
def online_latest(spark, d):
    return _latest(spark, d)


_ENTITIES = "entities AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS customer_id FROM events UNION ALL SELECT 'nobody')"


def _entities(spark: SparkSession, d: str) -> DataFrame:
    own = tables.read(spark, d, "events").select(F.col("user_id").cast("string").alias("customer_id")).distinct()
    return own.unionByName(spark.createDataFrame([("nobody",)], "customer_id string"))


def _found(rows: DataFrame) -> DataFrame:
    """For the comparison, -1 stands for the null values of rows without features."""
    return rows.withColumn("found", F.col("window_end_ms").isNotNull()).na.fill(-1)


def _found_sql(values: str, rows: str) -> str:
    filled = ", ".join(f"coalesce({v}, -1) AS {v}" for v in values.split())
    return f"SELECT * EXCLUDE ({', '.join(values.split())}), {filled}, window_end_ms IS NOT NULL AS found FROM ({rows})"


@_query("online_lookup", f"WITH {_LATEST}, {_ENTITIES} " + _found_sql("total_amount_30d tx_count_30d window_start_ms window_end_ms", "SELECT * FROM entities LEFT JOIN latest USING (customer_id)"))
def online_lookup(spark, d):
    return _found(stores.lookup(_entities(spark, d), _latest(spark, d)))


_ORDERS_LATEST = """t AS (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, max(epoch_ms(date_trunc('day', o_orderdate))) + 2592000000 AS window_end_ms FROM orders GROUP BY 1),
v AS (SELECT t.customer_id, round(sum(o_totalprice), 6) AS total_amount_30d, count(*) AS tx_count_30d, window_end_ms FROM t JOIN orders ON CAST(o_custkey AS VARCHAR) = t.customer_id AND epoch_ms(o_orderdate) >= window_end_ms - 2592000000 AND epoch_ms(o_orderdate) < window_end_ms GROUP BY ALL)"""


@_query("online_ttl", f"""WITH {_ORDERS_LATEST}, e AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id FROM customer)
""" + _found_sql("total_amount_30d tx_count_30d window_end_ms", """SELECT customer_id, CASE WHEN ok THEN total_amount_30d END AS total_amount_30d, CASE WHEN ok THEN tx_count_30d END AS tx_count_30d, CASE WHEN ok THEN window_end_ms END AS window_end_ms
FROM (SELECT e.customer_id, v.* EXCLUDE (customer_id), window_end_ms >= 996624000000 - 2678400000 AS ok FROM e LEFT JOIN v ON e.customer_id = v.customer_id)"""))
def online_ttl(spark, d):
    online = _six(windows.latest_sum_count(tables.orders(spark, d), slide=DAY_MS)).drop("window_start_ms")
    entities = tables.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"))
    return _found(stores.lookup(entities, online, now_ms=996_624_000_000))


@_query("latest_created", f"WITH {_REPEATS} SELECT event_id, amount, arrival FROM repeats QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival DESC) = 1")
def latest_created(spark, d):
    return stores.latest(_repeats(spark, d), key="event_id", order=("arrival",)).select("event_id", "amount", "arrival")


@_query("parity_all", f"WITH {_ROLLED} SELECT customer_id, window_end_ms, total_amount_30d AS left_total, tx_count_30d AS left_count, total_amount_30d AS right_total, tx_count_30d AS right_count, true AS same FROM rolled")
def parity_all(spark, d):
    """Two independent ways to the same features: sums of doubles by merging, and of cents by change points."""
    e = tables.events(spark, d)
    return _six(parity(windows.rolling_sum_count(e), windows.rolling_sum_count(e, kind="decimal(18,2)")), "left_total", "right_total")


@_query("parity_mismatches", f"WITH {_ROLLED} SELECT customer_id, window_end_ms, total_amount_30d AS left_total, tx_count_30d AS left_count, total_amount_30d AS right_total, tx_count_30d + 1 AS right_count, false AS same FROM rolled WHERE customer_id = '7'")
def parity_mismatches(spark, d):
    rows = _rolled(spark, d)
    return mismatches(rows, rows.withColumn("tx_count_30d", F.col("tx_count_30d") + (F.col("customer_id") == "7").cast("bigint")))


@_query("parity_point", f"WITH {_ROLLED} SELECT * FROM rolled WHERE customer_id = '3' AND window_end_ms = 1705276800000")
def parity_point(spark, d):
    return _rolled(spark, d).where((F.col("customer_id") == "3") & (F.col("window_end_ms") == 1_705_276_800_000))


@_query("float_close", "SELECT event_id, value AS a, value * (1 + 1e-12) AS b, true AS same FROM events WHERE value <> 0")
def float_close(spark, d):
    e = tables.read(spark, d, "events").where("value <> 0").select("event_id", F.col("value").alias("a"), (F.col("value") * (1 + 1e-12)).alias("b"))
    return e.withColumn("same", close(F.col("a"), F.col("b")))


_LEDGER = _LATEST + ", ledger AS (SELECT customer_id, window_end_ms FROM latest WHERE CAST(customer_id AS BIGINT) % 3 = 0)"


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    online = _latest(spark, d)
    return online, online.where(F.col("customer_id").cast("bigint") % 3 == 0).select(*stores.LEDGER_KEY)


@_query("ledger_anti", f"WITH {_LEDGER} SELECT * FROM latest ANTI JOIN ledger USING (customer_id, window_end_ms)")
def ledger_anti(spark, d):
    return stores.unpushed(*_ledger(spark, d))


@_query("ledger_semi", f"WITH {_LEDGER} SELECT * FROM latest SEMI JOIN ledger USING (customer_id, window_end_ms)")
def ledger_semi(spark, d):
    return stores.already_pushed(*_ledger(spark, d))


@_query("ledger_upsert", f"WITH {_LEDGER} SELECT customer_id, window_end_ms FROM latest")
def ledger_upsert(spark, d):
    online, ledger = _ledger(spark, d)
    return stores.mark_pushed(ledger, online.unionByName(online))


@_query("push_payload", f"""WITH {_LATEST}
SELECT CAST(customer_id AS BIGINT) // 100 AS batch, 'flink_customer_30d_push' AS push_source_name, 'online_and_offline' AS "to", string_agg(customer_id, ',' ORDER BY customer_id) AS customers,
  string_agg(CAST(tx_count_30d AS VARCHAR), ',' ORDER BY customer_id) AS counts, string_agg(strftime(make_timestamp(window_end_ms * 1000), '%Y-%m-%dT%H:%M:%SZ'), ',' ORDER BY customer_id) AS times FROM latest GROUP BY 1""")
def push_payload(spark, d):
    rows = forms.with_metadata(_latest(spark, d))
    p = forms.push_payloads(rows, F.floor(F.col("customer_id").cast("bigint") / 100))
    return p.select("batch", "push_source_name", "to", F.array_join("df.customer_id", ",").alias("customers"), F.array_join(F.col("df.tx_count_30d").cast("array<string>"), ",").alias("counts"), F.array_join("df.event_timestamp", ",").alias("times"))


@_query("push_reject", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'Missing aggregate fields: [''created_timestamp'', ''event_timestamp'']' END AS reason, CAST(event_id % 4 AS INTEGER) AS source_partition, event_id AS source_offset FROM events WHERE event_id % 3 < 2""")
def push_reject(spark, d):
    e = tables.read(spark, d, "events").select("event_id")
    some = '{"customer_id":"c","total_amount_30d":1.0,"tx_count_30d":1,"window_end_ms":0'
    value = F.when(F.col("event_id") % 3 == 0, "[1]").when(F.col("event_id") % 3 == 1, some + "}").otherwise(some + ',"event_timestamp":"t","created_timestamp":"t","more":1}')
    messages = e.select("event_id", value.alias("value"), F.lit("t").alias("topic"), (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset")).withColumn("error", record_error(F.col("value")))
    letters = stores.dead_letters(messages.where("error IS NOT NULL"), F.col("error"))
    return letters.select(F.col("source_offset").alias("event_id"), "reason", "source_partition", "source_offset")


@_query("push_merge", f"WITH {_LATEST} SELECT customer_id, CASE WHEN CAST(customer_id AS BIGINT) % 2 = 0 THEN total_amount_30d + 1 ELSE total_amount_30d END AS total_amount_30d, window_end_ms + CASE WHEN CAST(customer_id AS BIGINT) % 2 = 0 THEN 3600000 ELSE 0 END AS window_end_ms FROM latest")
def push_merge(spark, d):
    online = _latest(spark, d)
    even = F.col("customer_id").cast("bigint") % 2 == 0
    newer = online.where(even).withColumns({"total_amount_30d": F.col("total_amount_30d") + 1, "window_end_ms": F.col("window_end_ms") + HOUR_MS})
    older = online.where(~even).withColumn("window_end_ms", F.col("window_end_ms") - HOUR_MS)
    return stores.push_online(online, newer.unionByName(older)).select("customer_id", "total_amount_30d", "window_end_ms")


@_query("commit_offsets", "SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS \"partition\", max(event_id) + 1 AS \"offset\" FROM events GROUP BY 1, 2")
def commit_offsets(spark, d):
    return stores.next_offsets(tables.read(spark, d, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset")))


@_query("row_count", "SELECT count(*) AS n, count(*) >= 5 AS enough FROM events")
def row_count(spark, d):
    return tables.events(spark, d).agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 5)


@_query("first_match", f"WITH {_ROLLED} SELECT * FROM rolled WHERE customer_id = '1' AND tx_count_30d >= 3 ORDER BY window_end_ms LIMIT 1")
def first_match(spark, d):
    return _rolled(spark, d).where((F.col("customer_id") == "1") & (F.col("tx_count_30d") >= 3)).orderBy("window_end_ms").limit(1)


@_query("materialize_range", f"WITH {_ROLLED} SELECT * FROM rolled WHERE window_end_ms > 1704844800000 AND window_end_ms <= 1705708800000 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY window_end_ms DESC) = 1")
def materialize_range(spark, d):
    return _six(plans.materialize(tables.events(spark, d), 1_704_844_800_000, 1_705_708_800_000))


@_query("count_distinct_30d", """WITH t AS (SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS h FROM events),
x AS (SELECT user_id, event_type, unnest(generate_series(h + INTERVAL 1 HOUR, h + INTERVAL 30 DAY, INTERVAL 1 HOUR)) AS we FROM t)
SELECT CAST(user_id AS VARCHAR) AS customer_id, epoch_ms(we) AS window_end_ms, count(DISTINCT event_type) AS n FROM x GROUP BY user_id, we""")
def count_distinct_30d(spark, d):
    e = tables.read(spark, d, "events").select(F.col("user_id").cast("string").alias("customer_id"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("event_timestamp_ms"))
    return windows.rolling_distinct(e, "event_type").select("customer_id", "window_end_ms", "n")


@_query("asof_features", f"""WITH {_ROLLED}, e AS (SELECT CAST(user_id AS VARCHAR) AS customer_id, epoch_us(ts) // 1000 AS at_ms, event_id FROM events)
""" + _found_sql("window_end_ms tx_count_30d", """SELECT e.customer_id, e.at_ms, e.event_id, CASE WHEN r.window_end_ms >= e.at_ms - 2678400000 THEN r.window_end_ms END AS window_end_ms, CASE WHEN r.window_end_ms >= e.at_ms - 2678400000 THEN r.tx_count_30d END AS tx_count_30d
FROM e ASOF LEFT JOIN rolled r ON e.customer_id = r.customer_id AND e.at_ms >= r.window_end_ms"""))
def asof_features(spark, d):
    e = tables.events(spark, d).select("customer_id", F.col("event_timestamp_ms").alias("at_ms"), F.col("event_id").cast("bigint").alias("event_id"))
    runs_ = windows.sum_count_runs(tables.events(spark, d)).drop("total_amount_30d")
    return _found(as_of(e, runs_, 31 * DAY_MS))


def _stream(spark: SparkSession, batches: list[DataFrame]) -> str:
    """Runs the feature stream over one micro-batch after the other; the folder that it wrote."""
    base = runs.shared_folder(spark, "stream")
    for rows in batches:  # each run takes what is new and ends, as a restart from the same checkpoint does
        rows.select(*RAW_FIELDS).write.mode("append").parquet(f"{base}/in")
        source = StreamSource("parquet", f"{base}/in").read(spark)
        jobs.rolling(spark, source, base, f"{base}/checkpoint").awaitTermination()
    return base


@_query("stream_features", f"WITH {_ROLLED} SELECT rolled.* FROM rolled, (SELECT max(epoch_us(ts) // 1000) - 3600000 AS m FROM events) WHERE window_end_ms <= m")
def stream_features(spark, d):
    return _six(sinks.written(spark, _stream(spark, [tables.events(spark, d)]), "feature", jobs.FEATURE_DDL))


@_query("stream_late", f"WITH {_OLD} SELECT old.* FROM old, mark WHERE event_timestamp_ms // 3600000 * 3600000 + 2592000000 <= m")
def stream_late(spark, d):
    return sinks.written(spark, _stream(spark, [tables.events(spark, d), _old(spark, d)[0]]), "late", RAW)


def _ingested(spark: SparkSession, d: str) -> str:
    """Runs the ingest stream over repeated events, first ones before their repeats, and malformed payloads."""
    base = runs.shared_folder(spark, "ingest")
    rows = _repeats(spark, d)
    for part in (F.col("arrival") < 10_000_000_000, F.col("arrival") >= 10_000_000_000):
        rows.where(part).select(forms.event_json().alias("value")).write.mode("append").text(f"{base}/in")
        query = jobs.ingest(spark, StreamSource("text", f"{base}/in").read(spark), base, f"{base}/checkpoint", "1 second")
        runs.drain(query)
    return base


@_query("stream_dedup", f"WITH {_RAW} SELECT * FROM raw")
def stream_dedup(spark, d):
    return sinks.written(spark, _ingested(spark, d), "valid", RAW)


@_query("stream_invalid", f"WITH {_REPEATS}, {_CONFLICTS} SELECT value FROM conflicts")
def stream_invalid(spark, d):
    return sinks.written(spark, _ingested(spark, d), "invalid", "value string")
