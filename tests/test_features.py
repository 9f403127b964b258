from datetime import timedelta

import pytest

from tidemill.config import CUSTOMER_30D, DAY_MS, HOUR_MS, Aggregation, Entity, FeatureView
from tidemill.functions import forms
from tidemill.operators import dedup, stores, windows
from tidemill.plans.materialize import compute, materialize, publish, served
from tidemill.plans.parity import mismatches
from tidemill.sources.contracts import RAW
from tidemill.sources.tables import ensure_tables, fixture_events

H = 1_790_251_200_000


def events(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_fixture_totals(spark):
    raw = fixture_events(spark, H)
    own = raw.where("customer_id = 'customer-001'")
    assert own.count() == 4
    assert dedup.first_events(own).count() == 3
    rolled = windows.rolling_sum_count(dedup.first_events(raw))
    got = {(r.customer_id, (r.window_end_ms - H) // HOUR_MS): (r.total_amount_30d, r.tx_count_30d) for r in rolled.where(f"window_end_ms <= {H - HOUR_MS}").collect()}
    assert got == {("customer-001", -3): (30.0, 2), ("customer-001", -2): (60.0, 3), ("customer-001", -1): (60.0, 3), ("customer-002", -2): (7.5, 1), ("customer-002", -1): (7.5, 1)}


def test_forms_agree(spark, small):
    from tidemill.sources.tables import events as load

    own = load(spark, small).where("customer_id < '3'")
    delta = windows.rolling_sum_count(own)
    tiled = windows.rolling_sum_count(own, kind=None)
    assert delta.count() > 1000
    assert mismatches(delta, tiled).count() == 0
    short = {"window": 6 * HOUR_MS}
    assert mismatches(windows.rolling_sum_count(own, **short), windows.rolling_native(own, **short)).count() == 0
    assert mismatches(windows.rolling_sum_count(own, kind=None, **short), windows.rolling_native(own, **short)).count() == 0


def test_window_edges(spark):
    end = 1_800_000_000_000 // HOUR_MS * HOUR_MS
    rows = [(str(i), "c", 1.0, t) for i, t in enumerate((end - 30 * DAY_MS, end - 1, end))]
    got = windows.rolling_sum_count(events(spark, rows)).where(f"window_end_ms = {end}").first()
    assert got.tx_count_30d == 2


def test_windows_are_sparse(spark):
    rows = [("a", "c", 1.0, 0), ("b", "c", 1.0, 100 * DAY_MS)]
    rolled = windows.rolling_sum_count(events(spark, rows))
    assert rolled.count() == 1440
    assert windows.rolling_sum_count(events(spark, rows), kind=None).count() == 1440
    assert windows.rolling_sum_count(events(spark, [])).count() == 0


def test_conflicts(spark):
    rows = [("event-1", "customer-001", a, 1_700_000_000_000, i) for i, a in enumerate((10.0, 10.0, 99.0, 99.0, 5.0))]
    df = spark.createDataFrame(rows, RAW + ", arrival bigint")
    assert [r.amount for r in dedup.first_events(df).collect()] == [10.0]
    assert [r.value for r in dedup.conflicts(df).collect()] == ["conflicting duplicate event_id=event-1"] * 3


def test_iso(spark):
    df = spark.createDataFrame([(0,), (1,), (1_790_251_200_000,)], "ms bigint")
    got = [r[0] for r in df.select(forms.iso_timestamp(df.ms)).collect()]
    assert got == ["1970-01-01T00:00:00Z", "1970-01-01T00:00:00.001000Z", "2026-09-24T12:00:00Z"]


def test_payload(spark):
    rows = [("b", 2.0, 1, 0, 2000, "t2", "c2"), ("a", 1.0, 1, 0, 1000, "t1", "c1")]
    df = spark.createDataFrame(rows, "customer_id string, total_amount_30d double, tx_count_30d bigint, window_start_ms bigint, window_end_ms bigint, event_timestamp string, created_timestamp string")
    from pyspark.sql import functions as F

    got = forms.push_payloads(df, F.lit(0)).first()
    assert got.push_source_name == "flink_customer_30d_push" and got.to == "online_and_offline"
    assert got.df.asDict() == {"customer_id": ["a", "b"], "total_amount_30d": [1.0, 2.0], "tx_count_30d": [1, 1], "event_timestamp": ["t1", "t2"], "created_timestamp": ["c1", "c2"]}
    assert forms.push_payloads(df.limit(0), F.lit(0)).count() == 0


def test_output_schema():
    assert CUSTOMER_30D.output_schema() == [("total_amount_30d", "double"), ("tx_count_30d", "bigint")]
    how = {"window": timedelta(days=1), "slide": timedelta(hours=1)}
    view = FeatureView("v", Entity(), (Aggregation("amount", "sum", **how), Aggregation("kind", "count_distinct", **how)), (("amount", "double"),))
    assert view.output_schema() == [("sum_amount_86400s", "double"), ("count_distinct_kind_86400s", "bigint")]
    with pytest.raises(ValueError):
        FeatureView("v", Entity(), (Aggregation("amount", "sum", **how),)).output_schema()


def test_view(spark):
    how = {"window": timedelta(hours=3), "slide": timedelta(hours=1)}
    names = ("sum", "count", "min", "max", "avg", "count_distinct")
    view = FeatureView("v", Entity(), tuple(Aggregation("amount", f, name=f, **how) for f in names), (("amount", "double"),))
    rows = [("a", "c", 1.5, 0), ("b", "c", 4.0, HOUR_MS), ("d", "c", 4.0, 2 * HOUR_MS)]
    got = {r.window_end_ms // HOUR_MS: (r["sum"], r["count"], r["min"], r["max"], r["avg"], r["count_distinct"]) for r in compute(view, events(spark, rows)).collect()}
    assert got == {1: (1.5, 1, 1.5, 1.5, 1.5, 1), 2: (5.5, 2, 1.5, 4.0, 2.75, 2), 3: (9.5, 3, 1.5, 4.0, 9.5 / 3, 2), 4: (8.0, 2, 4.0, 4.0, 4.0, 1), 5: (4.0, 1, 4.0, 4.0, 4.0, 1)}


def test_materialize_and_lookup(spark):
    own = dedup.first_events(fixture_events(spark, H))
    online = materialize(own, H - 31 * DAY_MS, H)
    ask = spark.createDataFrame([("customer-001",), ("nobody",)], "customer_id string")
    got = {r.customer_id: (r.total_amount_30d, r.tx_count_30d) for r in stores.lookup(ask, online, now_ms=H).collect()}
    assert got == {"customer-001": (60.0, 3), "nobody": (None, None)}
    old = stores.lookup(ask, online, now_ms=H + 32 * DAY_MS).where("customer_id = 'customer-001'").first()
    assert old.total_amount_30d is None


def test_view_flags_and_time_to_live(spark, tmp_path):
    import os
    from dataclasses import replace

    own = windows.rolling_sum_count(dedup.first_events(fixture_events(spark, H)))
    for online, offline in ((True, False), (False, True), (True, True)):
        view = replace(CUSTOMER_30D, online=online, offline=offline, ttl=timedelta(days=2))
        base = f"{tmp_path}/{online}{offline}"
        publish(view, own, f"{base}/online", f"{base}/offline")
        assert (os.path.exists(f"{base}/online"), os.path.exists(f"{base}/offline")) == (online, offline)
        if offline:
            assert spark.read.parquet(f"{base}/offline").count() == own.count()
        if online:
            table = spark.read.parquet(f"{base}/online")
            assert table.count() == own.select("customer_id").distinct().count()
            last = table.where("customer_id = 'customer-001'").first().window_end_ms
            ask = spark.createDataFrame([("customer-001",)], "customer_id string")
            assert served(view, ask, table, last + 2 * DAY_MS).first().tx_count_30d == 1
            assert served(view, ask, table, last + 2 * DAY_MS + 1).first().tx_count_30d is None


def test_doubles_of_all_sizes(spark):
    """What leaves a window leaves nothing behind, and no amount is rounded."""
    rows = [("a", "c", 0.004, 0), ("b", "c", 0.004, 1), ("d", "c", 0.0049, 2), ("e", "c", 1e17, 31 * DAY_MS), ("f", "c", 0.5, 62 * DAY_MS), ("g", "c", 1e300, 93 * DAY_MS), ("h", "c", -0.25, 124 * DAY_MS)]
    got = {r.window_end_ms: r.total_amount_30d for r in windows.rolling_sum_count(events(spark, rows)).collect()}
    for end, total in got.items():
        inside = [r[2] for r in rows if end - 30 * DAY_MS <= r[3] < end]
        assert inside and abs(total - sum(inside)) <= 1e-15 * abs(sum(inside)) + 1e-18
    last = windows.latest_sum_count(events(spark, rows)).first()
    assert last.total_amount_30d == -0.25 and last.window_end_ms == max(got)


def test_last_windows_are_the_last_of_all(spark, small):
    from tidemill.sources.tables import events as load

    own = load(spark, small)
    every = windows.rolling_sum_count(own)
    lo, hi = (every.agg({"window_end_ms": f}).first()[0] for f in ("min", "max"))
    for after, up_to in ((None, None), (lo + 5 * DAY_MS, lo + 9 * DAY_MS + 1234), (hi - DAY_MS, hi + DAY_MS), (hi, hi + DAY_MS)):
        inside = every.where((every.window_end_ms > (after or 0)) & (every.window_end_ms <= (up_to or hi)))
        got = windows.latest_sum_count(own, after_ms=after, up_to_ms=up_to)
        assert got.count() == inside.select("customer_id").distinct().count()
        assert mismatches(got, stores.latest(inside)).count() == 0


def test_offsets(spark):
    df = spark.createDataFrame([("t", 0, 0), ("t", 0, 1), ("t", 1, 5), ("u", 0, 7)], "topic string, partition int, offset bigint")
    assert {tuple(r) for r in stores.next_offsets(df).collect()} == {("t", 0, 2), ("t", 1, 6), ("u", 0, 8)}


def test_empty_tables(spark, tmp_path):
    for _ in range(2):
        ensure_tables(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/offline/customer_30d.parquet").count() == 0
