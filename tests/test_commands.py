import pytest

from tidemill.__main__ import main
from tidemill.plans.verify import check_parity, check_values, wait_for_record, wait_for_rows
from tidemill.streaming import sinks

H = 1_790_251_200_000


def test_end_to_end(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("DATA_DIR", str(tmp_path))
    monkeypatch.setattr("signal.signal", lambda *a: None)
    for command in ("init", "seed", "ingest", "features", "push", "materialize", "verify"):
        assert main([command, "--now-ms", str(H), "--once"]) == 0
    assert '"total_amount_30d": 60.0, "tx_count_30d": 3' in capsys.readouterr().out
    for path in ("batch", "stream"):
        assert main(["verify", "--now-ms", str(H), "--path", path]) == 0
        assert f'{{"{path}": {{"customer_id"' in capsys.readouterr().out
    with pytest.raises(AssertionError):
        main(["verify", "--now-ms", str(H), "--total", "61"])
    with pytest.raises(TimeoutError):  # a month later the values are too old
        main(["verify", "--now-ms", str(H + 40 * 24 * 3_600_000), "--wait-seconds", "0.1"])
    # the same events again change nothing; an old one is late
    for command in ("seed", "late-probe", "ingest", "features", "push", "verify"):
        main([command, "--now-ms", str(H), "--once"])
    from tidemill.sources.contracts import RAW
    from tidemill.streaming.jobs import FEATURE_DDL

    assert sinks.written(spark, f"{tmp_path}/stream", "feature", FEATURE_DDL).count() == 5
    assert sinks.written(spark, f"{tmp_path}/stream", "late", RAW).count() == 1
    pushed = sinks.Pusher(spark, f"{tmp_path}/pushed")
    assert pushed.offline().count() == 5
    assert {(r.customer_id, r.total_amount_30d, r.tx_count_30d) for r in pushed.online().collect()} == {("customer-001", 60.0, 3), ("customer-002", 7.5, 1)}


def test_waiting(spark):
    from pyspark.sql import functions as F

    df = spark.range(6)
    assert wait_for_record(lambda: df, F.col("id") == 3)[0] == 3 and wait_for_rows(lambda: df) == 6
    with pytest.raises(TimeoutError):
        wait_for_record(lambda: df, F.col("id") > 9, 0.2, 0.05)
    with pytest.raises(TimeoutError):
        wait_for_rows(lambda: df, 7, 0.2, 0.05)
    with pytest.raises(AssertionError):
        check_values(None, 60.0, 3)
    rows = spark.createDataFrame([("c", 60.0, 3, 7), ("c", 61.0, 3, 8)], "customer_id string, total_amount_30d double, tx_count_30d bigint, window_end_ms bigint")
    first, second = rows.orderBy("window_end_ms").collect()
    check_values(first, 60.0, 3)
    assert check_parity(first, rows) == first
    for other in (rows.where("window_end_ms = 8"), rows.withColumn("tx_count_30d", F.lit(4).cast("bigint"))):
        with pytest.raises(AssertionError):
            check_parity(first, other)
