import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions.validation import invalid, record_error, valid, validated

FULL = {"event_id": "event-1", "customer_id": "customer-001", "amount": 10, "event_timestamp_ms": 1_700_000_000_000}


def text(**change):
    return json.dumps(FULL | change)


VALID = [text(), text(amount=-1), text(amount=0), text(amount=1e2), text(event_timestamp_ms=-5), text(event_id=" x "), text(amount=99999999999999999999)]
INVALID = {
    "not-json": "invalid JSON",
    "": "invalid JSON",
    "{}": "expected exactly",
    "[1]": "expected exactly",
    "1": "expected exactly",
    text(more=1): "expected exactly",
    json.dumps({k: v for k, v in FULL.items() if k != "amount"}): "expected exactly",
    text(event_id=None): "event_id",
    text(event_id="  "): "event_id",
    text(event_id=" "): "event_id",
    text(event_id=1): "event_id",
    text(customer_id=""): "customer_id",
    text(amount=True): "amount",
    text(amount="1"): "amount",
    text(amount=None): "amount",
    text(event_timestamp_ms=1.5): "event_timestamp_ms",
    text(event_timestamp_ms=1.0): "event_timestamp_ms",
    text(event_timestamp_ms=True): "event_timestamp_ms",
    text().replace("1700000000000", "1e3"): "event_timestamp_ms",
    text(event_timestamp_ms=99999999999999999999): "event_timestamp_ms",
    text().replace("10", "NaN", 1): "invalid JSON",
    text().replace('{"event_id"', '{"event_id":"a","event_id"'): "invalid JSON",
    text(amount={"a": 1, "b": 2}): "amount",
}


def test_valid(spark):
    df = spark.createDataFrame([(x,) for x in VALID], "value string")
    assert valid(validated(df)).count() == len(VALID)
    assert valid(validated(df.limit(1))).first()["amount"] == 10.0


@pytest.mark.parametrize("payload", INVALID)
def test_invalid(spark, payload):
    got = invalid(validated(spark.createDataFrame([(payload,)], "value string"))).collect()
    assert len(got) == 1 and got[0]["value"].startswith(INVALID[payload]) and got[0]["value"].endswith(f"; payload={payload}")


def test_null_payload_is_invalid(spark):
    assert invalid(validated(spark.createDataFrame([(None,)], "value string"))).first()["value"].endswith("; payload=null")


def test_record_error(spark):
    full = {"customer_id": "c", "total_amount_30d": 1, "tx_count_30d": 1, "window_end_ms": 1, "event_timestamp": "t", "created_timestamp": "t"}
    df = spark.createDataFrame([(json.dumps(full | {"more": 1}),), (json.dumps({"customer_id": 1}),), ("x",), (None,)], "value string")
    got = [r[0] for r in df.select(record_error(F.col("value"))).collect()]
    assert got[0] is None and got[1].startswith("Missing aggregate fields: ['created_timestamp'") and got[2:] == ["not a JSON object"] * 2
