import json
import os

import pytest

from tidemill.config import DAY_MS, HOUR_MS
from tidemill.operators import windows
from tidemill.plans.parity import mismatches
from tidemill.sources.contracts import RAW
from tidemill.sources.streams import StreamSource
from tidemill.sources.tables import fixture_events
from tidemill.streaming import jobs, runs, sinks

H = 1_790_251_200_000


def land(folder, number, lines):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{number}.txt"
    with open(path, "w") as f:
        f.write("".join(f"{x}\n" for x in lines))
    os.utime(path, (1_700_000_000 + number,) * 2)


def ingest(spark, base):
    source = StreamSource("text", f"{base}/in", max_per_trigger=1).read(spark)
    runs.drain(jobs.ingest(spark, source, str(base), f"{base}/checkpoint", "1 second"))


def payloads(spark):
    return [json.dumps(r.asDict()) for r in fixture_events(spark, H).drop("arrival").collect()]


def test_ingest_routes_and_restarts(spark, tmp_path):
    first = json.loads(payloads(spark)[0])
    land(f"{tmp_path}/in", 0, payloads(spark) + ["not-json"])
    ingest(spark, tmp_path)
    assert sinks.written(spark, str(tmp_path), "valid", RAW).count() == 5
    # a restart from the same checkpoint: repeats are known, a changed event is a conflict
    land(f"{tmp_path}/in", 1, payloads(spark) + [json.dumps(first | {"amount": 99.0})])
    ingest(spark, tmp_path)
    assert sinks.written(spark, str(tmp_path), "valid", RAW).count() == 5
    bad = sorted(r.value for r in sinks.written(spark, str(tmp_path), "invalid", "value string").collect())
    assert bad == ["conflicting duplicate event_id=evt-001", "invalid JSON: malformed document; payload=not-json"]


def rolling(spark, base, batches):
    for rows in batches:
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(f"{base}/in")
        jobs.rolling(spark, StreamSource("parquet", f"{base}/in").read(spark), str(base), f"{base}/checkpoint").awaitTermination()
    return sinks.written(spark, str(base), "feature", jobs.FEATURE_DDL), sinks.written(spark, str(base), "late", RAW)


def test_late_and_partly_late(spark, tmp_path):
    batches = [
        [("a", "c1", 1.0, H - 2 * HOUR_MS), ("wm", "wd", 0.0, H)],
        [("wmb", "wd", 0.0, H)],
        [("p20", "c1", 5.0, H - 20 * DAY_MS), ("l32", "c1", 9.0, H - 32 * DAY_MS)],
        [("wm2", "wd", 0.0, H + HOUR_MS)],
    ]
    features, late = rolling(spark, tmp_path, batches)
    assert [r.event_id for r in late.collect()] == ["l32"]
    got = {(r.window_end_ms - H) // HOUR_MS: (r.total_amount_30d, r.tx_count_30d) for r in features.where("customer_id = 'c1'").collect()}
    assert got == {-1: (1.0, 1), 0: (6.0, 2)}


def test_stream_equals_batch(spark, tmp_path):
    from tidemill.operators.dedup import first_events

    own = first_events(fixture_events(spark, H))
    features, late = rolling(spark, tmp_path, [[tuple(r) for r in own.collect()]])
    batch = windows.rolling_sum_count(own).where(f"window_end_ms <= {H - HOUR_MS}")
    assert late.count() == 0 and features.count() == 5 and mismatches(features, batch).count() == 0


def test_gaps_and_expiry(spark, tmp_path):
    rows = [("a", "c", 1.0, 10**12), ("b", "c", 2.5, 10**12 + 45 * DAY_MS), ("w", "w", 0.0, 10**12 + 90 * DAY_MS)]
    features, _ = rolling(spark, tmp_path, [rows])
    own = spark.createDataFrame(rows, RAW)
    batch = windows.rolling_sum_count(own).where(f"window_end_ms <= {10**12 + 90 * DAY_MS - HOUR_MS}")
    assert features.count() == batch.count() and mismatches(features, batch).count() == 0


RECORD = {"customer_id": "customer-1", "total_amount_30d": 20.0, "tx_count_30d": 2, "window_start_ms": 0, "window_end_ms": 1000, "event_timestamp": "1970-01-01T00:00:01Z", "created_timestamp": "1970-01-01T00:00:02Z"}


def messages(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v), "t", 0, i) for i, v in enumerate(values)], "value string, topic string, partition int, offset bigint")


def test_pusher_is_idempotent(spark, tmp_path):
    push = sinks.Pusher(spark, str(tmp_path))
    batch = messages(spark, RECORD, RECORD | {"window_end_ms": 2000}, "not-json", {"customer_id": "c"}, "[1]")
    for batch_id in (0, 0, 1):
        push(batch, batch_id)
    assert {tuple(r) for r in push.ledger().collect()} == {("customer-1", 1000), ("customer-1", 2000)}
    assert push.offline().count() == 2
    assert push.letters().where("reason LIKE 'Missing%'").count() == 2


def test_push_to_either_store(spark, tmp_path):
    for to, offline, online in (("online_and_offline", 2, 1), ("online", 0, 1), ("offline", 2, 0)):
        push = sinks.Pusher(spark, f"{tmp_path}/{to}", to=to)
        push(messages(spark, RECORD, RECORD | {"window_end_ms": 2000, "tx_count_30d": 3}), 0)
        assert (push.offline().count(), push.online().count()) == (offline, online)
    push = sinks.Pusher(spark, f"{tmp_path}/online_and_offline")
    assert push.online().first().tx_count_30d == 3
    push(messages(spark, RECORD | {"window_end_ms": 1500, "tx_count_30d": 9}), 1)  # older than what is there
    assert push.online().first().tx_count_30d == 3 and push.offline().count() == 3
    with pytest.raises(ValueError):
        sinks.Pusher(spark, str(tmp_path), to="nowhere")


def test_poison_bytes_become_dead_letters(spark, tmp_path):
    rows = [(b"\xff\xfe not text", "t", 3, 7), (b'{"customer_id":"\xc3"}', "t", 3, 8), (json.dumps(RECORD).encode(), "t", 3, 9), (None, "t", 3, 10)]
    push = sinks.Pusher(spark, str(tmp_path))
    push(spark.createDataFrame(rows, "value binary, topic string, partition int, offset bigint"), 0)
    got = {r.source_offset: (r.reason, r.value) for r in push.letters().collect()}
    assert got[7] == ("not a JSON object", "\ufffd\ufffd not text") and got[8][0].startswith("Missing") and got[8][1] == '{"customer_id":"\ufffd"}'
    assert set(got) == {7, 8, 10} and push.offline().count() == 1


def test_deliveries_are_of_bounded_size(spark, tmp_path):
    sizes = []

    def deliver(rows, batch_id):
        own = rows.collect()
        sizes.append(len(own))
        return (422, "no") if any(r.window_end_ms == 5 for r in own) else (200, "ok")

    push = sinks.Pusher(spark, str(tmp_path), deliver=deliver)
    push(messages(spark, *(RECORD | {"window_end_ms": i} for i in range(250))), 0)
    assert sorted(sizes) == [50, 100, 100]
    refused = push.letters().count()
    assert refused in (50, 100) and push.ledger().count() == 250 - refused
    assert push.letters().select("reason").distinct().collect()[0][0] == "push HTTP 422: no"


def test_refused_and_failed_pushes(spark, tmp_path):
    push = sinks.Pusher(spark, str(tmp_path), deliver=lambda rows, i: (422, "no"))
    push(messages(spark, RECORD), 0)
    assert push.ledger().count() == 0 and push.letters().first().reason == "push HTTP 422: no"
    waits = []
    down = sinks.Pusher(spark, str(tmp_path), deliver=lambda rows, i: (503, "down"), sleep=waits.append)
    with pytest.raises(RuntimeError):
        down(messages(spark, RECORD), 1)
    assert waits == [1, 2, 4, 8, 10] and down.ledger().count() == 0


def test_delivery_recovers():
    answers = iter([(500, "x"), OSError("gone"), (200, "ok")])

    def act():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert sinks.delivered(act, sleep=lambda s: None) == (200, "ok")
    with pytest.raises(RuntimeError, match="answer 503: down"):
        sinks.delivered(lambda: (503, "down"), pauses=(0, 0), sleep=lambda s: None)


def test_topics(spark, tmp_path):
    """The topics' values, with files in place of Kafka."""
    sink = sinks.feature_topics("nowhere", fmt="json", path=f"{tmp_path}/topics")
    row = ("feature", None, "c", None, None, 1.5, 2, 0, 3_600_000)
    late = ("late", "e", "c", 2.5, 7, None, None, None, None)
    sink(spark.createDataFrame([row, late], "kind string, event_id string, customer_id string, amount double, event_timestamp_ms bigint, total_amount_30d double, tx_count_30d bigint, window_start_ms bigint, window_end_ms bigint"), 0)
    got = {r.topic: json.loads(r.value) for r in spark.read.json(f"{tmp_path}/topics").collect()}
    made = got["features.customer_30d.v1"]
    assert made.pop("created_timestamp") and made == {"customer_id": "c", "total_amount_30d": 1.5, "tx_count_30d": 2, "window_start_ms": 0, "window_end_ms": 3_600_000, "event_timestamp": "1970-01-01T01:00:00Z"}
    assert got["transactions.late.v1"] == {"event_id": "e", "customer_id": "c", "amount": 2.5, "event_timestamp_ms": 7}
    sinks.ingest_topics("nowhere", fmt="json", path=f"{tmp_path}/invalid")(spark.createDataFrame([("invalid", "x"), ("valid", None)], "kind string, value string"), 0)
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/invalid").select("topic", "value").collect()] == [("transactions.invalid.v1", "x")]


def test_sums_are_exact_in_the_stream(spark, tmp_path):
    """Amounts of all sizes come and go, and leave nothing behind."""
    rows = [("a", "c", 1e300, H - 45 * DAY_MS), ("b", "c", 0.1, H - 40 * DAY_MS), ("d", "c", 0.2, H - 39 * DAY_MS), ("e", "c", 1e17, H - 20 * DAY_MS), ("f", "c", 5e-324, H - 12 * DAY_MS), ("w", "wd", 0.0, H + 31 * DAY_MS)]
    features, _ = rolling(spark, tmp_path, [rows])
    own = {r.window_end_ms: (r.total_amount_30d, r.tx_count_30d) for r in features.where("customer_id = 'c'").collect()}
    import math

    for end, got in own.items():
        inside = [r[2] for r in rows if r[1] == "c" and end - 30 * DAY_MS <= r[3] < end]
        assert got == (math.fsum(inside), len(inside))
    batch = windows.rolling_sum_count(spark.createDataFrame(rows, RAW)).where(f"customer_id = 'c' AND window_end_ms <= {H + 31 * DAY_MS - HOUR_MS}")
    assert batch.count() == len(own) and mismatches(features.where("customer_id = 'c'"), batch).count() == 0


def test_many_late_and_early_events_equal_batch(spark, tmp_path):
    """Random events over four batches: what a window holds when it closes is what came before."""
    import random

    rng = random.Random(3)
    batches, rows = [], []
    for b in range(4):
        own = [(f"{b}-{i}", f"c{rng.randrange(3)}", round(rng.uniform(-5, 50), 4), 10**12 // HOUR_MS * HOUR_MS + rng.randrange(b * 10, b * 10 + 25) * DAY_MS + rng.randrange(DAY_MS)) for i in range(40)]
        batches.append(own)
    top = 10**12 // HOUR_MS * HOUR_MS
    batches.append([("w", "wd", 0.0, top + 100 * DAY_MS)])
    features, late = rolling(spark, tmp_path, batches)
    rows = [r for b in batches for r in b]
    missed = {r.event_id for r in late.collect()}
    got = {(r.customer_id, r.window_end_ms): (r.total_amount_30d, r.tx_count_30d) for r in features.collect()}
    # the watermark when a batch comes is that of the batches before
    want, mark = {}, 0
    marks = []
    for b in batches:
        marks.append(mark)
        mark = max(mark, max(r[3] for r in b) - HOUR_MS)
    for b, m in zip(batches, marks, strict=True):
        for r in b:
            first = r[3] // HOUR_MS * HOUR_MS + HOUR_MS
            for end in range(first, first + 30 * DAY_MS, HOUR_MS):
                if (not m or end > m) and end <= mark:
                    s, n = want.get((r[1], end), (0, 0))
                    want[(r[1], end)] = (s + r[2], n + 1)
    assert missed == {r[0] for b, m in zip(batches, marks, strict=True) for r in b if m and r[3] // HOUR_MS * HOUR_MS + 30 * DAY_MS <= m}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1] == want[k][1] for k in want)


def test_raw_mirror(spark, tmp_path):
    from tidemill.sources.streams import RAW_EVENTS

    land(f"{tmp_path}/in", 0, payloads(spark))
    source = StreamSource("text", f"{tmp_path}/in").read(spark)
    runs.drain(jobs.ingest(spark, source, str(tmp_path), f"{tmp_path}/checkpoint", "1 second", sinks.raw_mirror(f"{tmp_path}/{RAW_EVENTS.batch_path}")))
    rows = RAW_EVENTS.batch(spark, str(tmp_path))
    assert rows.count() == 5 and rows.where("event_timestamp = created_timestamp AND unix_millis(event_timestamp) = event_timestamp_ms").count() == 5
    assert RAW_EVENTS.batch(spark, f"{tmp_path}/none").count() == 0 and RAW_EVENTS.stream("s").topic == "raw.transactions.v1"


def test_kafka_source(spark):
    """The options and the columns of the Kafka reader, with a table in place of the connector."""
    seen = {}

    class Reader:
        def format(self, name):
            seen["format"] = name
            return self

        def option(self, name, value):
            seen[name] = value
            return self

        def load(self):
            return spark.createDataFrame([(b"k", b'{"a":1}\xff', "t", 2, 5)], "key binary, value binary, topic string, partition int, offset bigint")

    class Session:
        readStream = Reader()  # noqa: N815

    from tidemill.sources.streams import RAW_EVENTS

    got = RAW_EVENTS.stream("host:9092", 100).read(Session())
    assert [tuple(r) for r in got.collect()] == [('{"a":1}�', "t", 2, 5)] and got.columns == ["value", "topic", "partition", "offset"]
    assert seen == {"format": "kafka", "kafka.bootstrap.servers": "host:9092", "subscribe": "raw.transactions.v1", "startingOffsets": "earliest", "kafka.isolation.level": "read_committed", "maxOffsetsPerTrigger": 100}


class Runs:
    """A bucket's list state, and how often it is asked."""

    def __init__(self):
        self.own, self.calls = [], 0

    def getListState(self, name, schema, ttl):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return iter(self.own)

    def appendValue(self, value):  # noqa: N802
        self.calls += 1
        self.own.append(value)

    def put(self, values):
        self.calls += 1
        self.own = list(values)


def test_deduplication_asks_the_state_once_for_many_ids():
    import hashlib

    from tidemill.streaming import processors

    state, job = Runs(), processors.Deduplicate(ttl_ms=1000)
    job.init(state)

    def told(now, *events):
        class Clock:
            def getCurrentProcessingTimeInMs(self):  # noqa: N802
                return now

        mark = lambda *x: b"".join(hashlib.sha256(repr(v).encode()).digest()[:16] for v in x)
        state.calls = 0
        out = [r["value"] or r["event_id"] for r in job.handleInputRows((0,), [(0, i, "c", a, 5, mark(i, a)) for i, a in events], Clock())]
        assert state.calls <= 2
        return out

    ids = [str(i) for i in range(1000)]
    assert told(0, *((i, 1.0) for i in ids)) == ids
    assert told(1, ("7", 1.0), ("7", 2.0), ("new", 1.0), ("new", 1.0)) == ["conflicting duplicate event_id=7", "new"]
    for k in range(40):  # runs are merged, with the times of their entries
        assert told(500 + k, (f"k{k}", 1.0), ("8", 1.0)) == [f"k{k}"]
    assert len(state.own) < processors.MOST_RUNS
    assert told(999, ("8", 1.0)) == [] and told(1000, ("8", 2.0), ("new", 1.0)) == ["8"]
    assert told(1001, ("new", 2.0), ("k39", 1.0)) == ["new"]
    assert list(job.handleInputRows((0,), [(0, "no", None, None, None, None)], None or type("C", (), {"getCurrentProcessingTimeInMs": lambda s: 0})()))[0].value == "no"


def test_ingest_has_no_empty_batches(spark, tmp_path):
    """A query that is slower than its trigger settles all the same."""
    land(f"{tmp_path}/in", 0, payloads(spark))
    query = jobs.ingest(spark, StreamSource("text", f"{tmp_path}/in").read(spark), str(tmp_path), f"{tmp_path}/checkpoint", "0 seconds")
    runs.drain(query)
    assert [p["numInputRows"] for p in query.recentProgress] == [6] and not query.isActive
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_one_bucket_keeps_its_ids_apart(spark, tmp_path):
    """Repeats, conflicts and malformed payloads of one bucket, over two runs."""
    from tidemill.functions.validation import validated
    from tidemill.streaming import processors

    event = lambda i, amount: json.dumps({"event_id": i, "customer_id": "c", "amount": amount, "event_timestamp_ms": H})
    for number, lines in enumerate(([event(f"e{i}", 1.0) for i in range(30)] + ["no"], [event("e3", 1.0), event("e4", 2.0), event("e4", 2.0), event("e30", 1.0), "no"])):
        land(f"{tmp_path}/in", number, lines)
        told = processors.deduplicated(validated(StreamSource("text", f"{tmp_path}/in").read(spark)), buckets=1)
        runs.use_rocksdb(spark)
        with runs.no_empty_batches(spark):
            query = told.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(sinks.split_by_kind(str(tmp_path), {"valid": ["event_id"], "invalid": ["value"]})).start()
        runs.drain(query)
    assert sorted(r.event_id for r in sinks.written(spark, str(tmp_path), "valid", "event_id string").collect()) == sorted(f"e{i}" for i in range(31))
    bad = "invalid JSON: malformed document; payload=no"
    assert sorted(r.value for r in sinks.written(spark, str(tmp_path), "invalid", "value string").collect()) == ["conflicting duplicate event_id=e4"] * 2 + [bad] * 2


def test_deduplication_takes_packets_of_events():
    """A batch over many ids is few keys and few rows for the state, whatever is in them."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    from tidemill.streaming import packets, processors

    mark = lambda *x: b"".join(hashlib.sha256(repr(v).encode()).digest()[:16] for v in x)
    rng = np.random.default_rng(5)
    events = [(f"é{i}" if i % 3 else f"{i}", "ü" * (i % 4), i / 7, i - 50, mark(i, i)) for i in range(3000)]
    events += [(*e[:2], -0.0, *e[3:4], mark(i, -1)) for i, e in enumerate(events[:300])] + events[500:900]
    events += [("x" * i, None, None, None, None) for i in (0, 5, 40_000, 40_000)] + [("hot", "c", float("inf"), 1, mark("hot", 1))] * 1000
    key = {e[0]: int(k) for e, k in zip(events, rng.integers(0, 7, len(events)))}
    names, kinds = ["bucket", "event_id", "customer_id", "amount", "event_timestamp_ms", "mark"], [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.binary()]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[(key[e[0]], *e) for e in rows]), kinds)], names)
    out = pa.Table.from_batches(packets.packed(iter([batch(events[:1000]), batch(events[1000:1001]), batch(events[1001:])])))
    assert out.num_rows < 70 and max(len(r) // packets.RECORD.size for r in out["records"].to_pylist()) == packets.PACKET_ROWS
    assert max(len(r) for r in out["ids"].to_pylist()) <= packets.PACKET_BYTES + 40_000

    class Clock:
        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return 0

    seen, got, want = {}, [], []
    for bucket in sorted(set(key.values())):
        rows = [tuple(r.values()) for r in out.to_pylist() if r["bucket"] == bucket]
        state, job = Runs(), processors.DeduplicatePackets()
        job.init(state)
        judged = [r.asDict() for r in job.handleInputRows((bucket,), iter(rows), Clock())]
        assert state.calls <= 2
        schema = pa.schema([(c, pa.binary()) for c in ("verdicts", "records", "ids", "customers")])
        got += [tuple(r.values()) for b in packets.unpacked(iter([pa.RecordBatch.from_pylist(judged, schema=schema)])) for r in b.to_pylist()]
    for e in events:
        if e[4] is None:
            want.append((packets.MALFORMED, e[0], "", 0.0, 0))
        elif e[0] not in seen:
            seen[e[0]] = e[4]
            want.append((packets.VALID, *e[:4]))
        elif seen[e[0]] != e[4]:
            want.append((packets.CONFLICT, *e[:4]))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) == 3305


def test_ids_share_few_keys():
    """Each key that a batch touches asks the state, so 600,000 ids must not be 65,536 of them."""
    from tidemill.streaming import processors

    assert 600_000 / processors.BUCKETS > 100


def test_few_ids_are_searched_for_in_a_bucket():
    """An entry is found at its place only, and not once it has expired; the rest of the bucket stays packed."""
    from tidemill.streaming import processors

    job = processors.Deduplicate(ttl_ms=1000)
    a, b, c = (bytes([x]) * 16 for x in b"abc")
    run = processors.ENTRY.pack(b, a, 0) + processors.ENTRY.pack(a, c, 500)
    assert job._find([run], a, 900) == (c, 500) and job._find([run], a, 1500) is None and job._find([run], c, 0) is None
    assert job._find([run, processors.ENTRY.pack(a, b, 1600)], a, 1700) == (b, 1600)
    state = job.seen = Runs()
    state.own = [(b"".join(processors.ENTRY.pack(i.to_bytes(16), bytes(16), 0) for i in range(5000)),)]
    job._unpacked = None
    ids = [10**9, *range(processors.FEW_IDS - 1)]
    assert list(job.verdicts(((i.to_bytes(16), bytes(16)) for i in ids), 1)) == [1] + [0] * (processors.FEW_IDS - 1)
    assert len(state.own) == 2 and len(state.own[1][0]) == processors.ENTRY.size
