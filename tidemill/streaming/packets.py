"""Events in packets, one for each bucket of ids in a stretch of the input, so that a stateful operator takes a row for many events.

A packet is the records of its events, their ids joined and their customers joined. A malformed payload is a record without a
mark, with its message for an id. Rows keep their order within a bucket."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: mark (128 bits of an id, 128 of its event), amount, time, lengths of id and customer in bytes, and whether it is malformed.
RECORD = struct.Struct("<16s16sdqii?")
_FORM = np.dtype([("mark", "V32"), ("amount", "<f8"), ("ms", "<i8"), ("id", "<i4"), ("customer", "<i4"), ("bad", "?")])
PACKED = "bucket bigint, records binary, ids binary, customers binary"
JUDGED = "verdicts binary, records binary, ids binary, customers binary"
UNPACKED = "verdict int, event_id string, customer_id string, amount double, event_timestamp_ms bigint"
DROPPED, VALID, CONFLICT, MALFORMED = range(4)
#: A stretch ends with the batch that reaches one of these.
STRETCH_ROWS, STRETCH_BYTES = 1 << 18, 1 << 26
#: Records of a packet, at most, and bytes of ids and customers after which another begins: Spark hands 10,000 packets over at once.
PACKET_ROWS, PACKET_BYTES = 128, 1 << 14


def _parts(column: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets from 0 and the joined bytes of a binary column without nulls."""
    own = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2] or pa.py_buffer(b"")
    return own - own[0], data.slice(int(own[0]), int(own[-1] - own[0]))


def _joined(kind: pa.DataType, offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, "<i4")), data])


def _stretch(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    rows = rows.take(pa.array(np.argsort(rows["bucket"].to_numpy(), kind="stable")))
    whole = lambda name: pa.concat_arrays(rows[name].chunks)
    text = {c: _parts(whole(c).cast(pa.binary()).fill_null(b"")) for c in ("event_id", "customer_id")}
    marks, records = whole("mark").cast(pa.binary()), np.zeros(rows.num_rows, _FORM)
    records["mark"] = np.frombuffer(_parts(marks.fill_null(bytes(32)))[1], "V32")
    records["bad"] = marks.is_null().to_numpy(zero_copy_only=False)
    records["amount"] = whole("amount").fill_null(0.0).to_numpy(zero_copy_only=False)
    records["ms"] = whole("event_timestamp_ms").fill_null(0).to_numpy(zero_copy_only=False)
    records["id"], records["customer"] = np.diff(text["event_id"][0]), np.diff(text["customer_id"][0])
    buckets = rows["bucket"].to_numpy()
    first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    since = lambda x: x - np.repeat(x[first], np.diff(np.r_[first, len(buckets)]))
    steps = [buckets, since(np.arange(len(buckets))) // PACKET_ROWS, since(sum(offsets[:-1].astype("i8") for offsets, _ in text.values())) // PACKET_BYTES]
    starts = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in steps], axis=0)])
    bounds = np.r_[starts, len(buckets)]
    own = [_joined(pa.binary(), offsets[bounds], data) for offsets, data in text.values()]
    return pa.RecordBatch.from_arrays([pa.array(buckets[starts], pa.int64()), _joined(pa.binary(), bounds * RECORD.size, pa.py_buffer(records)), *own], ["bucket", "records", "ids", "customers"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From bucket, event_id, customer_id, amount, event_timestamp_ms, mark to PACKED."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= STRETCH_ROWS or sum(b.nbytes for b in held) >= STRETCH_BYTES:
            yield _stretch(held)
            held = []
    if held:
        yield _stretch(held)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From JUDGED to UNPACKED, without the events that are dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        verdicts, records, ids, customers = (_parts(c.cast(pa.binary()))[1] for c in batch.columns)
        told, own = np.frombuffer(verdicts, "u1"), np.frombuffer(records, _FORM)
        text = [_joined(pa.string(), np.r_[0, np.cumsum(own[c])], data) for c, data in (("id", ids), ("customer", customers))]
        rows = pa.RecordBatch.from_arrays([pa.array(told, pa.int32()), *text, pa.array(own["amount"].copy()), pa.array(own["ms"].copy())], ["verdict", "event_id", "customer_id", "amount", "event_timestamp_ms"])
        yield rows.filter(pa.array(told != DROPPED))
