"""Stateful operators: de-duplication with conflict reports, and rolling features with late events.

Event-time operators drop rows that are older than the watermark before user code sees them. Events are
late by window, not by watermark, so the feature stage declares its watermark on a shifted time: SHIFT is
added to both the column and the delay, which leaves the watermark's value as it is (newest time minus
one hour) but makes Spark itself drop only what is older than SHIFT.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from itertools import islice, tee

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemill.config import DEDUP_TTL, HOUR_MS, WATERMARK_DELAY
from tidemill.functions.forms import fingerprint
from tidemill.operators.windows import WINDOW_MS
from tidemill.sources.contracts import RAW, RAW_FIELDS
from tidemill.streaming.packets import CONFLICT, DROPPED, JUDGED, MALFORMED, PACKED, RECORD, UNPACKED, VALID, packed, unpacked

SHIFT_HOURS = 24 * 3650
#: Window ends up to which a tile is read from the state when it is needed.
FEW_ENDS = 8
#: Keys that ids are dealt to. Each costs a batch that touches it about 2 ms, however few its ids; at 100 million ids in 32 days,
#: a bucket has 24,400 entries of 40 bytes. A checkpoint keeps its number.
BUCKETS = 1 << 12
#: 128 bits of an id and of its event, and when it was seen first.
ENTRY = struct.Struct("<16s16sq")
MOST_RUNS = 16
#: Ids of a batch that are searched for in a bucket's bytes before all its entries are unpacked.
FEW_IDS = 64
CONFLICTING = "conflicting duplicate event_id="
DEDUP_ROW = Row(*RAW_FIELDS, "value")
PACKET_ROW = Row("verdicts", "records", "ids", "customers")
FEATURES_OUT = f"kind string, {RAW}, total_amount_30d double, tx_count_30d bigint, window_start_ms bigint, window_end_ms bigint"


class Deduplicate(StatefulProcessor):
    """The first event of an id passes; equal ones are dropped and others reported. Seen ids are kept for
    32 days from their first sight, in processing time.

    A key is a bucket of ids, so that a large batch asks the state once for many of them. Its state is a list of
    runs of entries, of which a batch appends one; when there are MOST_RUNS, they are merged. An entry tells the id and
    the event by 128 bits of their SHA-256 each (`mark`), and holds the time of its first sight. The first FEW_IDS ids
    of a batch are searched for in the runs, for more the runs are unpacked. Rows without a mark are malformed; their
    event_id is the message."""

    def __init__(self, ttl_ms: int = int(DEDUP_TTL.total_seconds() * 1000)):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", "entries binary", self.ttl_ms)

    def _find(self, runs: list[bytes], own: bytes, now: int) -> tuple[bytes, int] | None:
        for entries in runs:
            at = entries.find(own)
            while at >= 0:
                if at % ENTRY.size == 0:
                    _, print_, first = ENTRY.unpack_from(entries, at)
                    if first + self.ttl_ms > now:
                        return print_, first
                at = entries.find(own, at + 1)
        return None

    def _unpacked(self, runs: list[bytes], now: int) -> dict[bytes, tuple[bytes, int]]:
        return {own: (print_, at) for entries in runs for own, print_, at in ENTRY.iter_unpack(entries) if at + self.ttl_ms > now}

    def verdicts(self, marks: Iterable[tuple[bytes, bytes] | None], now: int) -> Iterator[int]:
        """A verdict for each mark of the bucket; the state is written after the last."""
        runs, known, whole, new = None, {}, False, []
        for mark in marks:
            if mark is None:
                yield MALFORMED
                continue
            if runs is None:
                runs = [bytes(entries) for (entries,) in self.seen.get()]
            own, print_ = mark
            stored = known.get(own)
            if stored is None and not whole:
                if len(known) < FEW_IDS:
                    stored = self._find(runs, own, now)
                else:
                    known, whole = self._unpacked(runs, now) | known, True
                    stored = known.get(own)
            if stored is None:
                stored = print_, now
                new.append(ENTRY.pack(own, *stored))
                verdict = VALID
            else:
                verdict = DROPPED if stored[0] == print_ else CONFLICT
            known[own] = stored
            yield verdict
        if new and len(runs) + 1 < MOST_RUNS:
            self.seen.appendValue((b"".join(new),))
        elif new:
            known = known if whole else self._unpacked(runs, now) | known
            self.seen.put([(b"".join(ENTRY.pack(own, *stored) for own, stored in known.items()),)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows, again = tee(rows)
        marks = (None if r[-1] is None else (bytes(r[-1][:16]), bytes(r[-1][16:])) for r in again)
        for verdict, (_, event_id, customer_id, amount, ms, _) in zip(self.verdicts(marks, timerValues.getCurrentProcessingTimeInMs()), rows):
            if verdict == VALID:
                yield DEDUP_ROW(event_id, customer_id, amount, ms, None)
            elif verdict != DROPPED:
                yield DEDUP_ROW(None, None, None, None, event_id if verdict == MALFORMED else CONFLICTING + event_id)

    def close(self) -> None:
        pass


class DeduplicatePackets(Deduplicate):
    """The same for packets of events, of which it judges each record."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        packet: list = []

        def marks() -> Iterator[tuple[bytes, bytes] | None]:
            for row in rows:
                packet[:] = row[1:]
                yield from (None if bad else (own, print_) for own, print_, _, _, _, _, bad in RECORD.iter_unpack(row[1]))

        verdicts = self.verdicts(marks(), timerValues.getCurrentProcessingTimeInMs())
        for verdict in verdicts:  # a packet's first; marks() is at that packet until the next is asked for
            own = bytes((verdict, *islice(verdicts, len(packet[0]) // RECORD.size - 1)))
            if any(own):
                yield PACKET_ROW(own, *packet)

    def close(self) -> None:
        pass


def exact(value: float) -> tuple[int, int]:
    """A double as a whole number of 2**-shift."""
    top, bottom = value.as_integer_ratio()
    return top, bottom.bit_length() - 1


def plus(a: tuple[int, int], b: tuple[int, int], sign: int = 1) -> tuple[int, int]:
    """Exact sums of such numbers, so that what leaves a window leaves nothing behind."""
    shift = max(a[1], b[1])
    return (a[0] << shift - a[1]) + sign * (b[0] << shift - b[1]), shift


def nearest(a: tuple[int, int]) -> float:
    """The double next to such a number; infinite beyond the largest."""
    try:
        return a[0] / (1 << a[1])
    except OverflowError:
        return math.copysign(math.inf, a[0])


class RollingFeatures(StatefulProcessor):
    """Keeps tiles of one slide for each customer, at most a window of them and those after it, and the sum and count of
    the next window end that holds events, on which a timer stands. A window is emitted once the watermark
    reaches its end; the step to the next end adds a tile and takes one away. An event is late if the last of its
    windows has closed, else it counts in those still open."""

    def __init__(self, window: int = WINDOW_MS, slide: int = HOUR_MS):
        self.window, self.slide = window, slide

    def init(self, handle) -> None:
        self.handle = handle
        self.tiles = handle.getMapState("tiles", "tile bigint", "top string, shift int, n bigint")
        self.due = handle.getValueState("due", "due bigint, top string, shift int, n bigint")

    def _tile(self, at: int) -> tuple[tuple[int, int], int]:
        own = self.tiles.getValue((at,))
        return ((int(own[0]), own[1]), own[2]) if own else ((0, 0), 0)

    def _load(self) -> tuple[int | None, tuple[int, int], int]:
        own = self.due.get()
        return (own[0], (int(own[1]), own[2]), own[3]) if own else (None, (0, 0), 0)

    def _save(self, before: int | None, due: int | None, total: tuple[int, int], n: int) -> None:
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.due.clear()
        else:
            self.due.update((due, str(total[0]), total[1], n))

    def _whole(self, end: int) -> tuple[tuple[int, int], int]:
        """Sum and count of the window that ends at `end`, from all of its tiles."""
        total, n = (0, 0), 0
        for (at,), (top, shift, count) in self.tiles.iterator() if self.tiles.exists() else ():
            if end - self.window <= at < end:
                total, n = plus(total, (int(top), shift)), n + count
        return total, n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        new: dict[int, list] = {}
        for r in rows:
            at = r["event_timestamp_ms"] // self.slide * self.slide
            if mark > 0 and at + self.window <= mark:
                yield Row(kind="late", **{c: r[c] for c in RAW_FIELDS}, total_amount_30d=None, tx_count_30d=None, window_start_ms=None, window_end_ms=None)
                continue
            own = new.setdefault(at, [(0, 0), 0])
            own[0], own[1] = plus(own[0], exact(r["amount"])), own[1] + 1
        if not new:
            return
        before, total, n = self._load()
        open_ = (mark // self.slide + 1) * self.slide if mark > 0 else None  # the first end after the watermark
        due = min([e for e in [before] if e is not None] + [at + self.slide if open_ is None else max(at + self.slide, open_) for at in new])
        for at, (amount, count) in new.items():
            old, seen = self._tile(at)
            top, shift = plus(old, amount)
            self.tiles.updateValue((at,), (str(top), shift, seen + count))
            if due == before and due - self.window <= at < due:
                total, n = plus(total, amount), n + count
        if due != before:
            total, n = self._whole(due)
        self._save(before, due, total, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        due, total, n = self._load()
        tile = self._tile
        if due is not None and due + FEW_ENDS * self.slide <= mark:  # many windows close at once: all tiles are read together
            known = {at: ((int(top), shift), count) for (at,), (top, shift, count) in self.tiles.iterator()}
            tile = lambda at: known.get(at, ((0, 0), 0))
        while due is not None and due <= mark:
            yield Row(kind="feature", event_id=None, customer_id=key[0], amount=None, event_timestamp_ms=None, total_amount_30d=nearest(total), tx_count_30d=n, window_start_ms=due - self.window, window_end_ms=due)
            gone, left = tile(due - self.window)
            if left:
                total, n = plus(total, gone, -1), n - left
                self.tiles.removeKey((due - self.window,))
            come, more = tile(due)
            total, n, due = plus(total, come), n + more, due + self.slide
            if not n:  # windows without events are not emitted
                due = min((at for (at,) in self.tiles.keys()), default=None) if self.tiles.exists() else None
                if due is not None:
                    due += self.slide
                    total, n = self._whole(due)
        self._save(None, due, total, n)

    def close(self) -> None:
        pass


def deduplicated(checked: DataFrame, value: str = "value", buckets: int = BUCKETS) -> DataFrame:
    """kind valid or invalid for a stream of validated payloads (with `error`). One source feeds both: what
    is malformed passes through beside the ids, dealt out by its hash."""
    message = F.concat("error", F.lit("; payload="), F.coalesce(F.col(value), F.lit("null")))
    fine = F.col("error").isNull()
    bucket = F.pmod(F.xxhash64(F.when(fine, F.col("event_id")).otherwise(F.col(value))), F.lit(buckets))
    mark = F.when(fine, F.unhex(F.concat(F.left(F.sha2("event_id", 256), F.lit(32)), F.left(fingerprint(), F.lit(32)))))
    rows = checked.select(bucket.alias("bucket"), F.when(fine, F.col("event_id")).otherwise(message).alias("event_id"), *RAW_FIELDS[1:], mark.alias("mark"))
    judged = rows.mapInArrow(packed, PACKED).groupBy("bucket").transformWithState(DeduplicatePackets(), JUDGED, "Append", "ProcessingTime")
    told = judged.mapInArrow(unpacked, UNPACKED)
    valid = F.col("verdict") == VALID
    value_ = F.when(F.col("verdict") == CONFLICT, F.concat(F.lit(CONFLICTING), "event_id")).when(~valid, F.col("event_id"))
    return told.select(F.when(valid, "valid").otherwise("invalid").alias("kind"), *[F.when(valid, F.col(c)).alias(c) for c in RAW_FIELDS], value_.alias("value"))


def features(events: DataFrame, window: int = WINDOW_MS, slide: int = HOUR_MS) -> DataFrame:
    """kind feature or late for a stream of de-duplicated events. Filters on keys belong behind this."""
    shift = F.timestamp_millis(F.col("event_timestamp_ms") + SHIFT_HOURS * HOUR_MS)
    delay = SHIFT_HOURS + int(WATERMARK_DELAY.total_seconds() // 3600)
    timed = events.select(*RAW_FIELDS, shift.alias("shifted")).withWatermark("shifted", f"{delay} hours")
    return timed.groupBy("customer_id").transformWithState(RollingFeatures(window, slide), FEATURES_OUT, "Append", "EventTime")
