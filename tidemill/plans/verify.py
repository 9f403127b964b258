"""Waiting for rows and values, and the check that batch and stream agree."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def wait_for_record(read: Callable[[], DataFrame], predicate: Column, timeout_s: float = 90, poll_s: float = 1) -> Row:
    """The first row that fulfils `predicate`; read() is asked again until there is one."""
    end = time.monotonic() + timeout_s
    while True:
        found = read().where(predicate).limit(1).collect()
        if found:
            return found[0]
        if time.monotonic() >= end:
            raise TimeoutError(f"no record in {timeout_s} s")
        time.sleep(poll_s)


def wait_for_rows(read: Callable[[], DataFrame], least: int = 5, timeout_s: float = 60, poll_s: float = 1) -> int:
    end = time.monotonic() + timeout_s
    while True:
        n = read().count()
        if n >= least:
            return n
        if time.monotonic() >= end:
            raise TimeoutError(f"{n} of {least} rows in {timeout_s} s")
        time.sleep(poll_s)


def check_values(row: Row | None, total: float, count: int) -> None:
    """An error unless `row` has these values of a customer's features."""
    if row is None:
        raise AssertionError("there is no row")
    if not math.isclose(row["total_amount_30d"] or 0.0, total) or row["tx_count_30d"] != count:
        raise AssertionError(f"{total} in {count} transactions were wanted, but there are {row}")


def check_parity(batch: Row, stream: DataFrame) -> Row:
    """The stream's row of the batch row's customer and window end; an error if it is missing or has other values."""
    same = (F.col("customer_id") == batch["customer_id"]) & (F.col("window_end_ms") == batch["window_end_ms"])
    found = stream.where(same).limit(1).collect()
    if not found:
        raise AssertionError(f"the stream has no window that ends at {batch['window_end_ms']} for {batch['customer_id']}")
    check_values(found[0], batch["total_amount_30d"], batch["tx_count_30d"])
    return found[0]
