"""Commands of the engine: python -m tidemill COMMAND.

init creates the empty tables; seed lands the six fixture events, and late-probe one of 32 days ago, as
raw messages; ingest and features run the two streaming queries (from and to Kafka with --kafka, else files)
until stopped, or over what is there with --once; ingest also mirrors valid events to the raw table; push takes the features
to the online and the offline store; materialize computes the view's online table from the raw table in batch; verify
checks that the online values of both paths and their rows of the same window agree.
"""

from __future__ import annotations

import argparse
import json
import signal
import sys
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemill.config import BATCH_RECORDS, CUSTOMER_30D, DAY_MS, FEATURE_TOPIC, HOUR_MS, Settings
from tidemill.functions import forms
from tidemill.operators import stores
from tidemill.plans.materialize import materialize, publish, served
from tidemill.plans.verify import check_parity, check_values, wait_for_record, wait_for_rows
from tidemill.sources.contracts import RAW
from tidemill.sources.streams import RAW_EVENTS, StreamSource
from tidemill.sources.tables import ensure_tables, fixture_events
from tidemill.streaming import jobs, runs, sinks


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tidemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def until_stopped(query, once: bool) -> None:
    """Runs a query until SIGTERM or SIGINT, or until its input is used up."""
    for name in (signal.SIGTERM, signal.SIGINT):
        signal.signal(name, lambda *_: query.stop())
    runs.drain(query) if once else query.awaitTermination()


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    parser.add_argument("command", choices=("init", "seed", "late-probe", "ingest", "features", "push", "materialize", "verify"))
    parser.add_argument("--now-ms", type=int, default=None, help="the hour that ends the fixture; now if not given")
    parser.add_argument("--kafka", action="store_true")
    parser.add_argument("--once", action="store_true")
    parser.add_argument("--wait-seconds", type=float, default=30)
    parser.add_argument("--interval-seconds", type=float, default=1, help="how often push takes what has come")
    parser.add_argument("--path", choices=("batch", "stream", "both"), default="both", help="what verify looks at")
    # what the fixture's first customer has
    parser.add_argument("--total", type=float, default=60.0)
    parser.add_argument("--count", type=int, default=3)
    o = parser.parse_args(args)
    spark, at = session(), Settings()
    hour = (o.now_ms if o.now_ms is not None else int(time.time() * 1000)) // HOUR_MS * HOUR_MS
    base, checkpoint = at.path("stream"), lambda name: at.path("checkpoints", name)
    if o.command == "init":
        ensure_tables(spark, at.data_dir)
    elif o.command in ("seed", "late-probe"):
        rows = fixture_events(spark, hour).drop("arrival") if o.command == "seed" else spark.createDataFrame([("late-" + uuid.uuid4().hex, "customer-001", 1.0, hour - 32 * DAY_MS)], RAW)
        rows.coalesce(1).select(forms.event_json().alias("value")).write.mode("append").text(at.path("raw", "messages"))
    elif o.command == "ingest":
        source = RAW_EVENTS.stream(at.kafka_servers) if o.kafka else StreamSource("text", at.path("raw", "messages"))
        more = [sinks.raw_mirror(at.path(RAW_EVENTS.batch_path))] + ([sinks.ingest_topics(at.kafka_servers)] if o.kafka else [])
        until_stopped(jobs.ingest(spark, source.read(spark), base, checkpoint("ingest"), "1 second" if o.once else "10 seconds", *more), o.once)
    elif o.command == "features":
        more = [sinks.feature_topics(at.kafka_servers)] if o.kafka else []
        query = jobs.rolling(spark, StreamSource("parquet", f"{base}/valid/*").read(spark), base, checkpoint("features"), None if o.once else "10 seconds", *more)
        query.awaitTermination() if o.once else until_stopped(query, False)
    elif o.command == "push":
        if o.kafka:
            messages = StreamSource("kafka", at.kafka_servers, FEATURE_TOPIC, BATCH_RECORDS).read(spark)
        else:  # a file of features stands for a partition, its rows for the offsets
            made = spark.readStream.schema(jobs.FEATURE_DDL).parquet(f"{base}/feature/*")
            place = [F.lit(FEATURE_TOPIC).alias("topic"), F.regexp_extract("_metadata.file_path", "batch=([0-9]+)", 1).cast("int").alias("partition"), F.col("_metadata.row_index").alias("offset")]
            messages = forms.with_metadata(made.select("*", *place)).select(forms.feature_json().alias("value"), "topic", "partition", "offset")
        writer = messages.writeStream.option("checkpointLocation", checkpoint("push")).foreachBatch(sinks.Pusher(spark, at.path("pushed")))
        query = (writer.trigger(availableNow=True) if o.once else writer.trigger(processingTime=f"{o.interval_seconds} seconds")).start()
        query.awaitTermination() if o.once else until_stopped(query, False)
    elif o.command == "materialize":
        read = lambda: RAW_EVENTS.batch(spark, at.data_dir)
        wait_for_rows(read, timeout_s=max(60, o.wait_seconds))
        rows = materialize(read(), hour - 31 * DAY_MS, hour - HOUR_MS)
        publish(CUSTOMER_30D, rows, at.path("online", "customer_30d"), at.path("offline", "customer_30d_batch"))
    else:
        ask, pushed = spark.createDataFrame([("customer-001",)], "customer_id string"), sinks.Pusher(spark, at.path("pushed"))
        there = F.col("total_amount_30d").isNotNull()
        online = {
            "batch": lambda: served(CUSTOMER_30D, ask, spark.read.parquet(at.path("online", "customer_30d")), hour),
            "stream": lambda: stores.lookup(ask, pushed.online(), hour),
        }
        rows = {name: wait_for_record(read, there, o.wait_seconds) for name, read in online.items() if o.path in (name, "both")}
        for row in rows.values():
            check_values(row, o.total, o.count)
        if o.path == "both":
            rows["stream at the batch's window"] = check_parity(rows["batch"], pushed.offline())
        print(json.dumps({name: row.asDict() for name, row in rows.items()}))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
