"""The seam between Kafka and files: streams of (value, topic, partition, offset)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import RAW_TOPIC, WATERMARK_DELAY
from tidemill.operators.stores import text_of
from tidemill.sources.contracts import RAW, RAW_BATCH


@dataclass(frozen=True)
class StreamSource:
    """kind: kafka (location: servers), text (a folder of JSON lines) or parquet (of typed events). max_per_trigger counts
    records of Kafka and files of folders."""

    kind: str
    location: str
    topic: str = ""
    max_per_trigger: int | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        if self.kind == "kafka":
            reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", self.location).option("subscribe", self.topic).option("startingOffsets", "earliest").option("kafka.isolation.level", "read_committed")
            if self.max_per_trigger:
                reader = reader.option("maxOffsetsPerTrigger", self.max_per_trigger)
            return reader.load().select(text_of(F.col("value")).alias("value"), "topic", "partition", "offset")
        reader = spark.readStream
        if self.max_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.max_per_trigger)
        if self.kind == "text":
            return reader.text(self.location)
        if self.kind == "parquet":
            return reader.schema(RAW).parquet(self.location)
        raise ValueError(f"unknown kind of stream: {self.kind}")


@dataclass(frozen=True)
class EventSource:
    """One kind of events, as a stream of JSON messages and as a batch table with their times."""

    name: str
    topic: str
    message: str  # the fields of a message, as DDL
    batch_path: str  # of the table, below the data folder
    table: str  # its columns, as DDL
    timestamp: str = "event_timestamp"
    created: str = "created_timestamp"
    watermark_delay: timedelta = WATERMARK_DELAY

    def stream(self, servers: str, max_per_trigger: int | None = None) -> StreamSource:
        return StreamSource("kafka", servers, self.topic, max_per_trigger)

    def batch(self, spark: SparkSession, data_dir: str) -> DataFrame:
        """The table, in whatever folders its batches lie; empty if there is none."""
        path = f"{data_dir.rstrip('/')}/{self.batch_path}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], self.table)
        return spark.read.schema(self.table).option("recursiveFileLookup", "true").parquet(path)


RAW_EVENTS = EventSource("raw_transactions", RAW_TOPIC, RAW, "raw/transactions.parquet", RAW_BATCH)
