"""What several training-data operators need: durable cuts of a plan, shared work
folders and Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a vectorised step looks at together; one longer text stands alone.
CHUNK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's
    checkpoint folder; a temporary folder only for a local master, where one machine runs all."""
    jsc = spark.sparkContext._jsc.sc()
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def release(spark: SparkSession) -> None:
    """Removes the checkpoints of this session's cut() from the shared folder. Tables that were not written before can't
    be read afterwards."""
    shared_dir(spark)
    remove(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder; lost executors don't undo them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Work:
    """A folder of tables under the shared folder, removed with drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def forget(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            remove(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        remove(self.spark, self.path)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have at most `limit` bytes, or one text."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


#: A key that meets over this part of all rows of a join is heavy, so there are at most so many, and the
#: least rows that count.
HEAVY, HEAVY_ROWS = 512, 10_000
#: Tasks that share the rows of a heavy key.
SALTS = 64


def join_skewed(left: DataFrame, right: DataFrame, on: str, weight: str, only: str | None = None) -> DataFrame:
    """left join right by `on`; `right` (stored, one row for each key) says in `weight` how many rows of `left` have
    the key. Heavy keys are dealt out with a salt. Only rows of `right` that fulfil `only` are joined. `weight`
    stays a column."""
    bound = right.agg(F.sum(weight)).first()[0] or 0
    heavy = [r[0] for r in right.where(F.col(weight) >= max(HEAVY_ROWS, bound / HEAVY)).select(on).collect()]
    right = right.where(only) if only else right
    if not heavy:
        return left.join(right, on)
    salt = free_name([*left.columns, *right.columns], "salt")
    hot = F.col(on).isin(heavy)
    left = left.withColumn(salt, F.when(hot, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = right.withColumn(salt, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [on, salt]).drop(salt)


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores before it until no column is called so (case is ignored)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
