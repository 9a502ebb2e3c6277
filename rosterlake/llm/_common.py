"""What the operators of this subpackage share: inputs, keys and cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Unset, a run on one machine takes a temporary one; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


@contextmanager
def small_batches(spark: SparkSession):
    """While it holds, texts go to Python in Arrow batches of BATCH_BYTES, however long they are: a task's memory is bounded by it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and a lost executor costs nothing before it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.settled_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what settled() wrote, once nothing reads it any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key that rows share only if id and text are the same; also there for a null id."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def buckets(spark: SparkSession) -> int:
    """Four buckets for each shuffle partition, so that partitions fill evenly."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
