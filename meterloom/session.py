"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHECKPOINT_CONF = "spark.checkpoint.dir"
METHOD_CONF = "spark.sql.codegen.hugeMethodLimit"
#: Bytes of a method above which HotSpot doesn't compile it.
JIT_LIMIT = 8000
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 1_000_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("meterloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a `local` master may go without the setting (tests, a laptop); a local
    folder is made there. On a cluster such a folder would be another one on
    each machine, so a missing setting is an error.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="meterloom-")
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def _set(spark: SparkSession, conf: str, value: int) -> Iterator[None]:
    before = spark.conf.get(conf)
    spark.conf.set(conf, value)
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def compiled(spark: SparkSession) -> AbstractContextManager[None]:
    """While a table of many computed columns is written: no stage as one method so long that the JVM only interprets it."""
    return _set(spark, METHOD_CONF, JIT_LIMIT)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where a step reads its input several times: the plan stays small and a
    lost executor costs a re-read, not a re-run.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def settle_mapped(df: DataFrame, label: str) -> DataFrame:
    """`settle` for rows that pass through Python workers with whole texts.

    Executor and workers each hold the batch that is on its way, at every step
    of a chain of them. Batches of a fixed number of rows grow with the texts,
    so they are bounded by bytes while the table is written.
    """
    with _set(df.sparkSession, BATCH_CONF, BATCH_BYTES):
        return settle(df, label)


def discard(df: DataFrame) -> None:
    """Remove a settled table that no later step reads."""
    remove(df.sparkSession, df.settled_at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of a store that Spark reads, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path, none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []
