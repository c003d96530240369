"""Ordered per-key state on streams: every micro-batch goes through the batch operators.

A batch is folded together with the carry, one row of state per key that the
batch before left behind, and leaves a carry of its own. Rows and carry are
written under the batch's number, so a batch that runs again reads the same carry
and replaces what it had written. The batch operators spread a busy key over
tasks, so a batch may hold any number of rows of one key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.session import discard, folders, remove, scratch_path, settle


@dataclass(frozen=True)
class Carried:
    """A fold over a stream.

    `fold(rows, carry)` gets a batch and the carry (`keys`, `state`) and returns
    rows with the columns of `output`, the order columns and `state`, the state
    after the row. `order` is total within a key. With `forget` keys whose last
    row is further behind the newest one (in the first order column) leave.
    """

    keys: list[str]
    order: list[str]
    state: str
    output: list[str]
    fold: Callable[[DataFrame, DataFrame], DataFrame]
    forget: int | None = None

    def schema(self, batch: DataFrame) -> T.StructType:
        at = batch.schema[self.order[0]].dataType
        return T.StructType([*[T.StructField(k, batch.schema[k].dataType) for k in self.keys], T.StructField("state", T.StructType.fromDDL(f"s {self.state}")["s"].dataType), T.StructField("at", at)])

    def carry(self, rows: DataFrame, before: DataFrame) -> DataFrame:
        """What the next batch starts from."""
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct("state", F.col(self.order[0]).alias("at")), F.struct(*self.order)).alias("s")).select(*self.keys, "s.state", "s.at")
        after = newest.unionByName(before.join(newest, self.keys, "left_anti"))
        if self.forget is None:
            return after
        last = after.agg(F.max("at").alias("last"))
        return after.crossJoin(F.broadcast(last)).where(F.col("at") > F.col("last") - self.forget).drop("last")


def save_batch(spark: SparkSession, how: Carried, base: str, batch: DataFrame, batch_id: int) -> None:
    """Fold one micro-batch; run again, it replaces itself."""
    held = settle(batch, "micro-batch")
    schema = how.schema(held)
    before = spark.read.schema(schema).parquet(f"{base}/carry/batch_id={batch_id - 1}") if batch_id else spark.createDataFrame([], schema)
    at = f"{base}/rows/batch_id={batch_id}"
    names = list(dict.fromkeys([*how.keys, *how.output, *how.order, "state"]))
    rows = how.fold(held, before.drop("at")).select(*names)
    rows.write.mode("overwrite").parquet(at)
    written = spark.read.schema(rows.schema).parquet(at)
    how.carry(written, before).select(*schema.names).write.mode("overwrite").parquet(f"{base}/carry/batch_id={batch_id}")
    discard(held)
    # The carry before the last is never read again: a batch starts once the one before is committed.
    if batch_id > 1:
        remove(spark, f"{base}/carry/batch_id={batch_id - 2}")


def run_carried(stream: DataFrame, how: Carried, label: str, base: str | None = None) -> DataFrame:
    """Drain what a source holds now; the rows of all batches with the columns of the keys and the output.

    A `base` below the shared folder that is given again goes on where the
    stream stopped.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, label)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(lambda batch, batch_id: save_batch(spark, how, base, batch, batch_id)).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    # Before the first row there is no batch: the fold of nothing tells the columns.
    rows = spark.read.parquet(f"{base}/rows") if folders(spark, f"{base}/rows") else _folded(how, spark.createDataFrame([], stream.schema))
    return rows.select(*dict.fromkeys([*how.keys, *how.output]))


def _folded(how: Carried, first: DataFrame) -> DataFrame:
    return how.fold(first, first.sparkSession.createDataFrame([], how.schema(first)).drop("at"))
