"""Stored tables that streams keep up to date, one micro-batch at a time.

Every batch writes under its own number, so a batch that runs again replaces
what it had written and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.operators import telemetry as O
from meterloom.session import discard, remove, settle
from meterloom.sources import stores
from meterloom.streaming.carried import Carried


def drain(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give what a source holds now to `save(batch, batch_id)`, batch by batch."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def save_metrics(batch: DataFrame, batch_id: int, path: str) -> None:
    """Append the request metrics of one batch, by day; run again, the batch replaces its own rows."""
    rows = stores.dated(batch.select(*stores.REQUEST_METRICS.fieldNames()), "timestamp_ms").withColumn("batch_id", F.lit(batch_id).cast("long"))
    rows.hint("rebalance", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch_id").parquet(path)


def read_appended_metrics(spark: SparkSession, path: str) -> DataFrame:
    parts = [T.StructField("dt", T.DateType()), T.StructField("batch_id", T.LongType())]
    return spark.read.schema(T.StructType([*stores.REQUEST_METRICS.fields, *parts])).parquet(path)


TALLY = "service_id bigint, trigger_name string, count bigint"


def save_tally(batch: DataFrame, batch_id: int, base: str) -> None:
    """Add the firings of one batch to the tally the batch before left behind."""
    spark = batch.sparkSession
    before = read_tally(spark, base, batch_id - 1) if batch_id else spark.createDataFrame([], TALLY)
    keys = ["service_id", "trigger_name"]
    new = O.restart_tally(batch).withColumnRenamed("count", "new")
    same = [before[k].eqNullSafe(new[k]) for k in keys]
    both = before.join(new, same, "full_outer")
    out = both.select(*[F.coalesce(before[k], new[k]).alias(k) for k in keys], (F.coalesce("count", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("count"))
    out.write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")
    if batch_id > 1:  # the batch before this one is committed, so its own start is never read again
        remove(spark, f"{base}/batch_id={batch_id - 2}")


def read_tally(spark: SparkSession, base: str, batch_id: int) -> DataFrame:
    return spark.read.schema(TALLY).parquet(f"{base}/batch_id={batch_id}")


def save_history(batch: DataFrame, batch_id: int, base: str, cap: int = O.RESTART_CAP) -> None:
    """Keep the newest restarts of every service: the capped history so far and the batch, capped again."""
    spark = batch.sparkSession
    held = settle(batch, "restarts")
    rows = held if not batch_id else held.unionByName(spark.read.schema(held.schema).parquet(f"{base}/batch_id={batch_id - 1}"))
    O.cap_restart_history(rows, cap).write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")
    discard(held)
    if batch_id > 1:
        remove(spark, f"{base}/batch_id={batch_id - 2}")


def log_union(horizon_ms: int) -> Carried:
    """Seed pages and the live tail as one stream, one line per (service, run, seq): the live copy wins, then the later one.

    Lines: service_id, run_id, seq, timestamp_ms, line, live (boolean). A line
    comes out when it is new or wins over the one that came out before, so the
    newest row of an id is the line. Ids are remembered for `horizon_ms` behind
    the newest line; lines further behind than that are late and left out.
    """
    keys = ["service_id", "run_id", "seq"]
    rank = F.struct(F.col("live"), F.col("timestamp_ms"), F.col("line"))

    def fold(lines: DataFrame, carry: DataFrame) -> DataFrame:
        newest = carry.agg(F.max("state.timestamp_ms").alias("newest"))
        on_time = lines.crossJoin(F.broadcast(newest)).where(F.col("newest").isNull() | (F.col("timestamp_ms") > F.col("newest") - horizon_ms))
        best = on_time.groupBy(*keys).agg(F.max(rank).alias("best"))
        rows = best.join(carry.withColumnRenamed("state", "carried"), keys, "left").where(F.col("carried").isNull() | (F.col("best") > F.col("carried")))
        return rows.select(*keys, "best.*", F.col("best").alias("state"))

    return Carried(keys, ["timestamp_ms", "live", "line"], "struct<live: boolean, timestamp_ms: bigint, line: string>", ["timestamp_ms", "line", "live"], fold, horizon_ms)


def current_lines(rows: DataFrame) -> DataFrame:
    """The line of every id, from all rows of `log_union`."""
    keys = ["service_id", "run_id", "seq"]
    return rows.groupBy(*keys).agg(F.max(F.struct("live", "timestamp_ms", "line")).alias("s")).select(*keys, "s.timestamp_ms", "s.line")
