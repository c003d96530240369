"""Keyed state on Structured Streaming: one processor for every state machine."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from meterloom.session import STATE_STORE, scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class KeyedFold(StatefulProcessor):
    """Feed a key's new rows in order to a step and keep its state between batches."""

    def __init__(self, step: Callable, order: list[str], keys: list[str], columns: list[str], due: Callable | None):
        self.step, self.order, self.keys, self.columns, self.due = step, order, keys, columns, due

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        held = self.state.get()
        state = None if held is None else json.loads(held[0])
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        clean = pdf.astype(object).where(pdf.notna(), None)
        out = []
        for row in clean.to_dict("records"):
            row = {k: int(v) if isinstance(v, float) and k.endswith("_ms") else v for k, v in row.items()}
            state, found = self.step(state, row)
            for one in found if isinstance(found, list) else [found] if found else []:
                out.append({**dict(zip(self.keys, key)), **one})
        self._keep(state)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803 (called by name)
        """A deadline passed without a row of this key: settle it at the deadline."""
        held = self.state.get()
        if held is not None:
            state, found = self.step(json.loads(held[0]), {"kind": "deadline", "at_ms": int(expiredTimerInfo.getExpiryTimeInMs())})
            self._keep(state)
            yield pd.DataFrame([{**dict(zip(self.keys, key)), **one} for one in found or []], columns=self.columns)

    def _keep(self, state):
        self.state.update((json.dumps(state, default=int),))
        if self.due is None:
            return
        wanted = self.due(state)
        for at in list(self.handle.listTimers()):
            if at != wanted:
                self.handle.deleteTimer(at)
        if wanted is not None:
            self.handle.registerTimer(int(wanted))

    def close(self):
        pass


def fold_stream(
    stream: DataFrame, keys: list[str], order: list[str], step: Callable, out: str, due: Callable | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Run a state machine per key over a stream; rows of a micro-batch go in event order.

    `order` has to be total within a key. `due(state)` names the time (ms) at
    which a state has to be settled even if its key stays silent; that happens
    once the newest row of the whole stream is `delay` past it. One key is one
    task within a micro-batch, so the source's rate limit bounds it. Streams
    with many rows per key are aggregated to ticks first.
    """
    kinds = dict(stream.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], out])
    columns = [*keys, *[part.strip().split(" ")[0] for part in out.split(",")]]
    if due is not None:
        stream = stream.withColumn("__event", F.timestamp_millis("at_ms")).withWatermark("__event", delay)
    return stream.groupBy(*keys).transformWithStateInPandas(
        KeyedFold(step, order, keys, columns, due), outputStructType=schema, outputMode="Append", timeMode="EventTime" if due is not None else "None"
    )


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed streams need, for the streams started inside; the session's own setting comes back."""
    held = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if held is None else spark.conf.set(PROVIDER, held)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain what a source holds now into a table below the shared folder, however long that takes.

    Append streams use the file sink. Update streams write each micro-batch to
    its own folder, so a batch that is run again replaces itself; the caller
    keeps the newest batch per key.
    """
    spark = stream.sparkSession
    path, mark = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:

        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

        writer = writer.foreachBatch(save)
    with keyed_state(spark):
        query = writer.start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])).parquet(path)
