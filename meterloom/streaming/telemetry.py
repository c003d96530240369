"""Rollups and alerts over request streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions import columns as C
from meterloom.functions import scan
from meterloom.operators import sequences as S
from meterloom.operators import telemetry as T
from meterloom.session import settle
from meterloom.streaming import steps
from meterloom.streaming.carried import Carried
from meterloom.streaming.keyed import fold_stream

TICK = "30 seconds"
WINDOW_S = 120


def rollup_stream(metrics: DataFrame, bucket_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Request sums per (bucket, service) in update mode.

    Rows appear when a request completes, so lateness is measured on the
    completion time; the bucket is the start time's and rides along. The sums
    are split by completion hour, which is what lets old state go.
    """
    done = metrics.withColumn("__done", F.timestamp_millis(C.completion_time())).withWatermark("__done", delay)
    keys = [F.window("__done", "1 hour").alias("completed"), C.time_bucket("timestamp_ms", bucket_ms).alias("bucket_start"), F.col("service_id")]
    return done.groupBy(*keys).agg(*T._rollup_sums())


def finish_rollup(batches: DataFrame, services: DataFrame) -> DataFrame:
    """Newest batch per stream key, merged into rollup rows."""
    keys = ["completed", "bucket_start", "service_id"]
    names = [c for c in batches.columns if c not in (*keys, "batch_id")]
    newest = batches.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch_id").alias("s")).select(*keys, "s.*")
    sums = newest.groupBy("bucket_start", "service_id").agg(*[F.sum(c).alias(c) for c in names])
    return T.with_service(sums, services).select("bucket_start", "service_id", "service", *T._rollup_columns())


def error_rate_counts(metrics: DataFrame, min_status: int = 500, window_ms: int = WINDOW_S * 1000, poll_ms: int = 30_000, delay: str = "10 minutes") -> DataFrame:
    """Requests and errors of a run in the window that ends at each poll, in update mode.

    Windows go by the request's start, which is data here: rows appear when a
    request completes, so lateness and the age of state go by completion.
    """
    done = metrics.withColumn("__done", F.timestamp_millis(C.completion_time())).withWatermark("__done", delay)
    first = C.time_bucket("timestamp_ms", poll_ms) + poll_ms
    polls = done.withColumn("poll_ms", F.explode(F.sequence(first, first + (window_ms - poll_ms), F.lit(poll_ms).cast("long"))))
    return polls.groupBy(F.window("__done", "1 hour").alias("completed"), "service_id", "run_id", "poll_ms").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("status_code") >= min_status, 1).otherwise(0)).alias("errors")
    )


def finish_alerts(batches: DataFrame, runs: DataFrame | None = None, min_requests: int = 20, max_rate: float = 0.5, min_uptime_ms: int = 300_000) -> DataFrame:
    """Windows whose error share trips, once the run is old enough.

    `runs`: service_id, run_id, spawned_at; without it every run is old enough.
    """
    keys = ["service_id", "run_id", "poll_ms"]
    newest = batches.groupBy("completed", *keys).agg(F.max_by(F.struct("total", "errors"), "batch_id").alias("s"))
    counts = newest.groupBy(*keys).agg(F.sum("s.total").alias("total"), F.sum("s.errors").alias("errors"))
    hit = counts.filter((F.col("total") >= min_requests) & (F.col("errors") / F.col("total") >= max_rate))
    if runs is None:
        return hit
    aged = hit.join(runs.select("service_id", "run_id", "spawned_at"), ["service_id", "run_id"])
    return aged.filter(F.col("poll_ms") - F.col("spawned_at") >= min_uptime_ms).select(*keys, "total", "errors")


def draft_ticks(metrics: DataFrame, delay: str = "10 seconds", tick: str = TICK) -> DataFrame:
    """Draft counts per (service, run) and completion tick: combined map-side, before any state."""
    rows = metrics.filter(F.col("draft_tokens") > 0).withColumn("__done", F.timestamp_millis(C.completion_time())).withWatermark("__done", delay)
    per = rows.groupBy(F.window("__done", tick).alias("w"), "service_id", "run_id").agg(
        F.sum("draft_tokens").alias("drafted"), F.sum(F.coalesce("draft_tokens_accepted", F.lit(0))).alias("accepted")
    )
    return per.select("service_id", "run_id", F.unix_millis("w.end").alias("at_ms"), "drafted", "accepted")


def _carrying(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what their key brings along, as `carried`."""
    return rows.join(carry.withColumnRenamed("state", "carried"), keys, "left")


def draft_collapse(window_ms: int = WINDOW_S * 1000, floor: int = 200, forget: int | None = 7 * 86_400_000) -> Carried:
    """Draft collapse over `draft_ticks`. A run without a tick for `forget` ms is over."""
    keys = ["service_id", "run_id"]

    def fold(ticks: DataFrame, carry: DataFrame) -> DataFrame:
        rows = _carrying(ticks, carry, keys)
        out = S.draft_windows(rows, keys, window_ms, floor, earlier=F.col("carried.ticks"), ever=F.col("carried.ever"))
        return out.withColumn("state", F.struct(F.col("ticks_after").alias("ticks"), F.col("ever_after").alias("ever")))

    state = "struct<ticks: array<struct<at_ms: bigint, drafted: bigint, accepted: bigint>>, ever: boolean>"
    return Carried(keys, ["at_ms"], state, ["at_ms", "window_drafted", "window_accepted", "collapsed"], fold, forget)


def first_output_stalls(events: DataFrame, timeout_ms: int = 60_000, delay: str = "10 minutes") -> DataFrame:
    """`events`: service, kind (`open`, `frame`, `tick`), request, run_id, at_ms. A service that has gone silent fires too."""
    step, due = partial(steps.first_output_step, timeout_ms=timeout_ms), partial(steps.first_output_due, timeout_ms=timeout_ms)
    return fold_stream(events, ["service"], ["at_ms", "request", "kind"], step, "request string, run_id bigint, at_ms bigint", due, delay)


def counter_stalls(timeout_ms: int, forget: int | None = 7 * 86_400_000) -> Carried:
    """Counter stalls over polls (service, at_ms, poll_id, progress, inflight)."""
    keys = ["service"]

    def fold(polls: DataFrame, carry: DataFrame) -> DataFrame:
        rows = S.counter_stalls(_carrying(polls, carry, keys), keys, timeout_ms, value=F.col("carried.value"), advance=F.col("carried.advance"))
        return rows.withColumn("state", F.struct(F.col("value_after").alias("value"), F.col("advance_after").alias("advance")))

    return Carried(keys, ["at_ms", "poll_id"], "struct<value: bigint, advance: bigint>", ["at_ms", "poll_id", "flat_ms", "stalled"], fold, forget)


def restart_decisions(events: DataFrame, max_age_ms: int = 86_400_000, mode: str = "immediate", delay: str = "10 minutes") -> DataFrame:
    """`events`: service, kind (`spawn`, `firing`, `request`), trigger, inflight, at_ms. Decisions only."""
    step = partial(steps.budget_step, max_age_ms=max_age_ms, mode=mode)
    due = steps.budget_due if mode == "immediate" else None
    return fold_stream(events, ["service"], ["at_ms", "kind", "trigger", "inflight"], step, "at_ms bigint, trigger string, outcome string", due, delay)


def memory(margin_bytes: int = 0, forget: int | None = 7 * 86_400_000) -> Carried:
    """Window, pledge, ceiling and growth of every sample.

    Samples: service, at_ms, sample_id, slot, observed, enforceable, min_mib,
    max_mib. Another slot and a kill clear the window; a service grows when what
    is left rises and heads past the minimum and the margin.
    """
    keys, fold_width = ["service"], 4096

    def fold(samples: DataFrame, carry: DataFrame) -> DataFrame:
        rows = settle(_carrying(S.numbered(samples, keys, ["at_ms", "sample_id"]), carry, keys).withColumn("ceiling", S.ceiling_bytes(F.col("max_mib"))), "samples")
        acts = S.ceiling_actions(rows, keys, slot=F.col("carried.slot"), since=F.col("carried.since"))
        rows = rows.join(acts, [*keys, "step_no"])
        killed = F.when(F.col("action") == "kill", 1).otherwise(0).cast("bigint")
        rows = scan.running(rows, keys, ["step_no"], {"kills": scan.total(killed)}, fold_width).withColumn("epoch", F.struct("slot", (F.col("kills") - killed).alias("kills")))
        rows = settle(rows, "samples")
        # The readings a service brings along stand before its first sample.
        old = rows.where("step_no = 0").select(*keys, "carried", F.posexplode("carried.window").alias("n", "observed"))
        old = old.select(*keys, (F.col("n") - F.size("carried.window")).cast("bigint").alias("step_no"), F.struct(F.col("carried.slot").alias("slot"), F.lit(0).cast("bigint").alias("kills")).alias("epoch"), "observed")
        windows = S.sample_windows(rows.select(*old.columns).unionByName(old), keys, ["step_no"], "observed", "epoch", width=fold_width)
        rows = rows.join(windows.where("step_no >= 0").select(*keys, "step_no", "window"), [*keys, "step_no"])
        rows = settle(rows.withColumn("pledge_mib", S.window_pledge(F.col("window"), F.col("min_mib"), F.col("max_mib"))), "samples")
        moves = S.pledge_updates(rows, keys, held=F.col("carried.held"))
        rows = rows.join(moves, [*keys, "step_no"]).withColumn("window", F.when(F.col("action") == "kill", F.array().cast("array<bigint>")).otherwise(F.col("window")))
        growing = (F.col("action") != "kill") & S.growth(F.col("window"), F.col("min_mib") * S.MIB + margin_bytes)
        return rows.withColumns({"growing": growing, "state": F.struct("slot", "window", F.col("held_mib").alias("held"), F.col("since_ms").alias("since"))})

    state = "struct<slot: string, window: array<bigint>, held: bigint, since: bigint>"
    return Carried(keys, ["at_ms", "sample_id"], state, ["at_ms", "sample_id", "pledge_mib", "held_mib", "emitted", "action", "growing"], fold, forget)


def correction(width: int = scan.CHUNK_MS) -> Carried:
    """Rolling correction over events (service, pool, seq, kind, observed, base). What was learned is never forgotten."""
    output = ["seq", "kind", "mean", "samples", "drift_samples", "drift_alert", "drift_event"]
    return Carried(["service", "pool"], ["seq"], S.LEARNED, output, lambda events, carry: S.rolling_correction(events, width, learned=carry))


def log_numbers(forget: int | None = 7 * 86_400_000) -> Carried:
    """Number streamed lines per (service, run), going on across batches; the micro-batch is the write batch."""
    keys, order = ["service_id", "run_id"], ["timestamp_ms", "stream", "line"]

    def fold(lines: DataFrame, carry: DataFrame) -> DataFrame:
        rows = S.numbered(_carrying(lines, carry, keys), keys, order, "seq")
        rows = rows.withColumn("seq", F.col("seq") + F.coalesce("carried.next", F.lit(0)))
        return rows.withColumn("state", F.struct((F.col("seq") + 1).alias("next")))

    return Carried(keys, [*order, "seq"], "struct<next: bigint>", ["timestamp_ms", "seq", "stream", "line"], fold, forget)


def feed_stream(feed: DataFrame, service: str | None = None, types: list[str] | None = None) -> DataFrame:
    return T.filter_events(feed, service, types)


def recent_events(table: DataFrame, limit: int = 1000) -> DataFrame:
    """Bounded newest-first view over the table a feed stream writes."""
    return table.orderBy(F.desc("at_ms"), "type", "service").limit(limit)
