"""Serving telemetry: rollups, histories, retention and dashboard series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import columns as C
from meterloom.functions import scan
from meterloom.functions.reduce import evidence, medians

# Retention, page sizes and windows.
DAY_MS = 86_400_000
LOG_RETENTION_MS = 7 * DAY_MS
METRIC_RETENTION_MS = 7 * DAY_MS
SAMPLE_RETENTION_MS = DAY_MS
LOG_CAP = 50_000
RESTART_CAP = 50
LOG_PAGE_DEFAULT = 200
LOG_PAGE_MAX = 1000
GAUGE_WINDOW_MS = 300_000
SPARSE_GAP_S = 900.0

RATES = ["output", "input", "effective"]


# --- filters ---------------------------------------------------------------


def in_window(df: DataFrame, stamp: str, since: int | None, until: int | None, **equals) -> DataFrame:
    """Inclusive time window plus optional equality filters; `None` filters nothing."""
    out = df.filter(C.within(stamp, since, until))
    for column, wanted in equals.items():
        if wanted is not None:
            out = out.filter(F.col(column) == F.lit(wanted))
    return out


def live_services(services: DataFrame) -> DataFrame:
    return services.filter(F.col("deleted_at").isNull())


def filter_logs(logs: DataFrame, since=None, until=None, run=None, stream=None) -> DataFrame:
    return in_window(logs, "timestamp_ms", since, until, run_id=run, stream=stream)


def search_logs(logs: DataFrame, text: str = "", stream: str = "both", run=None) -> DataFrame:
    """Viewer filter: `both` keeps every stream, the text match ignores case."""
    out = logs if stream == "both" else logs.filter(F.col("stream") == stream)
    if run is not None:
        out = out.filter(F.col("run_id") == run)
    return out.filter(F.lower("line").contains(text.lower())) if text else out


def filter_events(feed: DataFrame, service: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Service-less events always pass the service filter; no types means all types."""
    out = feed
    if service is not None:
        out = out.filter(F.coalesce(F.col("service") == service, F.lit(True)))
    return out.filter(F.col("type").isin(types)) if types else out


# --- joins -----------------------------------------------------------------


def with_service(metrics: DataFrame, services: DataFrame) -> DataFrame:
    """Left join the service name; metrics of a vanished service keep a null name."""
    names = services.select("service_id", F.col("name").alias("service"))
    return metrics.join(names, "service_id", "left")


def restarts_with_service(restarts: DataFrame, services: DataFrame, since=None, until=None, service_id=None) -> DataFrame:
    """Firings with their service name, tombstoned services included, oldest first."""
    rows = in_window(restarts, "at_ms", since, until, service_id=service_id)
    return rows.join(services.select("service_id", F.col("name").alias("service")), "service_id").orderBy("at_ms", "restart_id")


def last_request_per_service(metrics: DataFrame, services: DataFrame) -> DataFrame:
    """Newest request stamp per live service name (aggregated before the join)."""
    newest = metrics.groupBy("service_id").agg(F.max("timestamp_ms").alias("last_used"))
    named = live_services(services).select("service_id", "name").join(newest, "service_id")
    return named.groupBy("name").agg(F.max("last_used").alias("last_used"))


def devices_with_reservations(devices: DataFrame, reservations: DataFrame) -> DataFrame:
    """Every device beside each reservation on its slot; one null row when none.

    Kept long: a slot that many services share is never gathered into one row.
    """
    return devices.join(reservations.select("slot", "service", "mib"), "slot", "left")


# --- request rollups -------------------------------------------------------


def _rollup_sums() -> list[Column]:
    decode, prefill = C.decode_ms(), C.prefill_ms()
    zero = F.lit(0)
    evaluated = F.coalesce("prompt_eval_tokens", "prompt_tokens")
    return [
        F.count(F.lit(1)).alias("request_count"),
        F.coalesce(F.sum("prompt_tokens"), zero).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), zero).alias("completion_tokens"),
        F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0)).alias("error_count"),
        F.sum("duration_ms").alias("duration_sum"),
        F.count("duration_ms").alias("duration_n"),
        F.sum("ttft_ms").alias("ttft_sum"),
        F.count("ttft_ms").alias("ttft_n"),
        F.coalesce(F.sum(F.when(decode.isNotNull(), F.col("completion_tokens"))), zero).alias("output_tokens"),
        F.coalesce(F.sum(decode), zero).alias("output_ms"),
        F.coalesce(F.sum(F.when(prefill.isNotNull(), evaluated)), zero).alias("input_tokens"),
        F.coalesce(F.sum(prefill), zero).alias("input_ms"),
        F.coalesce(F.sum(F.when(F.col("duration_ms").isNotNull(), F.col("completion_tokens"))), zero).alias("effective_tokens"),
        F.coalesce(F.sum("duration_ms"), zero).alias("effective_ms"),
    ]


def _rollup_columns() -> list[Column]:
    return [
        F.col("request_count"),
        F.col("prompt_tokens"),
        F.col("completion_tokens"),
        F.col("error_count"),
        F.try_divide("duration_sum", "duration_n").alias("avg_duration_ms"),
        F.try_divide("ttft_sum", "ttft_n").alias("avg_ttft_ms"),
        *[C.tokens_per_second(F.col(f"{r}_tokens"), F.col(f"{r}_ms")).alias(f"{r}_tps") for r in RATES],
    ]


def request_rollup(
    metrics: DataFrame,
    services: DataFrame,
    bucket_ms: int,
    since: int | None = None,
    until: int | None = None,
    service_id: int | None = None,
) -> DataFrame:
    """Requests, tokens, errors and throughput per (bucket, service).

    One shuffle, of map-side combined whole-number sums; names are joined onto
    the rollup, never onto the raw rows.
    """
    rows = in_window(metrics, "timestamp_ms", since, until, service_id=service_id)
    sums = rows.groupBy(C.time_bucket("timestamp_ms", bucket_ms).alias("bucket_start"), "service_id").agg(*_rollup_sums())
    return with_service(sums, services).select("bucket_start", "service_id", "service", *_rollup_columns())


def throughput_tiers(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The token and time sums behind each rate tier, and the rates."""
    sums = metrics.groupBy(*keys).agg(*_rollup_sums())
    parts = [f"{r}_{p}" for r in RATES for p in ("tokens", "ms")]
    return sums.select(*keys, *parts, *_rollup_columns()[-3:])


def _weighted() -> list[Column]:
    """Weights are request counts, also where part of the requests lacked the figure."""
    out = [
        F.sum("request_count").alias("request_count"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("error_count").alias("error_count"),
    ]
    for source, name in [("avg_duration_ms", "duration"), *[(f"{r}_tps", r) for r in RATES]]:
        out.append(F.coalesce(F.sum(F.col(source) * F.col("request_count")), F.lit(0.0)).alias(f"{name}_weighted"))
        out.append(
            F.coalesce(F.sum(F.when(F.col(source).isNotNull(), F.col("request_count"))), F.lit(0)).alias(f"{name}_requests")
        )
    return out


def _resolved(rounded: int | None = None) -> list[Column]:
    names = {"duration": "avg_duration_ms", **{r: f"{r}_tps" for r in RATES}}
    out = []
    for name, alias in names.items():
        value = F.try_divide(f"{name}_weighted", f"{name}_requests")
        out.append((value if rounded is None else F.round(value, rounded)).alias(alias))
    return out


COUNTS = ["request_count", "prompt_tokens", "completion_tokens", "error_count"]


def combine_services(rollup: DataFrame, rounded: int | None = None) -> DataFrame:
    """Buckets merged across services, rates weighted by request count."""
    merged = rollup.groupBy(F.expr("bucket_start div 1000").alias("ts")).agg(*_weighted())
    return merged.select("ts", *COUNTS, *_resolved(rounded))


def service_series(rollup: DataFrame, rounded: int | None = None) -> DataFrame:
    """One series per service name, with the total that orders the services."""
    named = rollup.withColumn("service", F.coalesce("service", F.lit("unknown")))
    merged = named.groupBy("service", F.expr("bucket_start div 1000").alias("ts")).agg(*_weighted())
    totals = named.groupBy("service").agg(F.sum("request_count").alias("service_requests"))
    return (
        merged.join(totals, "service")
        .select("service", "service_requests", "ts", *COUNTS, *_resolved(rounded))
        .orderBy(F.desc("service_requests"), "service", "ts")
    )


def request_sparkline(rollup: DataFrame) -> DataFrame:
    """Per service the bucket seconds and request counts as two aligned arrays.

    A rolled-up service holds at most span / bucket points, which bounds the arrays.
    """
    points = rollup.groupBy(
        F.coalesce("service", F.lit("unknown")).alias("service"), F.expr("bucket_start div 1000").alias("ts")
    ).agg(F.sum("request_count").alias("n"))
    lists = points.groupBy("service").agg(F.array_sort(F.collect_list(F.struct("ts", "n"))).alias("p"))
    return lists.select("service", F.col("p.ts").alias("ts"), F.col("p.n").alias("counts"))


def window_totals(rollup: DataFrame, rounded: int | None = None) -> DataFrame:
    """Totals and averages over a whole window; averages divide by at least one."""
    sums = rollup.agg(*_weighted())
    out = [F.coalesce(c, F.lit(0)).alias(f"total_{c}") for c in COUNTS]
    for name, alias in {"duration": "avg_latency_ms", **{r: f"avg_{r}_tps" for r in RATES}}.items():
        value = F.col(f"{name}_weighted") / F.greatest(F.lit(1), F.col(f"{name}_requests"))
        out.append((value if rounded is None else F.round(value, rounded)).alias(alias))
    split = (F.col("output_requests") > 0) | (F.col("input_requests") > 0)
    return sums.select(*out, split.alias("has_split_tps"))


def lifetime_counters(metrics: DataFrame, services: DataFrame, now: int, span_ms: int = METRIC_RETENTION_MS) -> DataFrame:
    """Counter samples per live service; a service without requests reads zero."""
    rows = in_window(metrics, "timestamp_ms", now - span_ms, now)
    sums = rows.groupBy("service_id").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion")
    )
    wide = live_services(services).select("service_id", "name").join(sums, "service_id", "left")
    filled = wide.select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "prompt", "completion")])
    return filled.unpivot("name", ["requests", "prompt", "completion"], "counter", "value").withColumnRenamed("name", "service")


def recent_rate_gauges(
    metrics: DataFrame, services: DataFrame, now: int, window_ms: int = GAUGE_WINDOW_MS, rounded: int | None = None
) -> DataFrame:
    """Request-weighted mean of bucket rates over a look-back, zero when nothing was timed.

    The bucket grid is epoch-aligned, so a look-back of one bucket usually
    covers two and weighs them.
    """
    rollup = request_rollup(metrics, services, window_ms, now - window_ms, now)
    sums = rollup.groupBy("service_id").agg(*_weighted())
    wide = live_services(services).select("service_id", "name").join(sums, "service_id", "left")
    rates = []
    for r in RATES:
        value = F.coalesce(F.try_divide(f"{r}_weighted", f"{r}_requests"), F.lit(0.0))
        rates.append((value if rounded is None else F.round(value, rounded)).alias(f"{r}_tps"))
    return wide.select(F.col("name").alias("service"), *rates)


def run_error_rate(metrics: DataFrame, since: int, min_status: int = 500) -> DataFrame:
    """Requests and errors per (service, run) from `since` on."""
    rows = metrics.filter(F.col("timestamp_ms") >= since)
    return rows.groupBy("service_id", "run_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("status_code") >= min_status, 1).otherwise(0)).alias("errors")
    )


def draft_acceptance(metrics: DataFrame, since: int) -> DataFrame:
    """Draft counts per (service, run): the window by completion time, and the run's lifetime.

    Rows appear at completion, so a window on the start stamp would miss the
    long generations that show a collapse.
    """
    recent = C.completion_time() >= since
    accepted = F.coalesce("draft_tokens_accepted", F.lit(0))
    return (
        metrics.filter(F.col("draft_tokens") > 0)
        .groupBy("service_id", "run_id")
        .agg(
            F.sum(F.when(recent, 1).otherwise(0)).alias("window_drafting"),
            F.sum(F.when(recent, F.col("draft_tokens")).otherwise(0)).alias("window_drafted"),
            F.sum(F.when(recent, accepted).otherwise(0)).alias("window_accepted"),
            F.sum(accepted).alias("run_accepted"),
        )
    )


# --- restarts --------------------------------------------------------------


def restart_tally(restarts: DataFrame) -> DataFrame:
    """Firings per (service, trigger), counted before any history cap."""
    return restarts.groupBy("service_id", "trigger_name").agg(F.count(F.lit(1)).alias("count"))


def merge_tally(tally: DataFrame, new_firings: DataFrame) -> DataFrame:
    """Add new firings to a stored tally; a count never falls."""
    keys = ["service_id", "trigger_name"]
    both = tally.select(*keys, "count").unionByName(restart_tally(new_firings))
    return both.groupBy(*keys).agg(F.sum("count").alias("count"))


def restart_counts(tally: DataFrame, service_id: int) -> DataFrame:
    return tally.filter(F.col("service_id") == service_id).select("trigger_name", "count")


def cap_restart_history(restarts: DataFrame, cap: int = RESTART_CAP) -> DataFrame:
    return scan.top_per_key(restarts, ["service_id"], [F.desc("at_ms"), F.desc("restart_id")], cap)


def recent_restarts(restarts: DataFrame, k: int = 10, service_id: int | None = None) -> DataFrame:
    rows = in_window(restarts, "at_ms", None, None, service_id=service_id)
    return rows.orderBy(F.desc("at_ms"), F.desc("restart_id")).limit(k)


def latest_run_per_service(runs: DataFrame) -> DataFrame:
    """The newest running row per service, ties by the larger run id."""
    return scan.pick_per_key(runs, ["service_id"], F.struct("spawned_at", "run_id"))


# --- devices ---------------------------------------------------------------


def pledged_per_slot(reservations: DataFrame) -> DataFrame:
    return reservations.groupBy("slot").agg(F.sum("mib").alias("pledged_mib"))


def device_bar(devices: DataFrame, reservations: DataFrame) -> DataFrame:
    """Used, pledged beyond use, and headroom per device (whole MiB)."""
    joined = devices.join(pledged_per_slot(reservations), "slot", "left")
    pledged = F.coalesce("pledged_mib", F.lit(0))
    used = F.col("total_mib") - F.col("free_mib")
    extra = F.greatest(pledged - used, F.lit(0))
    return joined.select(
        "slot",
        used.alias("used_mib"),
        extra.alias("pledged_extra_mib"),
        F.greatest(F.col("total_mib") - used - extra, F.lit(0)).alias("headroom_mib"),
    )


# --- retention -------------------------------------------------------------


def keep_recent(df: DataFrame, stamp: str, now: int, span_ms: int) -> DataFrame:
    """Drop rows strictly older than the cutoff; prunes partitions when `stamp` drives them."""
    return df.filter(F.col(stamp) >= now - span_ms)


def age_report(df: DataFrame, stamp: str, now: int, span_ms: int) -> DataFrame:
    """Rows kept and removed by an age cutoff."""
    old = F.col(stamp) < now - span_ms
    return df.agg(
        F.coalesce(F.sum(F.when(old, 1).otherwise(0)), F.lit(0)).alias("removed"),
        F.coalesce(F.sum(F.when(old, 0).otherwise(1)), F.lit(0)).alias("kept"),
    )


def trim_logs(
    logs: DataFrame,
    services: DataFrame,
    now: int,
    cap: int = LOG_CAP,
    span_ms: int = LOG_RETENTION_MS,
    width: int = scan.CHUNK_MS,
) -> DataFrame:
    """Age cutoff, then the newest `cap` rows per live service.

    The row just past the cap is the cutoff and everything at or below its
    (time, seq) goes, so equal pairs of different runs leave together. The
    cutoff is found from per-chunk counts first; only the one chunk that holds
    it is ranked row by row, so a busy service is never sorted in one task.
    """
    recent = keep_recent(logs, "timestamp_ms", now, span_ms)
    live = live_services(services).select("service_id")
    tagged = scan.chunked(recent, ["timestamp_ms"], width)
    sizes = tagged.groupBy("service_id", scan.CHUNK).agg(F.count(F.lit(1)).alias("__n")).join(live, "service_id", "left_semi")
    newest_first = Window.partitionBy("service_id").orderBy(F.desc(scan.CHUNK))
    edges = sizes.withColumn("__upto", F.sum("__n").over(newest_first.rowsBetween(Window.unboundedPreceding, 0))).filter(
        (F.col("__upto") > cap) & (F.col("__upto") - F.col("__n") <= cap)
    )
    edge_rows = tagged.join(edges.withColumn("__skip", cap - (F.col("__upto") - F.col("__n"))), ["service_id", scan.CHUNK])
    inside = Window.partitionBy("service_id", scan.CHUNK).orderBy(F.desc("timestamp_ms"), F.desc("seq"))
    cut = (
        edge_rows.withColumn("__row", F.row_number().over(inside))
        .filter(F.col("__row") == F.col("__skip") + 1)
        .select("service_id", F.struct("timestamp_ms", "seq").alias("__cut"))
    )
    past = F.struct("timestamp_ms", "seq") <= F.col("__cut")
    return recent.join(cut, "service_id", "left").filter(F.coalesce(~past, F.lit(True))).select(*logs.columns)


# --- logs ------------------------------------------------------------------


def log_page(logs: DataFrame, limit: int | None = None, before: dict | None = None, **filters) -> DataFrame:
    """Newest lines first, with the next page's key on every row when there is one.

    The key is the sort key itself (time, seq, run), so pages never skip or
    repeat a line. Only limit + 1 rows reach the last step.
    """
    size = min(limit or LOG_PAGE_DEFAULT, LOG_PAGE_MAX)
    rows = filter_logs(logs, **filters)
    key = ["timestamp_ms", "seq", "run_id"]
    if before is not None:
        rows = rows.filter(F.struct(*key) < F.struct(*[F.lit(before[c]).cast("long").alias(c) for c in key]))
    page = rows.orderBy(*[F.desc(c) for c in key]).limit(size + 1)
    whole = Window.partitionBy(F.lit(1))
    newest = whole.orderBy(*[F.desc(c) for c in key])
    numbered = page.select("*", F.row_number().over(newest).alias("__row"), F.count(F.lit(1)).over(whole).alias("__n"))
    last = F.max(F.when(F.col("__row") == size, F.struct(*key))).over(whole)
    keyed = numbered.withColumn("__last", F.when(F.col("__n") > size, last))
    return keyed.filter(F.col("__row") <= size).select(
        *logs.columns, *[F.col(f"__last.{c}").alias(f"next_{c}") for c in key]
    )


def recent_lines(logs: DataFrame, service_id: int, n: int = LOG_PAGE_DEFAULT) -> DataFrame:
    rows = logs.filter(F.col("service_id") == service_id)
    return rows.orderBy(F.desc("timestamp_ms"), F.desc("seq"), F.desc("run_id")).limit(n)


def log_seed(logs: DataFrame, pages: int, page: int = LOG_PAGE_MAX, **filters) -> DataFrame:
    """What several pages read one after another return, and whether more was left."""
    cap = pages * page
    key = ["timestamp_ms", "seq", "run_id"]
    rows = filter_logs(logs, **filters).orderBy(*[F.desc(c) for c in key]).limit(cap + 1)
    whole = Window.partitionBy(F.lit(1))
    numbered = rows.select(
        "*", F.row_number().over(whole.orderBy(*[F.desc(c) for c in key])).alias("__row"), F.count(F.lit(1)).over(whole).alias("__n")
    )
    return numbered.filter(F.col("__row") <= cap).select(*logs.columns, (F.col("__n") > cap).alias("truncated"))


def merge_log_seed(seed: DataFrame, live: DataFrame, keys: tuple[str, ...] = ("service_id", "run_id", "seq")) -> DataFrame:
    """Seed and live tail as one, one row per line id; the live copy wins."""
    both = seed.withColumn("__src", F.lit(0)).unionByName(live.withColumn("__src", F.lit(1)))
    order = F.struct("__src", "timestamp_ms", "line")
    return scan.pick_per_key(both, list(keys), order).drop("__src")


# --- chart series ----------------------------------------------------------


def error_restart_grid(metrics: DataFrame, restarts: DataFrame, since: int, until: int, width_ms: int) -> DataFrame:
    """Errors and restarts on one zero-filled grid aligned to the epoch."""
    first = since // width_ms * width_ms
    bins = max(1, -(-(until - first) // width_ms))
    spark = metrics.sparkSession
    spine = spark.range(bins).select((F.lit(first) + F.col("id") * width_ms).alias("bin"))
    errors = in_window(metrics, "timestamp_ms", since, until).filter(F.col("status_code") >= 400)
    errors = errors.groupBy(C.time_bucket("timestamp_ms", width_ms).alias("bin")).agg(F.count(F.lit(1)).alias("errors"))
    fired = in_window(restarts, "at_ms", since, until)
    fired = fired.groupBy(C.time_bucket("at_ms", width_ms).alias("bin")).agg(F.count(F.lit(1)).alias("restarts"))
    return (
        spine.join(errors, "bin", "left")
        .join(fired, "bin", "left")
        .select(
            F.expr("bin div 1000").alias("ts"),
            F.coalesce("errors", F.lit(0)).alias("errors"),
            F.coalesce("restarts", F.lit(0)).alias("restarts"),
        )
    )


def aligned_series(points: DataFrame, series: str, value: str, names: list[str], at: str = "ts") -> DataFrame:
    """Series side by side on the union of their times; null where one has no point."""
    return points.groupBy(at).pivot(series, names).agg(F.max(value))


def memory_series(samples: DataFrame, devices: list[str], rounded: int | None = None) -> DataFrame:
    """Used gigabytes per device on one time axis; the later sample in a second wins."""
    per = samples.withColumn("ts", F.expr("timestamp_ms div 1000")).groupBy("ts", "device").agg(
        F.max_by("used_bytes", F.struct("timestamp_ms", "sample_id")).alias("used_bytes")
    )
    value = F.col("used_bytes") / F.lit(1e9)
    gb = per.withColumn("gb", value if rounded is None else F.round(value, rounded))
    return aligned_series(gb, "device", "gb", devices)


def zero_fill_gaps(
    points: DataFrame, key: str, at: str, value: str, x_min: int, x_max: int, gap_s: float | None = None, eps: int = 1
) -> DataFrame:
    """Drop a series to zero across missing spans instead of bridging them.

    A gap is more than 1.5 times the series' own median spacing. Points are
    rolled-up buckets, so a series is bounded by span / bucket.
    """
    w = Window.partitionBy(key).orderBy(at)
    spaced = points.select(key, at, value, F.lag(at).over(w).alias("__prev"), F.lead(at).over(w).alias("__next"))
    spaced = spaced.withColumn("__gap", (F.col(at) - F.col("__prev")).cast("double"))
    if gap_s is None:
        typical = medians(spaced, [key], "__gap").select(key, (F.col("median") * 1.5).alias("__limit"))
        limited = spaced.join(typical, key, "left").withColumn("__limit", F.coalesce("__limit", F.lit(SPARSE_GAP_S)))
    else:
        limited = spaced.withColumn("__limit", F.lit(float(gap_s)))
    limit = F.col("__limit")
    here = F.col(at)

    def point(t: Column, v: Column) -> Column:
        return F.struct(t.cast("long").alias("t"), v.cast("double").alias("v"))

    zero = F.lit(0.0)
    first, last = F.col("__prev").isNull(), F.col("__next").isNull()
    lead_in = F.when(first & (here - x_min > limit), F.array(point(F.lit(x_min), zero), point(here - eps, zero)))
    gap_in = F.when(F.col("__gap") > limit, F.array(point(F.col("__prev") + eps, zero), point(here - eps, zero)))
    tail = F.when(last & (F.lit(x_max) - here > limit), F.array(point(here + eps, zero), point(F.lit(x_max), zero)))
    none = F.array().cast("array<struct<t:bigint,v:double>>")
    every = F.concat(
        F.coalesce(lead_in, none), F.coalesce(gap_in, none), F.array(point(here, F.col(value))), F.coalesce(tail, none)
    )
    return limited.select(key, F.explode(every).alias("p")).select(key, F.col("p.t").alias(at), F.col("p.v").alias(value))


def evidence_per_group(df: DataFrame, keys: list[str], order: str, text: Column) -> DataFrame:
    """Group count and its details as one line in a fixed order."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), evidence(F.col(order), text).alias("evidence"))
