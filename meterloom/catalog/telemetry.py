"""Registered telemetry queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions import columns as C
from meterloom.operators import telemetry as T
from meterloom.session import scratch_path
from meterloom.sources import bindings as B
from meterloom.sources import stores

DAY = T.DAY_MS
HOUR = 3_600_000


def _latest(df: DataFrame, stamp: str = "timestamp_ms") -> int:
    """The newest stamp in a table: "now" for a table at rest (one aggregate row)."""
    return df.agg(F.max(stamp)).first()[0]


def _rollup(s, d, bucket=DAY, **kw):
    return T.request_rollup(B.request_metrics(s, d), B.services(s, d), bucket, **kw)


OUT = "coalesce(predicted_ms, duration_ms - ttft_ms)"
INP = "coalesce(prompt_ms, ttft_ms)"
TPS = "case when {r}_ms > 0 and {r}_tok > 0 then {r}_tok / ({r}_ms / 1000.0::double) end as {r}_tps"


def _sums_sql(keys: str, where: str = "true", rel: str = "rm") -> str:
    return f"""select {keys}, count(*) as request_count, coalesce(sum(prompt_tokens), 0) as prompt_tokens,
      coalesce(sum(completion_tokens), 0) as completion_tokens,
      sum(case when status_code >= 400 then 1 else 0 end) as error_count,
      sum(duration_ms)::double / nullif(count(duration_ms), 0) as avg_duration_ms,
      sum(ttft_ms)::double / nullif(count(ttft_ms), 0) as avg_ttft_ms,
      coalesce(sum(case when {OUT} is not null then completion_tokens end), 0) as output_tok,
      coalesce(sum({OUT}), 0) as output_ms,
      coalesce(sum(case when {INP} is not null then coalesce(prompt_eval_tokens, prompt_tokens) end), 0) as input_tok,
      coalesce(sum({INP}), 0) as input_ms,
      coalesce(sum(case when duration_ms is not null then completion_tokens end), 0) as effective_tok,
      coalesce(sum(duration_ms), 0) as effective_ms
      from {rel} where {where} group by all"""


def _rollup_sql(bucket: int, where: str = "true") -> str:
    tps = ", ".join(TPS.format(r=r) for r in T.RATES)
    return f"""select bucket_start, t.service_id, s.name as service, request_count, prompt_tokens, completion_tokens,
      error_count, avg_duration_ms, avg_ttft_ms, {tps}
      from ({_sums_sql(f'timestamp_ms // {bucket} * {bucket} as bucket_start, service_id', where)}) t
      left join services s on s.service_id = t.service_id"""


def _weighted_sql(keys: str, rel: str) -> str:
    parts = []
    for src, name in [("avg_duration_ms", "duration"), *[(f"{r}_tps", r) for r in T.RATES]]:
        parts.append(f"coalesce(sum({src} * request_count), 0) as {name}_w")
        parts.append(f"coalesce(sum(case when {src} is not null then request_count end), 0) as {name}_n")
    return f"""select {keys} sum(request_count) as request_count, sum(prompt_tokens) as prompt_tokens,
      sum(completion_tokens) as completion_tokens, sum(error_count) as error_count, {', '.join(parts)}
      from {rel} {'group by all' if keys else ''}"""


RES = ", ".join(
    f"round({n}_w / nullif({n}_n, 0), 6) as {a}"
    for n, a in [("duration", "avg_duration_ms"), *[(r, f"{r}_tps") for r in T.RATES]]
)
CNT = "request_count, prompt_tokens, completion_tokens, error_count"


def _sql(names: str, body: str, **extra: str) -> str:
    return B.with_ctes(names.split(), body, extra)


NOW = "(select max(timestamp_ms) from rm)"
LOGKEY = "timestamp_ms desc, seq desc, run_id desc"


def devices(s, d) -> DataFrame:
    """One device per region-sized slot, sized from the customers on it."""
    return (
        B.table(s, d, "customer")
        .groupBy(F.col("c_nationkey").cast("long").alias("slot"))
        .agg((F.count(F.lit(1)) * 4096).alias("total_mib"), F.sum(F.expr("c_custkey % 4096")).alias("free_mib"))
    )


DEVICES_SQL = """select cast(c_nationkey as bigint) as slot, count(*) * 4096 as total_mib,
   sum(c_custkey % 4096)::bigint as free_mib from customer group by 1"""


def runs(s, d) -> DataFrame:
    """Runs per service with the stamp each was first seen at."""
    return B.request_metrics(s, d).groupBy("service_id", "run_id").agg(F.min("timestamp_ms").alias("spawned_at"))


RUNS_SQL = "select service_id, run_id, min(timestamp_ms) as spawned_at from rm group by all"


def feed(s, d) -> DataFrame:
    """The event feed: restarts, state changes and a few service-less reloads."""
    return B.table(s, d, "events").selectExpr(
        "case event_type when 'error' then 'auto_restarted' when 'signup' then 'config_reloaded' else 'state_changed' end as type",
        "case when event_type <> 'signup' then cast(user_id % 30 as string) end as service",
        f"cast({B.SPARK_MS.format('ts')} as bigint) as at_ms",
    )


FEED_SQL = f"""select case event_type when 'error' then 'auto_restarted' when 'signup' then 'config_reloaded' else 'state_changed' end as type,
   case when event_type <> 'signup' then cast(user_id % 30 as varchar) end as service, {B.ANSI_MS.format('ts')} as at_ms from events"""


def _series_grid(s, d):
    m, r = B.request_metrics(s, d), B.service_restarts(s, d)
    now = _latest(m)
    return T.error_restart_grid(m, r, now - 20 * DAY, now, 2 * HOUR)


def _gap_series(s, d):
    roll = _rollup(s, d, 6 * HOUR)
    points = roll.filter(F.col("service").isNotNull()).select(
        "service", F.expr("bucket_start div 1000").alias("ts"), F.col("request_count").cast("double").alias("value")
    )
    return T.zero_fill_gaps(points, "service", "ts", "value", 1_703_980_800, 1_706_745_600)


GAP_SQL = _sql(
    "rm services",
    """, p as (select s.name as service, timestamp_ms // 21600000 * 21600 as ts, count(*)::double as value
      from rm join services s using (service_id) group by all),
    d as (select *, lag(ts) over w as prev, lead(ts) over w as nxt from p window w as (partition by service order by ts)),
    l as (select service, coalesce(median(ts - prev) * 1.5, 900) as lim from d group by service),
    j as (select d.*, lim from d join l using (service))
    select service, ts, value from j
    union all select service, unnest([1703980800, ts - 1]), 0.0 from j where prev is null and ts - 1703980800 > lim
    union all select service, unnest([prev + 1, ts - 1]), 0.0 from j where ts - prev > lim
    union all select service, unnest([ts + 1, 1706745600]), 0.0 from j where nxt is null and 1706745600 - ts > lim""",
)


def _page_two(s, d):
    logs = B.service_logs(s, d)
    key = ["timestamp_ms", "seq", "run_id"]
    first = T.log_page(logs, 40).select(*[f"next_{c}" for c in key]).first()
    return T.log_page(logs, 40, before={c: first[f"next_{c}"] for c in key})


def _merge_tally(s, d):
    r = B.service_restarts(s, d)
    cut = _latest(r, "at_ms") - 10 * DAY
    stored = T.restart_tally(r.filter(F.col("at_ms") < cut))
    return T.merge_tally(stored, r.filter(F.col("at_ms") >= cut))


def _seed_union(s, d):
    logs = B.service_logs(s, d)
    seed = logs.filter(F.col("seq") <= 3)
    live = logs.filter(F.col("seq") >= 2).withColumn("line", F.concat(F.lit("live "), F.col("line")))
    return T.merge_log_seed(seed, live).select("service_id", "run_id", "seq", "timestamp_ms", F.md5("line").alias("line_md5"))


def _dated_retention(s, d):
    """Both dated tables appended, pruned at the newest row's cutoff and read back: rows per table and day."""
    out = None
    samples, metrics = B.device_samples(s, d), B.request_metrics(s, d)
    for name, df, append, read, keep in (
        ("samples", samples, stores.append_device_samples, stores.read_device_samples, T.SAMPLE_RETENTION_MS),
        ("metrics", metrics, stores.append_metrics, stores.read_metrics, T.METRIC_RETENTION_MS),
    ):
        path = scratch_path(s, f"dated-{name}")
        append(df, path)
        stores.prune_days(s, path, _latest(df) - keep)
        left = read(s, path).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ms").alias("oldest"))
        left = left.select(F.lit(name).alias("name"), "dt", "n", "oldest")
        out = left if out is None else out.unionByName(left)
    return out


def _with_now(fn):
    def run(s, d):
        m = B.request_metrics(s, d)
        return fn(s, d, m, _latest(m))

    return run


QUERIES = {
    "a1_request_rollup": lambda s, d: _rollup(s, d),
    "a2_throughput_tiers": lambda s, d: T.throughput_tiers(B.request_metrics(s, d), ["service_id"]),
    "a3_lifetime_counters": _with_now(lambda s, d, m, now: T.lifetime_counters(m, B.services(s, d), now)),
    "a4_recent_rate_gauges": _with_now(lambda s, d, m, now: T.recent_rate_gauges(m, B.services(s, d), now, 6 * HOUR, 6)),
    "a5_combined_buckets": lambda s, d: T.combine_services(_rollup(s, d), 6),
    "a6_service_series": lambda s, d: T.service_series(_rollup(s, d), 6),
    "a6b_request_sparkline": lambda s, d: T.request_sparkline(_rollup(s, d)),
    "a7_window_totals": lambda s, d: T.window_totals(_rollup(s, d), 6),
    "a8_run_error_rate": _with_now(lambda s, d, m, now: T.run_error_rate(m, now - 5 * DAY)),
    "a9_draft_acceptance": _with_now(lambda s, d, m, now: T.draft_acceptance(m, now - 5 * DAY)),
    "a10_restart_tally": _merge_tally,
    "a11_restart_counts": lambda s, d: T.restart_counts(T.restart_tally(B.service_restarts(s, d)), 7),
    "a12_device_bar": lambda s, d: T.device_bar(devices(s, d), B.reservations(s, d)),
    "a12_pledged_per_slot": lambda s, d: T.pledged_per_slot(B.reservations(s, d)),
    "f1_time_window": lambda s, d: T.in_window(
        B.request_metrics(s, d), "timestamp_ms", 1_704_500_000_000, 1_705_500_000_000, service_id=4
    ).select("metric_id", "timestamp_ms"),
    "f3_live_services": lambda s, d: T.live_services(B.services(s, d)),
    "f7_log_filters": lambda s, d: T.filter_logs(B.service_logs(s, d), 60_000, 900_000, None, "user").select("run_id", "seq"),
    "f8_log_search": lambda s, d: T.search_logs(B.service_logs(s, d), "TION", "assistant").select("run_id", "seq"),
    "f9_event_filter": lambda s, d: T.filter_events(feed(s, d), "4", ["auto_restarted", "config_reloaded"]),
    "j1_metrics_with_service": lambda s, d: T.with_service(B.request_metrics(s, d), B.services(s, d)).select(
        "metric_id", "service_id", "service"
    ),
    "j2_restarts_with_service": lambda s, d: T.restarts_with_service(B.service_restarts(s, d), B.services(s, d)),
    "j3_last_request_per_service": lambda s, d: T.last_request_per_service(B.request_metrics(s, d), B.services(s, d)),
    "j16_devices_with_reservations": lambda s, d: T.devices_with_reservations(devices(s, d), B.reservations(s, d)),
    "j17_error_restart_grid": _series_grid,
    "j18_log_seed_union": _seed_union,
    "w3_restart_history_cap": lambda s, d: T.cap_restart_history(B.service_restarts(s, d), 5).select("restart_id", "service_id"),
    "w4_log_retention": lambda s, d: T.trim_logs(
        B.service_logs(s, d), B.services(s, d), 7 * DAY + 300_000, 30
    ).select("service_id", "run_id", "seq", "timestamp_ms"),
    "w5_age_retention": _with_now(lambda s, d, m, now: T.age_report(m, "timestamp_ms", now, T.METRIC_RETENTION_MS)),
    "w5_sample_retention": lambda s, d: T.keep_recent(
        B.device_samples(s, d), "timestamp_ms", 1_706_000_000_000, T.SAMPLE_RETENTION_MS
    ).select("sample_id"),
    "w5_dated_retention": _dated_retention,
    "w21_gap_zero_fill": _gap_series,
    "w22_latest_run": lambda s, d: T.latest_run_per_service(runs(s, d)),
    "l1_log_page": lambda s, d: T.log_page(B.service_logs(s, d), 40).select(
        "service_id", "run_id", "seq", "timestamp_ms", "next_timestamp_ms", "next_seq", "next_run_id"
    ),
    "l1_log_page_two": lambda s, d: _page_two(s, d).select("service_id", "run_id", "seq", "timestamp_ms"),
    "l2_recent_lines": lambda s, d: T.recent_lines(B.service_logs(s, d), 2, 50).select("run_id", "seq", "timestamp_ms"),
    "l3_recent_restarts": lambda s, d: T.recent_restarts(B.service_restarts(s, d), 10),
    "l4_log_seed": lambda s, d: T.log_seed(B.service_logs(s, d), 2, 60).select("run_id", "seq", "truncated"),
    "s2_device_samples": lambda s, d: B.device_samples(s, d).withColumn("used_bytes", F.expr("total_bytes - free_bytes")),
    "u3_aligned_requests": lambda s, d: T.aligned_series(
        _rollup(s, d).filter(F.col("service").isin("NATION_0", "NATION_1")).select(
            F.expr("bucket_start div 1000").alias("ts"), "service", "request_count"
        ),
        "service", "request_count", ["NATION_0", "NATION_1"],
    ),
    "u3_device_memory": lambda s, d: T.memory_series(
        B.device_samples(s, d).withColumn("used_bytes", F.expr("total_bytes - free_bytes")), ["gpu:0", "gpu:1"], 12
    ),
    "x1_time_bucket": lambda s, d: B.request_metrics(s, d).groupBy(C.time_bucket("timestamp_ms", HOUR).alias("bucket")).count(),
}

_GAUGE = _sql(
    "rm services roll",
    f""", w as ({_weighted_sql('service_id,', 'roll')})
    select s.name as service, {', '.join(f'round(coalesce({r}_w / nullif({r}_n, 0), 0), 6) as {r}_tps' for r in T.RATES)}
    from services s left join w on w.service_id = s.service_id where s.deleted_at is null""",
    roll=_rollup_sql(6 * HOUR, f"timestamp_ms between {NOW} - {6 * HOUR} and {NOW}"),
)

ORACLE = {
    "a1_request_rollup": _sql("rm services", _rollup_sql(DAY)),
    "a2_throughput_tiers": _sql(
        "rm",
        f"select service_id, {', '.join(f'{r}_tok as {r}_tokens, {r}_ms, ' + TPS.format(r=r) for r in T.RATES)} from ({_sums_sql('service_id')})",
    ),
    "a3_lifetime_counters": _sql(
        "rm services",
        f""", c as (select service_id, count(*) r, sum(prompt_tokens) p, sum(completion_tokens) c from rm
          where timestamp_ms between {NOW} - {7 * DAY} and {NOW} group by 1)
        select name as service, unnest(['requests', 'prompt', 'completion']) as counter,
          unnest([coalesce(r, 0), coalesce(p, 0), coalesce(c, 0)])::bigint as value
        from services left join c using (service_id) where deleted_at is null""",
    ),
    "a4_recent_rate_gauges": _GAUGE,
    "a5_combined_buckets": _sql(
        "rm services roll",
        f"select ts, {CNT}, {RES} from ({_weighted_sql('bucket_start // 1000 as ts,', 'roll')})",
        roll=_rollup_sql(DAY),
    ),
    "a6_service_series": _sql(
        "rm services roll",
        f"""select service, sum(request_count) over (partition by service) as service_requests, ts, {CNT}, {RES}
        from ({_weighted_sql("coalesce(service, 'unknown') as service, bucket_start // 1000 as ts,", 'roll')})""",
        roll=_rollup_sql(DAY),
    ),
    "a6b_request_sparkline": _sql(
        "rm services",
        f"""select service, list(ts order by ts) as ts, list(n order by ts) as counts from (
          select coalesce(s.name, 'unknown') as service, timestamp_ms // {DAY} * {DAY // 1000} as ts, count(*) as n
          from rm left join services s using (service_id) group by 1, 2) group by service""",
    ),
    "a7_window_totals": _sql(
        "rm services roll",
        f"""select request_count as total_request_count, prompt_tokens as total_prompt_tokens,
          completion_tokens as total_completion_tokens, error_count as total_error_count,
          round(duration_w / greatest(1, duration_n), 6) as avg_latency_ms,
          {', '.join(f'round({r}_w / greatest(1, {r}_n), 6) as avg_{r}_tps' for r in T.RATES)},
          output_n > 0 or input_n > 0 as has_split_tps from ({_weighted_sql('', 'roll')})""",
        roll=_rollup_sql(DAY),
    ),
    "a8_run_error_rate": _sql(
        "rm",
        f"""select service_id, run_id, count(*) as total, sum(case when status_code >= 500 then 1 else 0 end) as errors
        from rm where timestamp_ms >= {NOW} - {5 * DAY} group by 1, 2""",
    ),
    "a9_draft_acceptance": _sql(
        "rm",
        f""", e as (select *, timestamp_ms + coalesce(duration_ms, 0) >= {NOW} - {5 * DAY} as w,
          coalesce(draft_tokens_accepted, 0) as acc from rm where draft_tokens > 0)
        select service_id, run_id, sum(case when w then 1 else 0 end) as window_drafting,
          sum(case when w then draft_tokens else 0 end) as window_drafted,
          sum(case when w then acc else 0 end) as window_accepted, sum(acc) as run_accepted from e group by 1, 2""",
    ),
    "a10_restart_tally": _sql("restarts", "select service_id, trigger_name, count(*) as count from restarts group by 1, 2"),
    "a11_restart_counts": _sql(
        "restarts", "select trigger_name, count(*) as count from restarts where service_id = 7 group by 1"
    ),
    "a12_device_bar": _sql(
        "resv dev",
        """select slot, used as used_mib, greatest(p - used, 0) as pledged_extra_mib,
          greatest(total_mib - used - greatest(p - used, 0), 0) as headroom_mib
        from (select slot, total_mib, total_mib - free_mib as used, coalesce(p, 0) as p from dev
          left join (select slot, sum(mib) as p from resv group by 1) using (slot))""",
        dev=DEVICES_SQL,
    ),
    "a12_pledged_per_slot": _sql("resv", "select slot, sum(mib) as pledged_mib from resv group by 1"),
    "f1_time_window": _sql(
        "rm",
        "select metric_id, timestamp_ms from rm where timestamp_ms between 1704500000000 and 1705500000000 and service_id = 4",
    ),
    "f3_live_services": _sql("services", "select * from services where deleted_at is null"),
    "f7_log_filters": _sql(
        "logs", "select run_id, seq from logs where timestamp_ms between 60000 and 900000 and stream = 'user'"
    ),
    "f8_log_search": _sql(
        "logs", "select run_id, seq from logs where stream = 'assistant' and contains(lower(line), 'tion')"
    ),
    "f9_event_filter": _sql(
        "feed",
        "select * from feed where coalesce(service = '4', true) and type in ('auto_restarted', 'config_reloaded')",
        feed=FEED_SQL,
    ),
    "j1_metrics_with_service": _sql(
        "rm services",
        "select metric_id, rm.service_id, name as service from rm left join services s on s.service_id = rm.service_id",
    ),
    "j2_restarts_with_service": _sql(
        "restarts services", "select r.*, name as service from restarts r join services s on s.service_id = r.service_id"
    ),
    "j3_last_request_per_service": _sql(
        "rm services",
        "select name, max(timestamp_ms) as last_used from services join rm using (service_id) where deleted_at is null group by 1",
    ),
    "j16_devices_with_reservations": _sql(
        "resv dev", "select dev.*, service, mib from dev left join resv on resv.slot = dev.slot", dev=DEVICES_SQL
    ),
    "j17_error_restart_grid": _sql(
        "rm restarts",
        f""", b as (select {NOW} - {20 * DAY} as lo, {NOW} as hi), f as (select lo // 7200000 * 7200000 as f, lo, hi from b),
        g as (select unnest(generate_series(f, f + (greatest(1, ((hi - f + 7199999) // 7200000)) - 1) * 7200000, 7200000)) as bin from f),
        e as (select timestamp_ms // 7200000 * 7200000 as bin, count(*) as n from rm, b
          where timestamp_ms between lo and hi and status_code >= 400 group by 1),
        r as (select at_ms // 7200000 * 7200000 as bin, count(*) as n from restarts, b where at_ms between lo and hi group by 1)
        select g.bin // 1000 as ts, coalesce(e.n, 0) as errors, coalesce(r.n, 0) as restarts
        from g left join e on e.bin = g.bin left join r on r.bin = g.bin""",
    ),
    "j18_log_seed_union": _sql(
        "logs",
        """select service_id, run_id, seq, max(timestamp_ms) as timestamp_ms,
          md5(case when seq >= 2 then 'live ' || any_value(line) else any_value(line) end) as line_md5
        from logs group by 1, 2, 3""",
    ),
    "w3_restart_history_cap": _sql(
        "restarts",
        """select restart_id, service_id from restarts
        qualify row_number() over (partition by service_id order by at_ms desc, restart_id desc) <= 5""",
    ),
    "w4_log_retention": _sql(
        "logs services",
        """, kept as (select * from logs where timestamp_ms >= 300000),
        n as (select k.*, row_number() over (partition by k.service_id order by timestamp_ms desc, seq desc) as rn
          from kept k semi join (select * from services where deleted_at is null) using (service_id)),
        c as (select service_id, timestamp_ms as t, seq as q from n where rn = 31)
        select k.service_id, run_id, seq, timestamp_ms from kept k left join c using (service_id)
        where t is null or timestamp_ms > t or (timestamp_ms = t and seq > q)""",
    ),
    "w5_age_retention": _sql(
        "rm",
        f"select sum(case when timestamp_ms < {NOW} - {7 * DAY} then 1 else 0 end) as removed, sum(case when timestamp_ms < {NOW} - {7 * DAY} then 0 else 1 end) as kept from rm",
    ),
    "w5_dated_retention": _sql(
        "samples rm",
        f"""select 'samples' as name, cast(cast(make_timestamp(timestamp_ms * 1000) as date) as varchar) as dt, count(*) as n, min(timestamp_ms) as oldest from samples
        where timestamp_ms >= (select max(timestamp_ms) from samples) - {T.SAMPLE_RETENTION_MS} group by 2
        union all select 'metrics', cast(cast(make_timestamp(timestamp_ms * 1000) as date) as varchar), count(*), min(timestamp_ms) from rm
        where timestamp_ms >= (select max(timestamp_ms) from rm) - {T.METRIC_RETENTION_MS} group by 2""",
    ),
    "w5_sample_retention": _sql("samples", f"select sample_id from samples where timestamp_ms >= {1_706_000_000_000 - DAY}"),
    "w21_gap_zero_fill": GAP_SQL,
    "w22_latest_run": _sql(
        "rm runs",
        "select * from runs qualify row_number() over (partition by service_id order by spawned_at desc, run_id desc) = 1",
        runs=RUNS_SQL,
    ),
    "l1_log_page": _sql(
        "logs",
        f""", p as (select *, row_number() over (order by {LOGKEY}) as rn from logs), l as (select * from p where rn = 40)
        select p.service_id, p.run_id, p.seq, p.timestamp_ms, l.timestamp_ms as next_timestamp_ms, l.seq as next_seq, l.run_id as next_run_id
        from p, l where p.rn <= 40""",
    ),
    "l1_log_page_two": _sql(
        "logs", f"select service_id, run_id, seq, timestamp_ms from logs order by {LOGKEY} limit 40 offset 40"
    ),
    "l2_recent_lines": _sql(
        "logs", f"select run_id, seq, timestamp_ms from logs where service_id = 2 order by {LOGKEY} limit 50"
    ),
    "l3_recent_restarts": _sql("restarts", "select * from restarts order by at_ms desc, restart_id desc limit 10"),
    "l4_log_seed": _sql(
        "logs", f"select run_id, seq, (select count(*) from logs) > 120 as truncated from logs order by {LOGKEY} limit 120"
    ),
    "s2_device_samples": _sql("samples", "select * from samples"),
    "u3_aligned_requests": _sql(
        "rm services",
        f"""select timestamp_ms // {DAY} * {DAY // 1000} as ts, nullif(sum(case when name = 'NATION_0' then 1 else 0 end), 0) as "NATION_0",
          nullif(sum(case when name = 'NATION_1' then 1 else 0 end), 0) as "NATION_1"
        from rm join services using (service_id) where name in ('NATION_0', 'NATION_1') group by 1""",
    ),
    "u3_device_memory": _sql(
        "samples",
        """, l as (select *, timestamp_ms // 1000 as ts from samples
          qualify row_number() over (partition by device, timestamp_ms // 1000 order by timestamp_ms desc, sample_id desc) = 1)
        select ts, max(case when device = 'gpu:0' then round(used_bytes / 1e9::double, 12) end) as "gpu:0",
          max(case when device = 'gpu:1' then round(used_bytes / 1e9::double, 12) end) as "gpu:1" from l group by 1""",
    ),
    "x1_time_bucket": _sql("rm", f"select timestamp_ms // {HOUR} * {HOUR} as bucket, count(*) as count from rm group by 1"),
}
