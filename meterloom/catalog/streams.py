"""Registered streaming queries: the driver's tables as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.catalog import sequences as Q
from meterloom.catalog import telemetry as TQ
from meterloom.session import scratch_path
from meterloom.sources import bindings as B
from meterloom.sources import stores
from meterloom.streaming import sinks
from meterloom.streaming import telemetry as ST
from meterloom.streaming.carried import run_carried
from meterloom.streaming.keyed import run_to_table


UPTIME, DEADLINE, MARGIN = 432_000_000, 7_200_000, 1 << 28


def _stream(s, d, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them (a stream takes a single file only by a pattern)."""
    return s.readStream.schema(B.table(s, d, name).schema).parquet(f"{d}/{{{name}.parquet}}")


def _metrics(s, d):
    return _stream(s, d, "events").selectExpr(*B._request_metrics(B.SPARK_MS, B.SPARK_K))


def _rows(s, d, exprs):
    return _stream(s, d, "events").selectExpr(*exprs(Q.MS_SPARK, B.SPARK_K))


def _rollup(s, d):
    return ST.finish_rollup(run_to_table(ST.rollup_stream(_metrics(s, d), TQ.DAY, "1 day"), "rollup", "update"), B.services(s, d))


def _alerts(s, d):
    counts = ST.error_rate_counts(_metrics(s, d), min_status=400, window_ms=14_400_000, poll_ms=3_600_000, delay="1 day")
    runs = B.request_metrics(s, d).groupBy("service_id", "run_id").agg(F.min("timestamp_ms").alias("spawned_at"))
    return ST.finish_alerts(run_to_table(counts, "alerts", "update"), runs, min_requests=6, max_rate=0.5, min_uptime_ms=UPTIME)


def _first_output(s, d):
    t = F.col("turn")
    events = _stream(s, d, "conversations").select(
        (F.col("conv_id") % 7).alias("service"), F.when(t == 0, "open").when(F.col("conv_id") % 3 == 0, "tick").otherwise("frame").alias("kind"),
        F.col("conv_id").alias("request"), F.col("conv_id").alias("run_id"), (F.col("conv_id") * 20_000 + t * 70_000 + 1_000_000).alias("at_ms"),
    )
    return run_to_table(ST.first_output_stalls(events, delay="601 seconds"), "first-output")


def _decisions(s, d):
    events = _stream(s, d, "events").selectExpr(
        "user_id % 30 as service", "case event_type when 'signup' then 'spawn' when 'error' then 'firing' else 'request' end as kind", "'error_rate' as trigger",
        "cast(floor(value / 20) as bigint) as inflight", f"cast({Q.MS_SPARK} as bigint) div 12 as at_ms",
    )
    return run_to_table(ST.restart_decisions(events, DEADLINE), "decisions")


def _memory(s, d):
    rows = _rows(s, d, Q._memory).select(
        "service", "at_ms", "sample_id", "slot", F.col("vram_bytes").alias("observed"), F.col("slot").isNotNull().alias("enforceable"),
        F.lit(Q.MIN_MIB).cast("long").alias("min_mib"), F.lit(Q.MAX_MIB).cast("long").alias("max_mib"),
    )
    return run_carried(rows, ST.memory(MARGIN), "memory")


def _correction(s, d):
    out = run_carried(_rows(s, d, Q._correction), ST.correction(width=64), "correction")
    return out.select("service", "pool", "seq", F.round("mean", 9).alias("mean"), "samples")


def _logs(s, d):
    lines = _stream(s, d, "conversations").selectExpr(*B.SERVICE_LOGS).drop("seq")
    out = run_carried(lines, ST.log_numbers(), "log-stream")
    return out.select("service_id", "run_id", "timestamp_ms", "seq", F.md5("line").alias("line_md5"))


def _in_batches(s, df: DataFrame, by: str, label: str, parts: int = 3) -> DataFrame:
    """A table as a stream of several micro-batches, one file each."""
    path = scratch_path(s, label)
    df.repartition(parts, F.pmod(F.xxhash64(by), F.lit(parts))).sortWithinPartitions(by).write.parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _twice(save):
    """Every batch is saved, and saved once more, as after a lost executor."""

    def run(batch: DataFrame, batch_id: int) -> None:
        save(batch, batch_id)
        save(batch, batch_id)

    return run


def _appended(s, d):
    path = scratch_path(s, "metrics")
    stream = _in_batches(s, B.request_metrics(s, d), "metric_id", "metrics-in")
    sinks.drain(stream, _twice(lambda batch, n: sinks.save_metrics(batch, n, path)), scratch_path(s, "metrics-checkpoint"))
    rows = sinks.read_appended_metrics(s, path)
    return rows.groupBy(F.col("dt").cast("string").alias("dt"), "service_id").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration"), F.sum("prompt_tokens").alias("prompt_tokens"))


def _tally(s, d):
    """The tally after the last batch, beside what the capped history still holds."""
    base, history = scratch_path(s, "tally"), scratch_path(s, "history")
    seen = []

    def save(batch: DataFrame, batch_id: int) -> None:
        sinks.save_tally(batch, batch_id, base)
        sinks.save_history(batch, batch_id, history, 5)
        seen.append(batch_id)

    stream = _in_batches(s, B.service_restarts(s, d), "restart_id", "restarts-in")
    sinks.drain(stream, _twice(save), scratch_path(s, "tally-checkpoint"))
    left = s.read.schema(stream.schema).parquet(f"{history}/batch_id={seen[-1]}")
    left = left.groupBy("service_id", "trigger_name").agg(F.count(F.lit(1)).alias("in_history"))
    return sinks.read_tally(s, base, seen[-1]).join(left, ["service_id", "trigger_name"], "left").fillna(0, ["in_history"])


def _log_union(s, d):
    logs = B.service_logs(s, d)
    seed = logs.filter(F.col("seq") <= 3).withColumn("live", F.lit(False))
    live = logs.filter(F.col("seq") >= 2).withColumns({"line": F.concat(F.lit("live "), F.col("line")), "live": F.lit(True)})
    both = seed.unionByName(live).select("service_id", "run_id", "seq", "timestamp_ms", "line", "live")
    rows = run_carried(_in_batches(s, both, "line", "log-union-in"), sinks.log_union(10**12), "log-union")
    return sinks.current_lines(rows).select("service_id", "run_id", "seq", "timestamp_ms", F.md5("line").alias("line_md5"))


def _feed(s, d):
    feed = _stream(s, d, "events").selectExpr(
        "case event_type when 'error' then 'auto_restarted' when 'signup' then 'config_reloaded' else 'state_changed' end as type",
        "case when event_type <> 'signup' then cast(user_id % 30 as string) end as service", f"cast({Q.MS_SPARK} as bigint) as at_ms",
    )
    return ST.recent_events(run_to_table(ST.feed_stream(feed, "4", ["auto_restarted", "config_reloaded"]), "feed"), 100)


def _source(s, d):
    """The feed as JSON lines, read back as a stream of one wide row type."""
    path = scratch_path(s, "feed-json")
    TQ.feed(s, d).select(F.to_json(F.struct("type", "service", "at_ms")).alias("value")).write.text(path)
    table = run_to_table(stores.read_event_feed(s, path), "feed-source")
    return table.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("service").alias("with_service"), F.max("at_ms").alias("newest"))


QUERIES = {
    "s1_stream_append": _appended,
    "a10_stream_tally": _tally,
    "j18_stream_log_union": _log_union,
    "s10_event_feed_source": _source,
    "t1_stream_rollup": _rollup,
    "t2_error_rate_alerts": _alerts,
    "t3_draft_collapse": lambda s, d: run_carried(ST.draft_ticks(_metrics(s, d), "1 hour", "6 hours"), ST.draft_collapse(86_400_000, 200), "collapse"),
    "t4_first_output_stalls": _first_output,
    "t5_counter_stalls": lambda s, d: run_carried(_rows(s, d, Q._polls), ST.counter_stalls(7_200_000), "stalls").select("service", "poll_id", "flat_ms", "stalled"),
    "t6_restart_decisions": _decisions,
    "t7_memory": _memory,
    "t8_rolling_correction": _correction,
    "t9_log_sequences": _logs,
    "t10_event_feed": _feed,
}

ORACLE = {
    "s1_stream_append": B.with_ctes(["rm"], "select cast(cast(make_timestamp(timestamp_ms * 1000) as date) as varchar) as dt, service_id, count(*) as n, sum(duration_ms) as duration, sum(prompt_tokens) as prompt_tokens from rm group by 1, 2"),
    "a10_stream_tally": B.with_ctes(
        ["restarts"],
        """, h as (select service_id, trigger_name, count(*) as in_history from (select * from restarts qualify row_number() over (partition by service_id order by at_ms desc, restart_id desc) <= 5) group by 1, 2)
        select service_id, trigger_name, count(*) as count, coalesce(any_value(in_history), 0) as in_history from restarts left join h using (service_id, trigger_name) group by 1, 2""",
    ),
    "j18_stream_log_union": TQ.ORACLE["j18_log_seed_union"],
    "s10_event_feed_source": f"with feed as ({TQ.FEED_SQL}) select type, count(*) as n, count(service) as with_service, max(at_ms) as newest from feed group by 1",
    "t1_stream_rollup": TQ.ORACLE["a1_request_rollup"],
    "t2_error_rate_alerts": B.with_ctes(
        ["rm"],
        f""", r as (select service_id, run_id, min(timestamp_ms) as spawned_at from rm group by 1, 2),
        w as (select *, unnest(generate_series(timestamp_ms // 3600000 * 3600000 + 3600000, timestamp_ms // 3600000 * 3600000 + 14400000, 3600000)) as poll_ms from rm),
        c as (select service_id, run_id, poll_ms, count(*) as total, sum(case when status_code >= 400 then 1 else 0 end) as errors from w group by 1, 2, 3)
        select c.* from c join r using (service_id, run_id) where total >= 6 and errors / total >= 0.5 and poll_ms - spawned_at >= {UPTIME}""",
    ),
    "t3_draft_collapse": B.with_ctes(
        ["rm"],
        """, done as (select *, timestamp_ms + coalesce(duration_ms, 0) as done_at from rm),
        t as (select service_id, run_id, done_at // 21600000 * 21600000 + 21600000 as at_ms, sum(draft_tokens) as drafted, sum(coalesce(draft_tokens_accepted, 0)) as accepted from done where draft_tokens > 0 group by 1, 2, 3),
        w as (select *, sum(drafted) over k as window_drafted, sum(accepted) over k as window_accepted, max(accepted) over (partition by service_id, run_id order by at_ms) > 0 as ever
            from t window k as (partition by service_id, run_id order by at_ms range between 86399999 preceding and current row))
        select service_id, run_id, at_ms, window_drafted, window_accepted, window_drafted >= 200 and window_accepted = 0 and ever as collapsed from w
        where at_ms <= (select max(done_at) from done where draft_tokens > 0) - 3600000""",
    ),
    "t4_first_output_stalls": """
        with e as (select conv_id % 7 as service, case when turn = 0 then 'open' when conv_id % 3 = 0 then 'tick' else 'frame' end as kind, conv_id, conv_id * 20000 + turn * 70000 + 1000000 as at_ms from conversations),
        o as (select *, at_ms + 60000 as due from e where kind = 'open'),
        k as (select service, min(at_ms) as first, max(at_ms) as last from e group by 1),
        f as (select o.service, o.conv_id, o.due, max(e.at_ms) as seen, max(case when e.conv_id = o.conv_id then 1 else 0 end) as answered
            from o left join e on e.service = o.service and e.kind = 'frame' and e.at_ms < o.due group by 1, 2, 3)
        select service, conv_id::varchar as request, conv_id as run_id, due as at_ms from f join k using (service)
        where answered = 0 and due - coalesce(seen, first) >= 60000 and (due <= last or due <= (select max(at_ms) - 601000 from e))
    """,
    # Firings go through the same greedy budget as the batch query; a spawn's age limit ends with the next spawn or firing.
    "t6_restart_decisions": f"""
        with recursive e as (select user_id % 30 as service, case event_type when 'signup' then 'spawn' when 'error' then 'firing' else 'request' end as kind, {Q.MS_ANSI} // 12 as t, cast(floor(value / 20) as bigint) as inflight from events),
        p as (select service, t, row_number() over (partition by service order by t) - 1 as step_no from e where kind = 'firing'),
        r as (select service, (-1)::bigint as step_no, []::bigint[] as hist, 0::bigint as at_ms, '' as outcome from (select distinct service from p)
          union all select service, step_no, case when len(kept) >= 3 then kept else list_append(kept, t) end, t, case when len(kept) >= 3 then 'disabled' else 'restarted' end from (
            select p.service, p.step_no, p.t, [h for h in r.hist if p.t - h < 1800000] as kept from r join p on p.service = r.service and p.step_no = r.step_no + 1)),
        k as (select service, max(t) as last from e group by 1),
        s as (select service, t + {DEADLINE} as due, lead(t) over (partition by service order by t, kind) as ended, kind from e where kind <> 'request')
        select service, at_ms, 'error_rate' as trigger, outcome from r where step_no >= 0
        union all select service, due, 'periodic', 'restarted' from s join k using (service)
        where kind = 'spawn' and (ended is null or ended >= due) and (due <= last or due <= (select max(t) - 600000 from e))
    """,
    "t5_counter_stalls": Q.ORACLE["w19_counter_stalls"],
    # One row of every service at a time: window, pledge held and ceiling state travel along.
    "t7_memory": f"""
        with recursive p as (select user_id % 30 as service, {Q.MS_ANSI} as at_ms, event_id as sample_id, case when event_id % 97 < 40 then 'gpu:0' when event_id % 97 < 80 then 'gpu:1' end as slot,
            cast(floor(60 * value) as bigint) * 1048576 as seen, row_number() over (partition by user_id % 30 order by {Q.MS_ANSI}, event_id) - 1 as step_no from events),
        r as (select distinct service, (-1)::bigint as step_no, 0::bigint as at_ms, 0::bigint as sample_id, null::varchar as slot, []::bigint[] as win, null::bigint as held, null::bigint as since, 0::bigint as pledge, false as emitted, '' as action from p
          union all
          select service, step_no, at_ms, sample_id, slot, case when action = 'kill' then []::bigint[] else win end, case when emitted then pledge else held end,
            case action when 'arm' then at_ms when 'wait' then since end, pledge, emitted, action
          from (select *, held is null or (least(held, pledge) <= {Q.MIN_MIB} and {Q.MIN_MIB} < greatest(held, pledge)) or abs(pledge - held) >= greatest(256, held * 50 // 1000) as emitted,
              case when slot is null or seen <= {Q.MAX_MIB} * 1048576::bigint * 1100 // 1000 then 'disarm' when since is null then 'arm' when at_ms - since > 30000 then 'kill' else 'wait' end as action
            from (select *, least(greatest(list_max(win) // 1048576, {Q.MIN_MIB}), {Q.MAX_MIB})::bigint as pledge
              from (select p.service, p.step_no, p.at_ms, p.sample_id, p.slot, p.seen, r.held, case when p.slot is distinct from r.slot then null else r.since end as since,
                  list_append(case when p.slot is distinct from r.slot then []::bigint[] else r.win[-5:] end, p.seen) as win
                from r join p on p.service = r.service and p.step_no = r.step_no + 1)))),
        g as (select *, len(win) as n, list_sum([(i - 1) * win[i] for i in range(1, len(win) + 1)]) as sxy, list_sum(win) as sy, len([i for i in range(1, len(win)) if win[i + 1] >= win[i]]) as up from r where step_no >= 0),
        k as (select *, (n * sxy - n * (n - 1) // 2 * sy) as top, n * ((n - 1) * n * (2 * n - 1) // 6) - (n * (n - 1) // 2) * (n * (n - 1) // 2) as under from g)
        select service, at_ms, sample_id, pledge as pledge_mib, held as held_mib, emitted, action,
          action <> 'kill' and n >= 4 and coalesce(top > 0 and top // nullif(under, 0) > 0 and up * 2 > n - 1 and win[-1] + top // nullif(under, 0) > {Q.MIN_MIB} * 1048576::bigint + {MARGIN}, false) as growing from k
    """,
    "t8_rolling_correction": Q.ORACLE["w6_rolling_correction"],
    "t9_log_sequences": "with logs as (" + B.ansi_ctes()["logs"] + ") select service_id, run_id, timestamp_ms, row_number() over (partition by service_id, run_id order by timestamp_ms, stream, line) - 1 as seq, md5(line) as line_md5 from logs",
    "t10_event_feed": f"with feed as ({TQ.FEED_SQL}) select * from feed where coalesce(service = '4', true) and type in ('auto_restarted', 'config_reloaded') order by at_ms desc, type, service limit 100",
}
