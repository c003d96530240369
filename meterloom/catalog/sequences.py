"""Registered ordered-sequence queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.functions import scan
from meterloom.operators import sequences as S
from meterloom.sources import bindings as B

MS_SPARK, MS_ANSI = B.SPARK_MS.format("ts"), B.ANSI_MS.format("ts")


def _correction(ms: str, k: str) -> list[str]:
    return [
        "user_id % 30 as service",
        "case when event_id % 2 = 0 then 'vram' else 'host' end as pool",
        "event_id as seq",
        "case when event_type = 'error' and value > 40 then 'oom' when event_type = 'signup' then 'clean' else 'sample' end as kind",
        "cast(floor(100 * value) as bigint) as observed",
        f"100 * {k} as base",
    ]


def _memory(ms: str, k: str) -> list[str]:
    return [
        "user_id % 30 as service",
        "user_id % 3 as run_id",
        f"cast({ms} as bigint) as at_ms",
        "event_id as sample_id",
        "case when event_id % 97 < 40 then 'gpu:0' when event_id % 97 < 80 then 'gpu:1' end as slot",
        "cast(floor(60 * value) as bigint) * 1048576 as vram_bytes",
        f"{k} * 10485760 as rss_total",
        f"{k} * 8388608 as rss_owned",
        f"{k} * 2097152 as rss_file",
    ]


def _polls(ms: str, k: str) -> list[str]:
    return [
        "user_id % 30 as service",
        f"cast({ms} as bigint) as at_ms",
        "event_id as poll_id",
        f"case when event_type <> 'signup' then cast(floor({k} / 45) as bigint) end as progress",
        "cast(floor(value / 6) as bigint) as inflight",
    ]


def _rows(exprs):
    return lambda s, d: B.table(s, d, "events").selectExpr(*exprs(MS_SPARK, B.SPARK_K))


correction_events, memory_samples, polls = _rows(_correction), _rows(_memory), _rows(_polls)

CTES = {
    name: "select " + ", ".join(f(MS_ANSI, B.ANSI_K)) + " from events"
    for name, f in [("ce", _correction), ("mem", _memory), ("polls", _polls)]
}
ORDER = ["at_ms", "sample_id"]
MIN_MIB, MAX_MIB = 512, 2560


def _windows(s, d):
    return S.sample_windows(memory_samples(s, d), ["service"], ORDER, "vram_bytes")


def _pledged(s, d):
    rows = _windows(s, d)
    pledge = S.window_pledge(F.col("window"), F.lit(MIN_MIB), F.lit(MAX_MIB))
    rows = rows.select("service", *ORDER, pledge.alias("pledge_mib"), F.lit(MIN_MIB).alias("min_mib"))
    return S.numbered(rows, ["service"], ORDER)


def _pledge_updates(s, d):
    return S.pledge_updates(_pledged(s, d), ["service"])


def _ceiling(s, d):
    rows = memory_samples(s, d).select(
        "service", *ORDER, "slot", (F.col("slot").isNotNull()).alias("enforceable"), F.col("vram_bytes").alias("observed"),
        S.ceiling_bytes(F.lit(1024)).alias("ceiling"),
    )
    # One clock tick per reading: the table's events are hours apart.
    rows = S.numbered(rows, ["service"], ORDER).withColumn("at_ms", F.col("step_no") * 8000)
    return S.ceiling_actions(rows, ["service"]).select("service", "step_no", "action")


def _budget(s, d):
    rows = B.table(s, d, "events").filter("event_type = 'error'").selectExpr(
        "user_id % 30 as service", f"cast({MS_SPARK} as bigint) as at_ms", "event_id"
    )
    rows = S.numbered(rows, ["service"], ["at_ms", "event_id"]).withColumn("at_ms", F.expr("at_ms div 24"))
    return S.restart_budget(rows, ["service"])


def _correct(s, d):
    out = S.rolling_correction(correction_events(s, d), width=64)
    return out.withColumn("mean", F.round("mean", 9)).withColumn("factor", F.round("factor", 9))


def _latch(s, d):
    ticks = B.request_metrics(s, d).select(
        "service_id", F.col("timestamp_ms").alias("at_ms"),
        F.coalesce(F.when(F.col("prompt_tokens") > 90, F.col("draft_tokens_accepted")), F.lit(0)).alias("run_accepted"),
    ).groupBy("service_id", "at_ms").agg(F.max("run_accepted").alias("run_accepted"))
    return S.acceptance_latch(ticks, ["service_id"])


def _stalls(s, d):
    return S.counter_stalls(polls(s, d), ["service"], 7_200_000)


QUERIES = {
    "w6_rolling_correction": lambda s, d: _correct(s, d).select("service", "pool", "seq", "mean", "samples"),
    "w7_trust_gate": lambda s, d: _correct(s, d).groupBy("service", "pool").agg(F.max_by("factor", "seq").alias("factor")),
    "w8_w9_drift_flags": lambda s, d: _correct(s, d).select(
        "service", "pool", "seq", "drift_samples", "drift_alert", "drift_event", "class"
    ),
    "w10_oom_episodes": lambda s, d: _correct(s, d).filter("kind <> 'sample'").select("service", "pool", "seq", "kind", "mean", "samples"),
    "w11_sample_admission": lambda s, d: S.admit_samples(
        memory_samples(s, d).select(
            "service", F.col("sample_id").alias("seq"), F.expr("sample_id % 5 <> 0").alias("became_ready"),
            F.col("vram_bytes").alias("peak_vram_bytes"), F.col("rss_owned").alias("peak_owned_bytes"),
            F.col("rss_file").alias("peak_file_bytes"), F.expr("run_id * 104857600").alias("cpu_weight_bytes"),
            F.expr("2 * vram_bytes").alias("vram_bytes"), F.expr("rss_total").alias("host_bytes"),
        )
    ),
    "w12_running_peaks": lambda s, d: S.running_peaks(memory_samples(s, d), ["service", "run_id"], ORDER).select(
        "service", "run_id", "sample_id", "peak_bytes", "peak_vram_bytes", "peak_rss_bytes", "peak_owned_bytes", "peak_file_bytes"
    ),
    "w13_sample_windows": lambda s, d: _windows(s, d).select("service", "sample_id", "window"),
    "w14_growth": lambda s, d: _windows(s, d).select(
        "service", "sample_id", S.growth(F.col("window"), F.lit(2 * 1024**3)).alias("growing")
    ),
    "w15_window_pledge": lambda s, d: _windows(s, d).select(
        "service", "sample_id", S.window_pledge(F.col("window"), F.lit(MIN_MIB), F.lit(MAX_MIB)).alias("pledge_mib")
    ),
    "w16_pledge_updates": _pledge_updates,
    "w17_ceiling_actions": _ceiling,
    "w18_restart_budget": _budget,
    "w19_counter_stalls": lambda s, d: _stalls(s, d).select("service", "poll_id", "flat_ms", "stalled"),
    "w23_acceptance_latch": lambda s, d: _latch(s, d).select("service_id", "at_ms", "ever_accepted"),
}

FOLD = """, r0 as (select *, row_number() over (partition by service, pool order by seq) as rn from (
    select *, case when kind = 'sample' then observed::double / nullif(base, 0) end as ratio from ce)
    where kind <> 'sample' or ratio is not null),
  r as (
    select service, pool, 0::bigint as rn, null::bigint as seq, ''::varchar as kind, 1.0::double as mean, 0::bigint as n, 0::bigint as drift,
      null::double as bm, null::bigint as bn, null::bigint as bd, 1.0::double as prev from (select distinct service, pool from r0)
    union all
    select service, pool, rn, seq, kind, mean, n,
      case when kind <> 'sample' then drift when abs(mean - 1) > 0.3 then drift + 1 else 0 end, bm, bn, bd, prev from (
      select x.service, x.pool, x.rn, x.seq, x.kind,
        case x.kind when 'oom' then greatest(r.mean, 1.4) when 'clean' then coalesce(r.bm, r.mean)
          else least(greatest((r.mean * r.n + x.ratio) / (r.n + 1), 0.8), 1.5) end as mean,
        case x.kind when 'oom' then greatest(r.n, 3) when 'clean' then coalesce(r.bn, r.n) else r.n + 1 end as n,
        case x.kind when 'clean' then coalesce(r.bd, r.drift) else r.drift end as drift,
        case x.kind when 'oom' then coalesce(r.bm, r.mean) when 'sample' then r.bm end as bm,
        case x.kind when 'oom' then coalesce(r.bn, r.n) when 'sample' then r.bn end as bn,
        case x.kind when 'oom' then coalesce(r.bd, r.drift) when 'sample' then r.bd end as bd, r.mean as prev
      from r join r0 x on x.service = r.service and x.pool = r.pool and x.rn = r.rn + 1)
  ) """


def _sql(name: str, body: str, recursive: bool = False) -> str:
    text = f"with {'recursive ' if recursive else ''}{name} as ({CTES[name]}) {body}"
    return text


W = "window w as (partition by service order by at_ms, sample_id)"
WIN = f""", c as (select *, case when row_number() over w > 1 and slot is distinct from lag(slot) over w then 1 else 0 end as ch from mem {W}),
  g as (select *, sum(ch) over (partition by service order by at_ms, sample_id) as seg from c),
  win as (select service, at_ms, sample_id, list(vram_bytes) over (partition by service, seg order by at_ms, sample_id rows between 5 preceding and current row) as win from g) """
PLEDGE = f"least(greatest(list_max(win) // 1048576, {MIN_MIB}), {MAX_MIB})"

ORACLE = {
    "w6_rolling_correction": _sql(
        "ce", FOLD + "select service, pool, seq, round(mean, 9) as mean, n as samples from r where rn > 0", True
    ),
    "w7_trust_gate": _sql(
        "ce",
        FOLD + """select service, pool, round(arg_max(case when n >= 3 then mean else 1.0 end, seq), 9) as factor
        from r where rn > 0 group by 1, 2""",
        True,
    ),
    "w8_w9_drift_flags": _sql(
        "ce",
        FOLD + """select service, pool, seq, drift as drift_samples, kind = 'sample' and drift >= 5 as drift_alert,
        kind = 'sample' and abs((mean - prev) / prev) > 0.05 as drift_event,
        case when mean > 1.2 then 'under-estimate' when mean < 0.85 then 'over-reservation' else 'steady' end as class from r where rn > 0""",
        True,
    ),
    "w10_oom_episodes": _sql(
        "ce",
        FOLD + "select service, pool, seq, kind, round(mean, 9) as mean, n as samples from r where rn > 0 and kind <> 'sample'",
        True,
    ),
    "w11_sample_admission": _sql(
        "mem",
        """, x as (select service, sample_id as seq, vram_bytes as pv, rss_owned as po, rss_file as pf, run_id * 104857600 as w,
          2 * vram_bytes as vb, rss_total as hb from mem where sample_id % 5 <> 0)
        select service, seq, 'vram' as pool, pv as observed, vb as base from x where pv > 0
        union all select * from (select service, seq, 'host' as pool,
          case when w > 0 and pf < w // 2 then greatest(po - w, 0) else po end as observed, greatest(hb - w, 0) as base from x) where observed > 0""",
    ),
    "w12_running_peaks": _sql(
        "mem",
        """select service, run_id, sample_id, max(vram_bytes + rss_total) over w as peak_bytes, max(vram_bytes) over w as peak_vram_bytes,
          max(rss_total) over w as peak_rss_bytes, max(rss_owned) over w as peak_owned_bytes, max(rss_file) over w as peak_file_bytes
        from mem window w as (partition by service, run_id order by at_ms, sample_id rows unbounded preceding)""",
    ),
    "w13_sample_windows": _sql("mem", WIN + 'select service, sample_id, win as "window" from win'),
    "w14_growth": _sql(
        "mem",
        WIN + """, e as (select *, len(win) as n, unnest(win) as y, generate_subscripts(win, 1) - 1 as x from win),
        a as (select service, sample_id, any_value(n) as n, any_value(win) as win, sum(x)::hugeint as sx, sum(y)::hugeint as sy, sum(x * y)::hugeint as sxy, sum(x * x)::hugeint as sxx from e group by 1, 2),
        b as (select *, case when n > 1 then trunc((n * sxy - sx * sy)::double / (n * sxx - sx * sx)) end as slope,
          len(list_filter(generate_series(2, n), lambda i: win[i] >= win[i - 1])) as up from a)
        select service, sample_id, case when n < 4 then false else slope > 0 and up * 2 > n - 1 and win[n] + slope > 2147483648 end as growing from b""",
    ),
    "w15_window_pledge": _sql("mem", WIN + f"select service, sample_id, {PLEDGE} as pledge_mib from win"),
    "w16_pledge_updates": _sql(
        "mem",
        WIN + f""", p as (select service, row_number() over (partition by service order by at_ms, sample_id) - 1 as step_no, {PLEDGE} as x from win),
        r as (select service, step_no, true as emitted, x as held_mib from p where step_no = 0
          union all select service, step_no, e, case when e then x else h end from (
            select p.service, p.step_no, x, r.held_mib as h,
              case when r.held_mib = x then false when (r.held_mib > {MIN_MIB}) <> (x > {MIN_MIB}) then true
                else abs(r.held_mib - x) >= greatest(r.held_mib * 50 // 1000, 256) end as e
            from r join p on p.service = r.service and p.step_no = r.step_no + 1))
        select service, step_no, emitted, held_mib from r""",
        True,
    ),
    "w17_ceiling_actions": _sql(
        "mem",
        """, p as (select service, slot, vram_bytes as v, row_number() over (partition by service order by at_ms, sample_id) - 1 as step_no from mem),
        r as (select service, (-1)::bigint as step_no, null::varchar as slot, null::bigint as since, '' as action from (select distinct service from p)
          union all select service, step_no, slot, case when action in ('arm', 'wait') then coalesce(since, step_no * 8000) end, action from (
            select service, step_no, slot, since, case when slot is null or v <= 1181116006 then 'disarm' when since is null then 'arm'
              when step_no * 8000 - since > 30000 then 'kill' else 'wait' end as action from (
              select p.service, p.step_no, p.slot, p.v, case when p.slot is not distinct from r.slot then r.since end as since
              from r join p on p.service = r.service and p.step_no = r.step_no + 1)))
        select service, step_no, action from r where step_no >= 0""",
        True,
    ),
    "w18_restart_budget": f"""with recursive p as (select service, t // 24 as t, row_number() over (partition by service order by t, event_id) - 1 as step_no from (
          select user_id % 30 as service, {MS_ANSI} as t, event_id from events where event_type = 'error')),
        r as (select service, (-1)::bigint as step_no, []::bigint[] as hist, '' as outcome, 0 as recent from (select distinct service from p)
          union all select service, step_no, case when len(kept) >= 3 then kept else list_append(kept, t) end,
            case when len(kept) >= 3 then 'disabled' else 'restarted' end, len(kept) from (
              select p.service, p.step_no, p.t, list_filter(r.hist, lambda h: p.t - h < 1800000) as kept
              from r join p on p.service = r.service and p.step_no = r.step_no + 1))
        select service, step_no, outcome, recent from r where step_no >= 0""",
    "w19_counter_stalls": _sql(
        "polls",
        """, a as (select *, last_value(progress ignore nulls) over (partition by service order by at_ms rows between unbounded preceding and 1 preceding) as prior,
            min(at_ms) over (partition by service) as first_ms from polls),
        b as (select *, case when (progress is not null and progress is distinct from prior) or inflight = 0 then at_ms end as rs from a),
        c as (select *, at_ms - coalesce(last_value(rs ignore nulls) over (partition by service order by at_ms rows unbounded preceding), first_ms) as flat_ms from b)
        select service, poll_id, flat_ms, progress is not null and inflight > 0 and flat_ms >= 7200000 as stalled from c""",
    ),
    "w23_acceptance_latch": B.with_ctes(
        ["rm"],
        """select service_id, timestamp_ms as at_ms, max(x) over (partition by service_id order by timestamp_ms) > 0 as ever_accepted from (
          select service_id, timestamp_ms, max(coalesce(case when prompt_tokens > 90 then draft_tokens_accepted end, 0)) as x from rm group by 1, 2)""",
    ),
}
