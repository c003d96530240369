"""Registered derivation jobs and the SQL they are checked against."""

from __future__ import annotations

from string import Template

from pyspark.sql import functions as F

from meterloom.functions import records as R
from meterloom.operators import hygiene as H
from meterloom.plans import derive as D
from meterloom.sources import measurements as M

POS = M.POS_SQL
RATES = R.Rates({"ik_moe_rate": 30, "tensor_moe_rate": 54, "layer_token_bytes": 1028, "base": 300 * R.MIB, "base_per_layer": 1 * R.MIB, "base_moe": 20 * R.MIB, "pinned_extra": 8 * R.MIB, "base_per_device": 90 * R.MIB})
WITHIN = 400 * 86_400_000


def _ok(fn):
    return lambda s, d: fn(H.usable(M.measurements(s, d)))


def _pairs(m):
    return D.draft_pairs(m, WITHIN)


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def _clean(s, d):
    """The latest usable measurement of every cell: chosen by narrow rows, so whole records are neither sorted nor shuffled."""
    narrow = M.measurements(s, d).select("cell", "status", "provenance.measured_at_utc", "pos")
    chosen = narrow.select("cell", "status", F.struct("measured_at_utc").alias("provenance"), "pos")
    return M.at_positions(H.latest_measurement(H.usable(chosen)))


def _all(s, d):
    return M._once(s, d, "derived", lambda: D.derive_all(_clean(s, d), RATES, WITHIN))


#: Values of an earlier state of the data: a part of what is derived, some of it changed, and one entry a table that nothing derives any more.
COMMITTED = """select name, key, derived + case when {length}(key) % 4 = 1 then 1 else 0 end as committed from {derived} where {length}(key) % 4 <> 0
  union all select distinct name, 'gone' as key, cast(1 as bigint) as committed from {derived}"""


def _checked_all(s, d):
    derived = _all(s, d)
    committed = s.sql(COMMITTED.format(derived="{derived}", length="length"), derived=derived.where("status = 'ok'").select("name", "key", F.col("value").alias("derived")))
    return D.check_committed(committed.withColumnRenamed("committed", "value"), derived).select("name", "key", "committed", "derived", "state")


def _checked(s, d):
    m = H.usable(M.measurements(s, d))
    derived = D.unfused_score(m).select(F.lit("unfused_score_rates").alias("name"), "key", "value", "status")
    committed = m.groupBy(R.parsed("arch").alias("key")).agg(F.max(R.parsed("n_layer")).alias("value")).filter("value > 32").select(F.lit("unfused_score_rates").alias("name"), "key", "value")
    return D.check_committed(committed, derived).select("name", "key", "committed", "derived", "state")


def _arena_check(m):
    flat = m.sparkSession.createDataFrame([("qwen3", 40_000), ("laguna+moe", 43_000)], "key string, value bigint")
    quant = m.sparkSession.createDataFrame([("qwen3", 133), ("llama", 139)], "key string, value bigint")
    return _rounded(D.arena_check(m, RATES, flat, quant).drop("log"), "error")


def _arena(m):
    t = R.arena_terms(RATES)
    return m.select("cell", F.col("pos.cents").alias("cents"), *[F.round(t[k], 6).alias(k) for k in ("mask", "swa", "hidden")])


def _sums(m):
    sums = R.context_sums(R.parsed("contexts"))
    return m.select("cell", F.col("pos.cents").alias("cents"), *[(R.main_context(sums))[k].alias(f"main_{k}") for k in ("kv", "rs", "compute")], *[(R.draft_context(sums))[k].alias(f"draft_{k}") for k in ("kv", "compute")])


def _design(m):
    c = R.design_columns(R.ubatch_or_default(), R.factor("ctx"), R.factor("ctx"), R.kv_quantised(), F.lit(1.0) / R.cards_nonempty(), R.parsed("n_vocab"), R.parsed("n_embd"), R.is_hybrid(), R.layer_split_copies())
    return m.groupBy(R.parsed("arch").alias("arch")).agg(*[F.round(F.sum(v), 6).alias(k) for k, v in c.items()])


QUERIES = {
    "x5_arena_terms": _ok(_arena),
    "x6_recurrent_state": _ok(lambda m: _rounded(D.recurrent_pools(m).select("arch", F.col("model.r").alias("r"), F.col("model.s").alias("s")), "r", "s").groupBy("arch", "r", "s").count()),
    "x7_table_less_compute": _ok(lambda m: m.select("cell", F.col("pos.cents").alias("cents"), F.round(R.table_less_compute(), 6).alias("remainder")).filter("remainder is not null")),
    "x8_context_sums": _ok(_sums),
    "x9_design_columns": _ok(_design),
    "d1_mask_copies": _ok(lambda m: D.mask_copies(m, RATES)),
    "d2_offload_batch": _ok(lambda m: D.offload_batch(m, RATES)),
    "d3_tensor_moe": _ok(lambda m: D.tensor_moe(m, RATES)),
    "d4_fork_moe": _ok(lambda m: D.fork_moe(m, RATES)),
    "d5_layer_token_term": _ok(lambda m: _rounded(D.layer_token_term(m, RATES), "control")),
    "d6_quantised_cache": _ok(D.quantised_cache),
    "d7_unfused_host": _ok(lambda m: D.unfused_host(m, RATES)),
    "d8_unfused_score": _ok(D.unfused_score),
    "d9_vision_graph": _ok(D.vision_graph),
    "d10_recorded_remainders": _ok(D.recorded_remainders),
    "d11_baseline_offset": _ok(lambda m: D.baseline_offset(m, RATES, D.unfused_host(m, RATES))),
    "d12_tensor_baseline": _ok(lambda m: D.tensor_baseline(m, RATES)),
    "d13_device_cost": _ok(D.device_cost),
    "d14_slot_cost": _ok(D.slot_cost),
    "d15_checkpoint_headroom": _ok(D.checkpoint_headroom),
    "d16_draft_slope": _ok(lambda m: D.draft_slope(_pairs(m))),
    "d17_draft_unaccounted": _ok(lambda m: D.draft_unaccounted(_pairs(m))),
    "d18_draft_line": _ok(D.draft_line),
    "d19_draft_host": _ok(lambda m: D.draft_host(_pairs(m))),
    "d20_slot_series": _ok(lambda m: D.slot_series(_pairs(m))),
    "d21_rollback_depth": _ok(D.rollback_depth),
    "d21_recurrent_errors": _ok(lambda m: _rounded(D.recurrent_errors(m), "error")),
    "d22_derive_all": _all,
    "d23_check_committed": _checked,
    "d23_check_all_tables": _checked_all,
    "a26_worst_cells": _ok(_arena_check),
}

MIB = M.MIB
_R = f"""select *, mask_mib + swa_mib as masks, hidden_mib + case when moe_below then (case when ik then $ik when hybrid and split_l = 'tensor' then $tensor else 0 end) * n_embd * tokens else 0 end / {MIB} as hid,
  case when gpus = '' then 1 else n_cards end as cards1, case when n_cards > 1 and split_l = 'layer' then 4e0 else 1e0 end as copies, (anon_kb + shmem_kb) // 1024 as owned_mib from m where status = 'ok'"""
PLAIN = "arena_mib <> 0 and ngl = 99 and gpus <> ''"


def _job(body: str, **extra: str) -> str:
    """SQL over the measurements; $ik, $tensor, $layer and $device are constants that come from other jobs."""
    ctes = {"m": M.flat_sql(), "r": _R, **extra}
    return "with " + ", ".join(f"{n} as ({q})" for n, q in ctes.items()) + " " + body


def _with(job: str, **constants: str) -> str:
    return Template(job).safe_substitute({"ik": "30", "tensor": "54", "layer": "1028", "device": f"90 * {MIB}"} | constants)


def _sql(body: str, **extra: str) -> str:
    return _with(_job(body, **extra))


def _agree(rel: str, key: str, tol: float = 0.15, floor: float = 0.0) -> str:
    return f"""(select {key} as key, count(*) as n, min(v) as lo, max(v) as hi, median(v) as med,
      case when count(*) = 0 then 'no-data' when max(v) - min(v) <= {floor} or median(v) = 0 or (max(v) - min(v)) / abs(median(v)) <= {tol} then 'ok' else 'disagree' end as status
      from {rel} where v is not null group by 1)"""


def _he(x: str) -> str:
    return f"cast(round_even({x}, 0) as bigint)"


MED = f"select key, {_he('med')} as value, n, status from "
TOP = f"select key, {_he('hi')} as value, n, status from "
GUARD = """(select key, max(v) as top, count(*) as n, case when count(*) >= 3 and list_sort(list(v))[-2] > 0 and max(v) > 0 and max(v)::double / list_sort(list(v))[-2] > 4 then 'outlier' else 'ok' end as status from {rel} group by 1)"""
UNFUSED = f"""select variant as key, (arena_mib - (c * masks + hid) - case when per_layer then $layer * n_layer * tokens / {MIB} else 0 end) * {MIB} / tokens / c as v
  from (select *, case when n_cards > 1 and split_l = 'layer' and not hybrid then 4e0 else 1e0 end as c from r) where {PLAIN} and flash_attn = 'off' and not spec and not ik"""
BASE_ROWS = f"{PLAIN} and not spec and not hybrid and served and not bench and parallel = 1 and not no_mmap and probe_prompt_tokens < 8192"
PAIRS = f"""select 'org/' || stem as model, ctx, parallel, gpus, greatest(any_value(n_cards), 1) as cards,
  arg_max(struct_pack(u := gpu_used, t := measured_ms, o := owned_mib, d := draft, k := spec_type, dk := draft_kv, dc := draft_compute, mr := main_rs, mc := main_compute), row({POS})) filter (spec) as a,
  arg_max(struct_pack(u := gpu_used, t := measured_ms, o := owned_mib, mr := main_rs, mc := main_compute), row({POS})) filter (not spec) as b
  from r where arch <> '' group by stem, ctx, parallel, kv_unified, split, gpus, ubatch, kv_type, served, mmproj"""
DP = f"""select model, ctx, parallel, cards, a.u - b.u as delta, a.o - b.o as host_delta, case when coalesce(a.d, '') <> '' then 'separate' else 'embedded' end as shape, a.k as mechanism, a, b
  from pairs where a is not null and b is not null and a.u <> 0 and b.u <> 0 and abs(a.t - b.t) <= {WITHIN} and a.u > b.u"""

JOBS = {
    "x5_arena_terms": _job("select cell, cents, round(mask_mib, 6) as mask, round(swa_mib, 6) as swa, round(hid, 6) as hidden from r"),
    "x6_recurrent_state": _job(
        f"""select arch, r, s, count(*) as count from (select arch, case when arch <> '' then round(r_mib, 6) end as r, case when arch <> '' then round(128 * 2048 * rec_layers * parallel * (rs_seq + 1) * 4 / {MIB}, 6) end as s from r where rec_layers is not null) group by 1, 2, 3"""
    ),
    "x7_table_less_compute": _job(
        """, t as (select cell, cents, gpu_used, gpu_used - weights_mib - main_kv - draft_kv - main_rs as rem, n_cards from r where gpu_used <> 0 and not has_table and weights_mib <> 0)
        select cell, cents, round(rem / greatest(n_cards, 1), 6) as remainder from t where rem > 0"""
    ),
    "x8_context_sums": _job("select cell, cents, main_kv, main_rs, main_compute, case when spec then draft_kv end as draft_kv, case when spec then draft_compute end as draft_compute from r"),
    "x9_design_columns": _job(
        f"""select arch, round(sum(1.0), 6)::double as flat, round(sum(1.0::double / greatest(n_cards, 1)), 6) as head_flat, round(sum(n_embd * ub / {MIB}), 6) as hidden, round(sum(log2(greatest(ub, 512) / 512.0::double)), 6) as doubling,
        round(sum(copies * ub * ctx / {MIB}), 6) as mask, round(sum(case when kv_type = 'q8_0' then ub * ctx / {MIB} else 0 end), 6) as quant, round(sum(1.0::double / greatest(n_cards, 1) * 151936 * ub / {MIB}), 6) as logits,
        round(sum(case when hybrid then 1.0::double / greatest(n_cards, 1) else 0 end), 6) as offload_head from r group by 1"""
    ),
    "d1_mask_copies": _job(
        MED + _agree(f"(select (arena_mib - hid) / masks as v from r where {PLAIN} and not ik and flash_attn = 'on' and arch <> 'gemma4' and not hybrid and masks > 0 and cards1 > 1 and split_l = 'layer')", "'mask_copies'")
    ),
    "d2_offload_batch": _job(
        f""", x as (select (arena_mib - masks - hidden_mib) * {MIB} / tokens > 1024 as on_, tokens * n_expert_used / n_expert::double as ratio from r where ik and arena_mib <> 0 and n_expert <> 0 and flash_attn = 'on' and ngl = 99)
        select 'offload_min_batch' as key, {_he('min(ratio) filter (not on_)')} as value, count(*) as n, case when max(ratio) filter (on_) is not null and min(ratio) filter (not on_) is not null then 'ok' else 'no-data' end as status, max(ratio) filter (on_) as worst_on from x"""
    ),
    "d3_tensor_moe": _job(
        MED + _agree(f"(select (arena_mib - masks - hidden_mib) * {MIB} / tokens / n_embd as v from r where not ik and hybrid and split_l = 'tensor' and flash_attn = 'on' and not spec and arena_mib <> 0 and ngl = 99 and arena_mib - masks - hidden_mib > 0)", "'tensor_moe_rate'")
    ),
    "d4_fork_moe": _job(
        f"""select p.key, {_he('greatest(p.hi, 0)')} as value, p.n, case when p.status <> 'ok' then p.status when split_part(p.key, '@', 1) not in ('glm-dsa', 'laguna') and q.status <> 'ok' then 'disagree' else 'ok' end as status
        from {_agree('pts', "arch || '@' || cast(cards1 as varchar)")} p join {_agree('pts', 'arch')} q on q.key = split_part(p.key, '@', 1)""",
        pts=f"select arch, cards1, (arena_mib - masks - hidden_mib) * {MIB} / tokens / n_embd as v from r where ik and arena_mib <> 0 and moe_below and flash_attn = 'on' and ngl = 99",
    ),
    "d5_layer_token_term": _job(
        f"""select 'layer_token_bytes' as key, {_he('a.med')} as value, a.n, a.status, round(coalesce(b.med, 0), 6) as control
        from (select * from {_agree('pts', 'v > 500')} where key) a left join (select * from {_agree('pts', 'v > 500')} where not key) b on true""",
        pts=f"select (arena_mib - (copies * masks + hid)) * {MIB} / (n_layer::double * tokens) as v from r where {PLAIN} and arch = 'gemma4' and flash_attn = 'on' and not spec and kv_type = 'f16'",
    ),
    "d6_quantised_cache": _job(
        TOP + _agree("pts", "arch", 0.05),
        pairs=f"""select stem, ctx, ubatch, split, gpus, coalesce(n_cpu_moe, 0) as moe, any_value(n_cards) as n_cards, arg_max(arena_mib, row({POS})) filter (kv_type = 'q8_0') as q, arg_max(arena_mib, row({POS})) filter (kv_type = 'f16') as f
          from r where {PLAIN} and not spec group by stem, ctx, ubatch, parallel, kv_unified, split, gpus, flash_attn, served, coalesce(n_cpu_moe, 0), no_mmap, rtr, mmproj""",
        archs=f"select stem, arg_max(arch, row({POS})) as arch from r where {PLAIN} and not spec group by 1",
        pts=f"select arch, (q - f) * {MIB} / nullif(least(ctx, ubatch), 0) / case when n_cards > 1 and split = 'layer' and moe = 0 then 4 else 1 end as v from pairs join archs using (stem) where q is not null and f is not null",
    ),
    "d7_unfused_host": _job(f"select key, greatest({_he('hi')}, 0) as value, n, status from {_agree('pts', 'key', 0.10, 4096.0)}", pts=UNFUSED),
    "d8_unfused_score": _job(
        f""", p as (select arch, ctx, gpus, parallel, kv_unified, ub, any_value(n_cards) as n_cards,
            arg_min(struct_pack(u := gpu_used, h := heads, w := w), row({POS})) filter (flash_attn = 'off') as a, arg_min(struct_pack(u := gpu_used, h := heads, w := w), row({POS})) filter (flash_attn = 'on') as b
          from (select *, case when n_head <> 0 then n_head else n_embd // 128 end as heads, case when has_table then (case when fused then 1 else n_cards end) * dev_model else weights_mib end::double as w from r)
          where gpu_used <> 0 and arch <> '' group by arch, stem, ctx, ub, kv_type, split_l, gpus, parallel, kv_unified, runtime, coalesce(n_cpu_moe, 0), spec, ngl, embeddings, coalesce(mmproj, '') <> '', served),
        e as (select *, ctx // case when kv_unified then 1 else parallel end as nkv, (a.u - b.u)::double / greatest(n_cards, 1) as per from p where a is not null and b is not null),
        v as (select arch as key, per * {MIB} / (a.h * nkv * least(nkv, ub)) as v from e where per > 0 and a.h <> 0 and (a.w = 0 or b.w = 0 or abs(a.w - b.w) / greatest(a.w, b.w) <= 0.01))
        select key, greatest(cast(ceil(max(v) * 100) as bigint), 1) as value, count(*) as n, 'ok' as status from v group by 1"""
    ),
    "d9_vision_graph": _job(
        f""", v as (select (900.0::double + p3 % 3) * {MIB} - 800 * 1048576 as v, 768 + 128 * (p3 % 2) as image from r where mmproj = 'mmproj.gguf'),
        s as (select distinct image, {_he(f'v / {MIB}')} as mib from v)
        select 'vision_graph_bytes' as key, {_he('max(v)')} as value, count(*) as n, 'ok' as status,
          (select string_agg('image ' || cast(image as varchar) || '/merge 2 takes ' || cast(mib as varchar) || ' MiB', ', ' order by image, mib) from s) as evidence from v"""
    ),
    "d10_recorded_remainders": _job(
        f""", t as (select arch || ' ctx' || cast(ctx as varchar) || '/ub' || cast(ub as varchar) as key, gpu_used - weights_mib - main_kv - draft_kv - main_rs as rem, n_cards from r
          where gpu_used <> 0 and not has_table and weights_mib <> 0 and arch <> '' and flash_attn = 'on' and not spec)
        select key, greatest(max({_he('rem / greatest(n_cards, 1)')}), 0) as value, count(*) as n, 'ok' as status from t where rem > 0 group by 1"""
    ),
    "d11_baseline_offset": _job(
        f""", u as (select key, greatest({_he('hi')}, 0) as rate from {_agree('pts', 'key', 0.10, 4096.0)} where status = 'ok'),
        b as (select r.*, coalesce(u.rate, (select max(rate) from u)) as rate, case when cards1 > 1 and not ik then 4e0 else 1e0 end as c from r left join u on u.key = r.variant where {BASE_ROWS} and split_l = 'layer'),
        v as (select variant || case when ik then '@ik' else '' end || case when flash_attn <> 'on' then '@nofa' else '' end as key,
          (anon_kb + shmem_kb) * 1024 - (c * masks + hid) * {MIB} - case when flash_attn <> 'on' then rate * tokens * c else 0 end - 8 * {MIB} - $device * (cards1 - 1) - (300 * {MIB} + n_layer * {MIB} + case when n_expert <> 0 then 20 * {MIB} else 0 end) as v from b)
        select key, {_he('max(v)')} as value, count(*) as n, 'ok' as status from v group by 1""",
        pts=UNFUSED,
    ),
    "d12_tensor_baseline": _job(
        f"select key, {_he(f'hi * {MIB}')} as value, n, status from {_agree('pts', 'arch', 0.20)}",
        base=f"select stem, ctx, ubatch, arch, split_l, ((anon_kb + shmem_kb) * 1024 - (case when split_l = 'layer' then 4e0 else 1e0 end * masks + hid) * {MIB}) / {MIB} as b from r where {BASE_ROWS} and gpus = '0,1'",
        pts="select arch, a - c as v from (select arch, median(b) filter (split_l = 'tensor') as a, median(b) filter (split_l = 'layer') as c from base group by stem, ctx, ubatch, arch) where a is not null and c is not null",
    ),
    "d13_device_cost": _job(
        MED + _agree("pts", "'base_per_device'"),
        pts=f"""select ((b - a) * 1024)::double as v from (select arg_max(anon_kb + shmem_kb, row({POS})) filter (n_cards = 1) as a, arg_max(anon_kb + shmem_kb, row({POS})) filter (n_cards = 2) as b
          from r where label like 'devices-%' and ngl = 0 group by stem) where a is not null and b is not null""",
    ),
    "d14_slot_cost": _job(
        f""", p as (select arch, runtime, ctx, ubatch, gpus, split_l, kv_type, kv_unified, concurrency as c, min(anon_kb) * 1024 as o from r where served and not bench and not spec and not hybrid and arch <> '' group by all),
        q as (select *, min(c) over w as lo, arg_min(o, c) over w as base from p window w as (partition by arch, runtime, ctx, ubatch, gpus, split_l, kv_type, kv_unified)),
        s as (select arch as key, max((o - base)::double / (c - lo)) as v from q where c > lo group by arch, runtime, ctx, ubatch, gpus, split_l, kv_type, kv_unified)
        select key, greatest({_he('top')}, 0) as value, n, status from {GUARD.format(rel='s')}"""
    ),
    "d15_checkpoint_headroom": _job(
        f""", p as (select variant as key, max(owned_mib) filter (probe_prompt_tokens >= 8192) as a, max(owned_mib) filter (probe_prompt_tokens < 8192) as b from r
          where served and not bench and not spec and not hybrid and ngl = 99 group by variant, runtime, ctx, ubatch, gpus, split_l, kv_type, parallel, flash_attn, concurrency, no_mmap),
        s as (select key, greatest(a - b, 0) as v from p where a is not null and b is not null)
        select key, top * 1048576 as value, n, status from {GUARD.format(rel='s')}"""
    ),
    "d16_draft_slope": _job(
        """, x as (select mechanism, ctx, max(delta) as y from dp where shape = 'separate' group by 1, 2)
        select mechanism as key, cast(ceil((arg_max(y, ctx) - arg_min(y, ctx))::double / ((max(ctx) - min(ctx)) / 1024.0::double)) as bigint) as value, count(*) as n, 'ok' as status from x group by 1 having count(*) >= 2""",
        pairs=PAIRS, dp=DP,
    ),
    "d17_draft_unaccounted": _job(
        f""", g as (select (delta - (a.dk + cards * a.dc + cards * (a.mr - b.mr) + cards * (a.mc - b.mc))) / cards::double as v from dp where shape = 'embedded')
        select 'draft_unaccounted_mib' as key, {_he('max(v)')} as value, count(*) as n, case when count(*) = 0 then 'no-data' else 'ok' end as status from g where v > 0""",
        pairs=PAIRS, dp=DP,
    ),
    "d18_draft_line": _job(
        f""", p as (select arch, ctx / 1024.0::double as x, arg_max(draft_compute, row({POS})) as y from r where spec and draft is null and draft_compute > 0 group by 1, 2),
        f as (select arch, count(*) as n, coalesce(regr_slope(y, x), 0) as sl, avg(x) as mx, avg(y) as my from p group by 1 having count(*) >= 2),
        l as (select f.arch, n, sl, my - sl * mx as b, max(y - (my - sl * mx + sl * x)) as de from p join f on f.arch = p.arch group by all)
        select arch as key, {_he('b + greatest(de, 0)')} as value, n, 'ok' as status, {_he('sl * 1000')} as slope_milli from l"""
    ),
    "d19_draft_host": _job(
        f""", p as (select shape, model, ctx, max(host_delta) as y from dp where host_delta > 0 group by 1, 2, 3),
        e as (select shape, (arg_max(y, ctx) - arg_min(y, ctx))::double / ((max(ctx) - min(ctx)) / 1024.0::double) as sl from p group by shape, model having count(*) >= 2),
        s as (select shape, coalesce((select {_he('max(sl) * 1000')} from e where e.shape = p.shape), 0) as milli, ctx, y from p)
        select shape as key, cast(ceil(max(y - milli / 1000.0::double * (ctx / 1024.0::double)) * 1.10::double) as bigint) * 1048576 as value, count(*) as n, 'ok' as status, milli as slope_milli from s group by shape, milli""",
        pairs=PAIRS, dp=DP,
    ),
    "d20_slot_series": _job(
        """, p as (select regexp_extract(model, '[^/]*$') as name, ctx, parallel, arg_max(delta, row(case when shape = 'separate' then 1 else 0 end, delta)) as d from dp group by 1, 2, 3)
        select name, ctx, count(*) as n, string_agg('np' || cast(parallel as varchar) || ' ' || cast(d as varchar) || ' MiB', ', ' order by parallel) as series from p group by 1, 2 having count(*) > 1""",
        pairs=PAIRS, dp=DP,
    ),
    "d21_rollback_depth": _job("select 'rollback_depth' as key, max(rs_seq) as value, count(*) as n, case when min(rs_seq) filter (rs_seq > 0) is null then 'no-data' else 'ok' end as status from r where rec_layers is not null"),
    "d21_recurrent_errors": _job(
        f"""select arch, unnest(['R', 'S']) as half, round(unnest([max(0.0::double), max(abs(s_mib - 128 * 2048 * rec_layers * parallel * (rs_seq + 1) * 4 / {MIB}))]), 6) as error from r where rec_layers is not null and arch <> '' group by 1"""
    ),
    "a26_worst_cells": _job(
        f""", x as (select arch, case when cards1 > 1 and not ik then 4e0 else 1e0 end as c, tokens / {MIB} as per, case when variant = 'qwen3' then 40000 else 43000 end as nf, case when arch = 'qwen3' then 133 else 139 end as qr, * exclude (arch) from r
          where arena_mib <> 0 and not spec and split_l <> 'tensor' and not hybrid and ngl = 99),
        e as (select arch, abs(arena_mib - (c * (masks + case when not ik and flash_attn <> 'on' then nf * per else 0 end) + hid + case when kv_type = 'q8_0' then qr * per else 0 end + case when per_layer then $layer * n_layer * per else 0 end)) as e from x)
        select arch, round(max(e), 6) as error, max(e) <= 5 as within from e group by 1"""
    ),
}

JOBS["d23_check_committed"] = _job(
    """, c as (select arch as key, max(n_layer) as committed from r group by 1 having max(n_layer) > 32), d as (select key, value as derived from d8)
    select 'unfused_score_rates' as name, coalesce(c.key, d.key) as key, committed, derived, case when derived is null then 'missing' when committed is null then 'new' when committed = derived then 'same' else 'changed' end as state
    from c full join d on c.key = d.key""",
    d8=JOBS["d8_unfused_score"],
)

ORACLE = {name: _with(job) for name, job in JOBS.items()}

TABLES = {
    "fork_moe_rates": "d4_fork_moe", "tensor_moe_rate": "d3_tensor_moe", "layer_token_bytes": "d5_layer_token_term", "base_per_device": "d13_device_cost", "mask_copies": "d1_mask_copies",
    "offload_min_batch": "d2_offload_batch", "quantised_cache_rates": "d6_quantised_cache", "unfused_host_rates": "d7_unfused_host", "unfused_score_rates": "d8_unfused_score",
    "vision_graph_bytes": "d9_vision_graph", "recorded_remainders": "d10_recorded_remainders", "baseline_offsets": "d11_baseline_offset", "tensor_split_baseline": "d12_tensor_baseline",
    "slot_bytes": "d14_slot_cost", "checkpoint_headroom": "d15_checkpoint_headroom", "draft_slopes": "d16_draft_slope", "draft_unaccounted_mib": "d17_draft_unaccounted",
    "draft_lines": "d18_draft_line", "draft_host_bytes": "d19_draft_host", "rollback_depth": "d21_rollback_depth",
}


def _every_table() -> str:
    """CTEs up to `derived`: each job over the latest measurement of a cell, with the constants that earlier jobs found."""
    def job(table: str, **constants: str) -> str:
        return _with(JOBS[TABLES[table]], **constants).replace(M.flat_sql(), "select * from clean")

    found = lambda source, fallback: f"coalesce((select max(value) from ({source}) where status = 'ok'), {fallback})"
    early = {"ik": "(select ik from c1)", "tensor": "(select tensor from c1)"}
    late = early | {"layer": "(select layer from c2)", "device": "(select device from c2)"}
    ctes = {
        "clean": f"select * from ({M.flat_sql()}) where status = 'ok' qualify row_number() over (partition by cell order by measured_ms desc, {POS}) = 1",
        "c1": f"select {found(job('fork_moe_rates'), 30)} as ik, {found(job('tensor_moe_rate'), 54)} as tensor",
        "c2": f"select {found(job('layer_token_bytes', **early), 1028)} as layer, {found(job('base_per_device'), f'90 * {MIB}')} as device",
    }
    ctes |= {f"t_{name}": job(name, **late) for name in TABLES}
    ctes["t_draft_host_slope_milli"] = "select 'draft_host_slope_milli' as key, max(slope_milli) as value, sum(n) as n, 'ok' as status from t_draft_host_bytes"
    parts = [f"select '{name}' as name, cast(key as varchar) as key, cast(value as bigint) as value, cast(n as bigint) as n, status from t_{name}" for name in [*TABLES, "draft_host_slope_milli"]]
    ctes["derived"] = " union all ".join(parts)
    return "with " + ", ".join(f"{n} as materialized ({q})" for n, q in ctes.items())


ORACLE["d22_derive_all"] = _every_table() + " select * from derived"
ORACLE["d23_check_all_tables"] = _every_table() + f""", d as (select name, key, value as derived from derived where status = 'ok'), c as ({COMMITTED.format(derived="d", length="length")})
  select coalesce(c.name, d.name) as name, coalesce(c.key, d.key) as key, committed, derived,
    case when coalesce(c.name, d.name) in ({", ".join(f"'{n}'" for n in D.UNSIGNED)}) and derived < 0 then 'negative' when derived is null then 'missing' when committed is null then 'new' when committed = derived then 'same' else 'changed' end as state
  from c full join d on c.name = d.name and c.key = d.key"""
