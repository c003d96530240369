"""Registered fitting, cross-validation and capacity queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.catalog.derive import RATES, _sql
from meterloom.functions import records as R
from meterloom.operators import capacity as K
from meterloom.operators import hygiene as H
from meterloom.operators import report as RP
from meterloom.operators.pairs import coefficient_lookup
from meterloom.plans import crossval as X
from meterloom.plans import derive as D
from meterloom.plans import fit as M5
from meterloom.session import settle
from meterloom.sources import bindings as B
from meterloom.sources import measurements as M


def _obs(s, d):
    return M5.observations(H.usable(M.measurements(s, d)), 4)


def _fitted(s, d):
    obs = settle(_obs(s, d), "observations")
    sums = settle(M5.normal_sums(obs, M5.GROUP), "sums")
    return obs, sums, settle(M5.fit_groups(sums, M5.GROUP), "fit")


def _coefs(s, d):
    return _fitted(s, d)[2].withColumn("coef", F.round("coef", 6))


def _resid(s, d):
    obs, _, fitted = _fitted(s, d)
    return M5.residuals(obs, M5.wide_coefficients(fitted, M5.GROUP), M5.GROUP).withColumn("worst", F.round("worst", 6))


def _gram(s, d):
    """Normal equations of price over quantity per return flag, on whole line items."""
    li = B.table(s, d, "lineitem").select(
        "l_returnflag", F.lit(1.0).alias("flat"), F.col("l_quantity").alias("mask"), (F.col("l_quantity") * F.col("l_discount")).alias("quant"), F.col("l_extendedprice").alias("target")
    )
    sums = M5.normal_sums(li, ["l_returnflag"], ["flat", "mask", "quant"])
    return sums.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in sums.columns if c[:2] in ("g_", "r_")], "v_mask", "v_quant")


KNOWN = """select l_returnflag as flag, 1e0 as flat, cast(l_quantity as double) as mask, cast(l_quantity as double) * case when l_returnflag = 'R' then 0.05e0 else cast(l_discount as double) end as quant,
  case l_returnflag when 'A' then 5e0 + 2e0 * cast(l_quantity as double) + 3e0 * cast(l_quantity as double) * cast(l_discount as double) when 'R' then 11e0 + 6e0 * cast(l_quantity as double)
    else 900e0 + 30e0 * cast(l_quantity as double) - 8e0 * cast(l_quantity as double) * cast(l_discount as double) end as target from lineitem"""
COLUMNS = ["flat", "mask", "quant"]


def _known_rows(s, d):
    """Line items with targets whose fit is known: exact, with a dependent column, with one that has to go."""
    return s.sql(KNOWN.replace("from lineitem", "from {li}"), li=B.table(s, d, "lineitem"))


def _known_fit(s, d):
    fitted = M5.fit_groups(M5.normal_sums(_known_rows(s, d), ["flag"], COLUMNS), ["flag"], COLUMNS)
    return fitted.select("flag", "n", "column", F.round("coef", 5).alias("coef"))


def _known_residuals(s, d):
    fitted = M5.fit_groups(M5.normal_sums(_known_rows(s, d), ["flag"], COLUMNS), ["flag"], COLUMNS)
    found = M5.residuals(_known_rows(s, d), M5.wide_coefficients(fitted, ["flag"], COLUMNS), ["flag"], COLUMNS)
    return found.select("flag", "n", F.round("worst", 6).alias("worst"), "outside")


def _score_rows(s, d):
    m = H.usable(M.measurements(s, d))
    return m.select(
        "cell", R.factor("runtime").alias("runtime"), R.split_or_layer().alias("split"), R.parsed("arch").alias("arch"), F.when(R.parsed("per_layer_token_embd"), F.lit("e")).alias("variant"),
        R.ubatch_or_default().alias("ub"), R.factor("ctx").alias("n_kv"), R.factor("ctx").alias("ctx"), R.kv_quantised().alias("quantised"), R.parsed("n_vocab").alias("n_vocab"),
        R.parsed("n_embd").alias("n_embd"), R.is_hybrid().alias("offloading"), R.layer_split_copies().alias("copies"),
    )


def _score(s, d):
    _, sums, fitted = _fitted(s, d)
    default = {r["column"]: r["coef"] for r in M5.pooled_default(sums).collect()}
    wide = M5.wide_coefficients(fitted, M5.GROUP)
    entries = wide.select(F.when(F.col("runtime") == "ik", F.lit("ik")).alias("runtime"), "split", "arch", "variant", "coefficients")
    full = {c: default.get(c, 0.0) for c in M5.PRIORITY}
    return M5.score(coefficient_lookup(_score_rows(s, d), entries, full)).groupBy("runtime", "split", "arch", "tier").agg(F.max("per_device_mib").alias("per_device_mib"), F.max("head_extra_mib").alias("head_extra_mib"))


#: Coefficients of known entries, which add their layer count to `flat`, and those of everything else.
ENTRY = {"flat": 0.5, "head_flat": 3.25, "hidden": 2.0, "doubling": 1.5, "mask": 0.5, "quant": 0.25, "logits": 0.75, "offload_head": 4.0}
ELSE = {"flat": 7.0, "head_flat": 1.5, "hidden": 1.0, "doubling": 0.5, "mask": 0.25, "quant": 0.125, "logits": 0.5, "offload_head": 2.0}


def _known_scores(s, d):
    """Scores from given entries, so that every figure is known."""
    records = H.usable(M.measurements(s, d)).filter(R.parsed("arch").isin("qwen3", "gemma4", "laguna"))
    layers = records.groupBy(F.when(R.is_ik(), "ik").alias("runtime"), R.split_or_layer().alias("split"), R.parsed("arch").alias("arch")).agg(F.max(R.parsed("n_layer")).alias("layers")).filter("runtime is not null or split = 'layer'")
    given = F.struct(*[(F.lit(ENTRY[c]) + (F.col("layers") if c == "flat" else F.lit(0.0))).alias(c) for c in M5.PRIORITY])
    entries = layers.select("runtime", "split", "arch", F.lit(None).cast("string").alias("variant"), given.alias("coefficients"))
    scored = M5.score(coefficient_lookup(_score_rows(s, d), entries, {c: ELSE[c] for c in M5.PRIORITY}))
    per = F.col("per_device_mib").cast("long")
    return scored.groupBy("runtime", "split", "arch", "tier").agg(F.count(F.lit(1)).alias("n"), F.min(per).alias("least"), F.max(per).alias("most"), F.sum(per).alias("total"), F.sum(F.col("head_extra_mib").cast("long")).alias("head_total"))


def _folds(s, d):
    m = H.usable(M.measurements(s, d))
    copies = X.consensus_folds(settle(D.mask_copy_points(m, RATES), "points"), "mask_copies")
    moe = X.consensus_folds(settle(D.tensor_moe_points(m, RATES), "points"), "tensor_moe_rate")
    return settle(copies.unionByName(moe).unionByName(X.max_folds(D.vision_points(m), "vision_graph_bytes")), "folds")


# --- capacity bindings -----------------------------------------------------

DEV = "select cast(n_nationkey as bigint) as slot, cast(20000 + 1500 * (n_nationkey % 9) as bigint) as total_mib, cast(9000 + 700 * (n_nationkey % 5) as bigint) as free_mib from nation"
SVC = "select s_suppkey as service, case when s_suppkey % 7 <> 0 then cast(s_suppkey % 5 * 20 as bigint) end as priority, case when s_suppkey % 11 <> 0 then (case when s_suppkey % 3 = 0 then 'persistent' else 'on_demand' end) end as lifecycle from supplier"
ASK = "select c_custkey as scenario, cast(c_nationkey as bigint) as slot, cast(floor(abs(c_acctbal)) as bigint) as want_mib from customer union all select c_custkey, cast((c_nationkey + 7) % 25 as bigint), cast(1000 + c_custkey % 9000 as bigint) from customer"
FREED = "select c_custkey as scenario, c_custkey % 97 as service from customer union all select c_custkey, c_custkey % 89 from customer"
EREQ = "select c_custkey as scenario, cast(c_nationkey as bigint) as slot, cast(floor(abs(c_acctbal)) + 500 as bigint) as want_mib, cast(600 as bigint) as free_mib, cast(c_custkey % 5 * 25 as bigint) as priority, case when c_custkey % 2 = 0 then 'persistent' else 'on_demand' end as lifecycle from customer"
ECAND = "select s_suppkey as service, cast(s_nationkey as bigint) as slot, cast(floor(abs(s_acctbal)) as bigint) as mib, s_suppkey % 2 = 0 as idle, cast(s_suppkey % 5 * 20 as bigint) as priority, case when s_suppkey % 3 = 0 then 'persistent' else 'on_demand' end as lifecycle from supplier"
CHOICE = "select o_orderkey as request, cast(o_custkey % 25 as bigint) as slot, cast(o_orderkey % 9000 as bigint) as min_mib, case when o_orderkey % 3 <> 0 then cast(9000 + o_orderkey % 3000 as bigint) end as prefer_mib from orders union all select o_orderkey, cast((o_custkey * 7 + 3) % 25 as bigint), cast(o_orderkey % 9000 as bigint), case when o_orderkey % 3 <> 0 then cast(9000 + o_orderkey % 3000 as bigint) end from orders"
PROC = "select cast(c_nationkey % 2 as bigint) as tick0, c_custkey + 1 as pid, cast(floor((c_custkey + 1) / 4e0) as bigint) as ppid, cast(floor(abs(c_acctbal)) as bigint) as rss_total, cast(floor(abs(c_acctbal) / 2) as bigint) as rss_owned, cast(floor(abs(c_acctbal) / 4) as bigint) as rss_file, 'grp' || cast(c_custkey % 50 as {text}) as cgroup from customer"


def _table(s, d, sql: str):
    """A binding that reads the driver's tables by name."""
    import re

    for name in set(re.findall(r"from (\w+)", sql)):
        B.table(s, d, name).createOrReplaceTempView(name)
    return s.sql(sql.replace("{text}", "string"))


def _resv(s, d):
    return B.reservations(s, d)


def _slots(s, d, optimistic=False):
    return K.slot_fit(_table(s, d, ASK), _table(s, d, DEV), _resv(s, d), _table(s, d, FREED), optimistic)


def _attributed(s, d):
    proc = _table(s, d, PROC).withColumn("tick", F.lit(0).cast("long"))
    gpu = proc.filter("pid % 3 = 0").select("tick", "pid", (F.col("pid") * 1000).alias("used_bytes"))
    registered = proc.filter("pid between 2 and 9").select("tick", (F.col("pid") % 5).alias("service"), "pid")
    groups = _table(s, d, "select distinct s_suppkey % 5 as service, 'grp' || cast(s_suppkey % 5 as {text}) as cgroup from supplier")
    return K.attribute_memory(registered, proc, gpu, groups)


KNOWN_SQL = f"""with t as ({KNOWN}),
  l as (select count(*) as n, sum(1 / target) as w, sum(mask / target) as wq, sum(mask * mask / target) as wqq, sum(mask) as q from t where flag = 'N'),
  k as (select 'A' as flag, 'flat' as "column", 5e0 as coef union all select 'A', 'mask', 2e0 union all select 'A', 'quant', 3e0 union all select 'R', 'flat', 11e0 union all select 'R', 'mask', 6e0
    union all select 'N', 'flat', (wqq * n - wq * q) / (w * wqq - wq * wq) from l union all select 'N', 'mask', (w * q - wq * n) / (w * wqq - wq * wq) from l)"""

QUERIES = {
    "m3_m4_known_fit": _known_fit,
    "m5_known_residuals": _known_residuals,
    "m1_observations": lambda s, d: _obs(s, d).groupBy(*M5.GROUP).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 6).alias(f"sum_{c}") for c in ["target", "mask", "quant", "hidden", "logits", "head_flat"]]),
    "m2_normal_sums": _gram,
    "m3_m4_fitted_coefficients": _coefs,
    "m5_residuals": _resid,
    "m5_pooled_default": lambda s, d: M5.pooled_default(_fitted(s, d)[1]).withColumn("coef", F.round("coef", 6)),
    "m5_entry_order": lambda s, d: RP.entry_order(M5.wide_coefficients(_fitted(s, d)[2], M5.GROUP).drop("coefficients")),
    "m6_scores": _score,
    "m6_known_scores": _known_scores,
    "m7_folds": lambda s, d: X.with_error(_folds(s, d)).withColumn("error_pct", F.round("error_pct", 6)),
    "m8_crossval_report": lambda s, d: X.report(_folds(s, d)).withColumn("worst_pct", F.round("worst_pct", 6)),
    "c1_fit_check": lambda s, d: K.fit_check(_slots(s, d)),
    "c1_fit_check_optimistic": lambda s, d: K.fit_check(_slots(s, d, True)),
    "c2_c3_eviction_set": lambda s, d: K.eviction_set(_table(s, d, EREQ), _table(s, d, ECAND)),
    "c4_overcommitted": lambda s, d: K.overcommitted(_resv(s, d), _table(s, d, DEV)),
    "c5_contention": lambda s, d: K.contention(_resv(s, d), _table(s, d, DEV), _table(s, d, SVC)),
    "c6_shortfalls": lambda s, d: K.shortfalls(_slots(s, d)),
    "l8_best_device": lambda s, d: K.best_device(_table(s, d, CHOICE), _table(s, d, DEV).withColumn("available_mib", F.col("free_mib"))),
    "j15_attributed_memory": _attributed,
}


def _cap(body: str, *names: str, **extra: str) -> str:
    known = {"dev": DEV, "svc": SVC, "ask": ASK, "freed": FREED, "ereq": EREQ, "ecand": ECAND, "choice": CHOICE, "resv": B.ansi_ctes()["resv"]} | extra
    return "with " + ", ".join(f"{n} as ({known[n]})" for n in (*names, *extra)) + " " + body


def _slots_sql(available: str) -> str:
    return f"""select scenario, slot, want_mib as needed_mib, {available} as available_mib, {available} >= want_mib as fits from (
      select a.*, d.free_mib as free, greatest(d.total_mib - coalesce(t.m, 0) + coalesce(g.m, 0), 0) as room from ask a join dev d using (slot)
      left join (select slot, sum(mib) as m from resv group by 1) t using (slot)
      left join (select scenario, slot, sum(mib) as m from (select distinct * from freed) f join resv using (service) group by 1, 2) g using (scenario, slot))"""


CHECK = """select scenario, bool_and(fits) as fits, arg_min(slot, slot) filter (not fits) as failing_slot, arg_min(needed_mib, row(slot, needed_mib)) filter (not fits) as needed_mib,
  arg_min(available_mib, row(slot, needed_mib)) filter (not fits) as available_mib from slots group by 1"""

_POINTS = f"""select stem || '.gguf' as model, (arena_mib - hid) / masks as v from r where arena_mib <> 0 and ngl = 99 and gpus <> '' and not ik and flash_attn = 'on' and arch <> 'gemma4' and not hybrid and masks > 0 and cards1 > 1 and split_l = 'layer'"""
_TPOINTS = f"""select stem || '.gguf' as model, (arena_mib - masks - hidden_mib) * {M.MIB} / tokens / n_embd as v from r where not ik and hybrid and split_l = 'tensor' and flash_attn = 'on' and not spec and arena_mib <> 0 and ngl = 99 and arena_mib - masks - hidden_mib > 0"""
_VPOINTS = f"select stem || '.gguf' as model, (900.0::double + p3 % 3) * {M.MIB} - 800 * 1048576 as v from r where mmproj = 'mmproj.gguf'"
FIT = "case when count(*) > 0 and (max(v) - min(v) <= 0 or median(v) = 0 or (max(v) - min(v)) / abs(median(v)) <= 0.15) then cast(round_even(median(v), 0) as bigint) end"


def _fold_sql(name: str, rel: str, fit: str = FIT) -> str:
    return f"""select '{name}' as constant, m.model, (select {fit} from {rel}) as full_, (select {fit} from {rel} p where p.model <> m.model) as without, (select {fit} from {rel} p where p.model = m.model) as alone
      from (select distinct model from {rel}) m"""


FOLDS = f"{_fold_sql('mask_copies', 'pa')} union all {_fold_sql('tensor_moe_rate', 'pb')} union all {_fold_sql('vision_graph_bytes', 'pc', 'cast(round_even(max(v), 0) as bigint)')}"
ERR = "case when alone <> 0 then 100.0::double * (without - alone) / alone end"


def _known_scores_sql() -> str:
    def dot(side: str, head: bool) -> str:
        c = lambda name: f"case tier when 'default' then {ELSE[name]}e0 else {ENTRY[name]}e0 end"
        body = f"""({c('flat')} + case when tier = 'default' then 0 else layers end) + {c('hidden')} * n_embd * ub / {M.MIB} + {c('doubling')} * log2(greatest(ub, 512) / 512e0)
          + {c('mask')} * copies * ub * ctx / {M.MIB} + case when kv_type = 'q8_0' then {c('quant')} * ub * ctx / {M.MIB} else 0 end"""
        extra = f"{c('head_flat')} + {c('logits')} * 151936 * ub / {M.MIB} + case when hybrid then {c('offload_head')} else 0 end"
        return f"cast(ceil({extra if head else body}) as bigint) as {side}"

    return f""", k as (select case when ik then 'ik' end as rt, split_l, arch, max(n_layer) as layers from r where arch in ('qwen3', 'gemma4', 'laguna') group by 1, 2, 3 having rt is not null or split_l = 'layer'),
      x as (select r.*, coalesce(o.layers, h.layers) as layers, case when o.layers is not null then 'runtime' when h.layers is not null then 'shared' else 'default' end as tier from r
        left join k o on o.rt = 'ik' and ik and o.arch = r.arch and o.split_l = r.split_l and not per_layer
        left join k h on h.rt is null and h.arch = r.arch and h.split_l = r.split_l and not per_layer),
      y as (select runtime, split_l as split, arch, tier, {dot('per', False)}, {dot('extra', True)} from x)
      select runtime, split, arch, tier, count(*) as n, min(per) as least, max(per) as most, cast(sum(per) as bigint) as total, cast(sum(extra) as bigint) as head_total from y group by 1, 2, 3, 4"""


ORACLE = {
    "m6_known_scores": _sql(_known_scores_sql()),
    "m3_m4_known_fit": KNOWN_SQL + """ select k.flag, c.n, k."column", round(k.coef, 5) as coef from k join (select flag, count(*) as n from t group by 1) c on c.flag = k.flag""",
    "m5_known_residuals": KNOWN_SQL + """, f as (select flag, sum(case when "column" = 'flat' then coef else 0 end) as a, sum(case when "column" = 'mask' then coef else 0 end) as b, sum(case when "column" = 'quant' then coef else 0 end) as c from k group by 1),
      o as (select t.flag, abs(a + b * mask + c * quant - target) / target as off from t join f on f.flag = t.flag)
      select flag, count(*) as n, round(max(off), 6) as worst, sum(case when off > 0.05 then 1 else 0 end) as outside from o group by 1""",
    "m1_observations": _sql(
        """, o as (select *, case when kv_unified then ctx else ctx // parallel end as nkv, case when split_l = 'layer' and n_cards > 1 and not hybrid then 4 else 1 end as cp, case when per_layer then 'e' end as variant_ from r
          where arch <> '' and flash_attn <> 'off' and coalesce(mmproj, '') = '' and not spec and card_used > 0 and n_cards > 0),
        t as (select *, (gpu_used - weights_mib - main_kv - main_rs) / greatest(n_cards, 1) as target, 1.0::double / n_cards as hs from o where not has_table and gpu_used <> 0 and weights_mib <> 0 and gpu_used - weights_mib - main_kv - main_rs > 0
          union all select *, (card_used - dev_model - dev_kv)::double as target, 1.0::double / n_cards from o where has_table and fused and card_used - dev_model - dev_kv > 0
          union all select * from (select *, (card_used - dev_model - dev_kv)::double as target, unnest(case n_cards when 1 then [1.0::double] when 2 then [1.0::double, 0] else [1.0::double, 0, 0] end) as hs from o where has_table and not fused) where target > 0)
        select runtime, split_l as split, arch, variant_ as variant, count(*) as n, round(sum(target), 6) as sum_target, round(sum(cp * ub * nkv / 1048576e0), 6) as sum_mask, round(sum(case when kv_type = 'q8_0' then ub * ctx / 1048576e0 else 0 end), 6) as sum_quant,
          round(sum(n_embd * ub / 1048576e0), 6) as sum_hidden, round(sum(hs * 151936 * ub / 1048576e0), 6) as sum_logits, round(sum(hs), 6) as sum_head_flat from t group by 1, 2, 3, 4"""
    ),
    "m2_normal_sums": """with x as (select l_returnflag, 1.0::double as f, l_quantity as m, l_quantity * l_discount as q, l_extendedprice as t, 1 / l_extendedprice as w from lineitem)
      select l_returnflag, count(*) as n, round(sum(w * f * f), 4) as g_flat_flat, round(sum(w * f * m), 4) as g_flat_mask, round(sum(w * f * q), 4) as g_flat_quant, round(sum(w * m * m), 4) as g_mask_mask,
        round(sum(w * m * q), 4) as g_mask_quant, round(sum(w * q * q), 4) as g_quant_quant, round(sum(f), 4) as r_flat, round(sum(m), 4) as r_mask, round(sum(q), 4) as r_quant, true as v_mask, true as v_quant from x group by 1""",
    "m7_folds": _sql(f", f as ({FOLDS}) select constant, model, full_ as \"full\", without, alone, round({ERR}, 6) as error_pct from f", pa=_POINTS, pb=_TPOINTS, pc=_VPOINTS),
    "m8_crossval_report": _sql(
        f""", f as ({FOLDS}), e as (select *, {ERR} as err from f)
        select constant, max(full_) as "full", count(err) as evaluated, arg_max(model, row(abs(err), model)) filter (err is not null) as worst_model, round(arg_max(err, row(abs(err), model)) filter (err is not null), 6) as worst_pct,
          coalesce(string_agg(model, ', ' order by model) filter (without is null), '') as load_bearing, count(err) > 0 as evaluable from e group by 1""",
        pa=_POINTS, pb=_TPOINTS, pc=_VPOINTS,
    ),
    "c1_fit_check": _cap(CHECK, "dev", "resv", "ask", "freed", slots=_slots_sql("least(free, room)")),
    "c1_fit_check_optimistic": _cap(CHECK, "dev", "resv", "ask", "freed", slots=_slots_sql("room")),
    "c6_shortfalls": _cap("select scenario, slot, needed_mib, available_mib from slots", "dev", "resv", "ask", "freed", slots=_slots_sql("least(free, room)")),
    "c2_c3_eviction_set": _cap(
        """, j as (select scenario, want_mib - free_mib as needed, c.service, c.mib, c.idle, c.priority as cp from ereq q join ecand c using (slot)
            where want_mib > free_mib and c.mib > 0 and (c.priority < q.priority or (c.idle and not (c.lifecycle = 'persistent' and q.lifecycle = 'on_demand')))),
        s as (select *, sum(mib) over (partition by scenario order by idle desc, cp, mib, service rows unbounded preceding) as freed, sum(mib) over (partition by scenario) as every from j)
        select scenario, service, mib, freed from s where every >= needed and freed - mib < needed""",
        "ereq", "ecand",
    ),
    "c4_overcommitted": _cap(
        "select distinct r.service, slot, p as pledged_mib, total_mib from resv r join (select slot, sum(mib) as p from resv group by 1) using (slot) join dev using (slot) where p + 512 > total_mib", "dev", "resv"
    ),
    "c5_contention": _cap(
        """, o as (select slot from (select slot, sum(mib) as p from resv group by 1) join dev using (slot) where p + 512 > total_mib),
        n as (select a.service, min(b.service) as peer from resv a join o using (slot) join resv b on b.slot = a.slot and b.service <> a.service and b.mib > 0 group by 1),
        s as (select service, coalesce(priority, 50) as p, coalesce(lifecycle, 'on_demand') as l from svc)
        select n.service, peer, case when x.p > y.p or (x.p = y.p and x.l = 'persistent' and y.l = 'on_demand') then 'evict_peer' else 'yield_self' end as verdict from n join s x on x.service = n.service join s y on y.service = n.peer""",
        "dev", "resv", "svc",
    ),
    "l8_best_device": _cap(
        """, x as (select request, slot, free_mib, coalesce(free_mib < prefer_mib, false) as short from choice join dev using (slot) where free_mib >= min_mib)
        select request, slot, free_mib as available_mib from x qualify row_number() over (partition by request order by short, free_mib desc, slot) = 1""",
        "dev", "choice",
    ),
    "j15_attributed_memory": f"""with recursive p as ({PROC.replace('{text}', 'varchar')}), reg as (select pid % 5 as service, pid from p where pid between 2 and 9),
      d as (select service, pid from reg union select d.service, p.pid from d join p on p.ppid = d.pid),
      a as (select service, pid from d union select s_suppkey % 5, p.pid from supplier join p on p.cgroup = 'grp' || cast(s_suppkey % 5 as varchar))
      select 0::bigint as tick, service, coalesce(sum(case when p.pid % 3 = 0 then p.pid * 1000 end), 0) as vram_bytes, sum(rss_total) as rss_total, sum(rss_owned) as rss_owned, sum(rss_file) as rss_file from a join p on p.pid = a.pid group by 2""",
}
