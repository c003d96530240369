"""Registered dataset-hygiene, pairing and audit queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.functions import records as R
from meterloom.functions import reduce as RD
from meterloom.operators import hygiene as H
from meterloom.operators import pairs as P
from meterloom.operators import telemetry as T
from meterloom.sources import bindings as B
from meterloom.sources import measurements as M

POS = M.POS_SQL
PROD = [f"prod-{i}" for i in range(6)]
LABELS_SQL = ", ".join(f"'{p}'" for p in PROD)


def sql(body: str, **extra: str) -> str:
    ctes = {"m": M.flat_sql(), **extra}
    return "with " + ", ".join(f"{n} as ({q})" for n, q in ctes.items()) + " " + body


def _m(fn):
    return lambda s, d: fn(M.measurements(s, d))


def _plan(s, d):
    """Planned cells: every part a supplier in an even nation could be asked about."""
    asked = B.table(s, d, "lineitem").select((F.col("l_partkey") + 200).alias("p"), "l_suppkey", "l_linenumber")
    return asked.select(
        F.concat(F.lit("c"), F.col("p").cast("string")).alias("cell"),
        F.concat(F.lit("q"), (F.col("l_suppkey") % 5).cast("string")).alias("question"),
    )


PLAN_SQL = "select 'c' || cast(l_partkey + 200 as varchar) as cell, 'q' || cast(l_suppkey % 5 as varchar) as question from lineitem"


def _merged(s, d):
    m = M.measurements(s, d)
    plans = m.select(
        R.factor("model").alias("model"), R.factor("ctx").alias("ctx"), R.factor("ubatch").alias("ubatch"), R.factor("kv_type").alias("kv_type"),
        F.concat(F.lit("q"), F.expr("pos.q % 6").cast("string")).alias("question"),
        F.struct(F.expr("pos.q % 6").alias("rank"), F.col("pos.p1").alias("p1")).alias("pos"),
    )
    return H.merge_plans(plans, ["model", "ctx", "ubatch", "kv_type"]).select("model", "ctx", "ubatch", "kv_type", "pos.p1", "purpose")


def _sizes(s, d):
    """A file listing: one row per shard of each model, sized from the orders."""
    return B.table(s, d, "orders").select(
        F.lit("/models").alias("folder"),
        F.concat(
            F.lit("m"), (F.col("o_custkey") % 40).cast("string"),
            F.when(F.col("o_custkey") % 4 != 0, F.format_string("-%05d-of-%05d", (F.col("o_orderkey") % 9 + 1).cast("int"), F.lit(9))).otherwise(F.lit("")),
            F.lit(".gguf"),
        ).alias("name"),
        F.round(F.col("o_totalprice")).cast("long").alias("bytes"),
    )


def _ordered(s, d):
    m = M.measurements(s, d)
    plan = m.select(*[R.factor(c).alias(c) for c in (
        "model", "runtime", "no_mmap", "rtr", "gpus", "split", "ngl", "spec_type", "draft", "mmproj", "ctx", "ubatch", "parallel", "kv_type",
        "flash_attn", "served", "bench")], "pos")
    sizes = m.groupBy(R.factor("model").alias("model")).agg(F.max(R.parsed("n_layer")).alias("bytes"))
    return H.plan_order(plan, sizes).select("model", "model_bytes", "gpus", "ctx", "ubatch", F.col("pos.p1").alias("p1"))


def _drift_rows(s, d):
    m = M.measurements(s, d).filter(R.gpu_used().isNotNull())
    predicted = F.col("rss.gpu_used_mib") + F.col("pos.cents") % 401 - 200
    return m.select(
        R.parsed("arch").alias("arch"), R.factor("label").alias("label"), R.factor("ctx").alias("context"),
        predicted.alias("predicted"), F.col("rss.gpu_used_mib").alias("measured"),
        RD.percent_error(predicted.cast("double"), F.col("rss.gpu_used_mib").cast("double")).alias("drift_pct"),
    )


DRIFT = """dr as (select arch, label, ctx as context, gpu_used + cents % 401 - 200 as predicted, gpu_used as measured,
  100.0::double * (gpu_used + cents % 401 - 200 - gpu_used) / gpu_used as drift_pct from m where coalesce(gpu_used, 0) <> 0)"""


def _predictions(s, d):
    """A predictions table: one row per cell, placed on some number of cards."""
    m = M.measurements(s, d)
    return m.groupBy("cell").agg(
        F.max(F.col("rss.gpu_used_mib")).alias("predicted_mib"), F.max(R.parsed("n_layer") % 2 + 1).alias("cards_placed")
    )


# Regimes to show the operators on: a column, the same in SQL, and the axes to be covered (`ub` is the batch with its default).
REGIMES = {
    **{f"context of {n // 1024}k": (R.factor, "ctx", n, ["parallel", "gpus"]) for n in (4096, 8192, 16384, 32768)},
    **{f"batches of {n}": (R.ubatch_or_default, "ub", n, ["ctx", "parallel"]) for n in (256, 1024, 2048)},
    "three cards": (R.factor, "gpus", "0,1,2", ["ctx", "concurrency"]),
    "attention left to the runtime": (R.factor, "flash_attn", "auto", ["ub", "ctx"]),
    "four at a time": (R.factor, "concurrency", 4, ["parallel", "ub"]),
    "long prompts": (R.factor, "probe_prompt_tokens", 8192, ["gpus", "ctx"]),
    "eagle drafts": (R.factor, "spec_type", "draft-eagle", ["gpus", "ub", "ctx"]),
}


def _regimes():
    named = lambda axes: ["ubatch" if a == "ub" else a for a in axes]
    return {n: ((column() if column is R.ubatch_or_default else column(name)) == value, named(axes)) for n, (column, name, value, axes) in REGIMES.items()}


def _reasons(known):
    """Why a record stays out of a comparison, the first that applies; `known`: the model is one we predict."""
    placed = F.concat(F.lit("layers placed by hand: "), R.factor("ngl").cast("string"))
    return [
        (~R.is_ok(), F.concat(F.lit("run ended "), F.col("status"))),
        (R.gpu_used().isNull(), "device memory not read"),
        (~R.factor("served"), "never served"),
        (~known, "model without a prediction"),
        (~R.fully_offloaded() & R.factor("n_cpu_moe").isNull(), placed),
        (R.factor("embeddings"), "embeds only"),
    ]


def _validation(s, d):
    from meterloom.operators.report import validation_report

    return validation_report(M.measurements(s, d), _predictions(s, d), _reasons(R.factor("model").contains("-0")))


def _twins_fa(s, d):
    m = M.measurements(s, d).filter(R.gpu_used().isNotNull())
    rows = m.select(*[R.factor(c).alias(c) for c in ("model", "ctx", "split", "kv_type", "gpus")], R.factor("flash_attn").alias("fa"), R.gpu_used().alias("used"), "pos")
    keys = ["model", "ctx", "split", "kv_type", "gpus"]
    return P.pair_twins(rows, keys, F.col("fa"), "off", "on", F.col("used"), "pos", "first")


def _twins_kv(s, d):
    m = M.measurements(s, d).filter(R.arena().isNotNull())
    rows = m.select(*[R.factor(c).alias(c) for c in ("model", "ctx", "ubatch", "split", "mmproj")], R.factor("kv_type").alias("kv"), R.gpu_used().alias("used"), "pos")
    return P.pair_twins(rows.filter("used is not null"), ["model", "ctx", "ubatch", "split", "mmproj"], F.col("kv"), "q8_0", "f16", F.col("used"), "pos", "last")


def _twins_median(s, d):
    m = M.measurements(s, d)
    rows = m.select(F.col("provenance.model_key").alias("model"), R.factor("ctx").alias("ctx"), R.split_or_layer().alias("split"), R.owned_mib().alias("owned"))
    return P.pair_medians(rows, ["model", "ctx"], "split", "tensor", "layer", "owned")


def _twins_sitting(s, d):
    m = M.measurements(s, d).filter(R.gpu_used().isNotNull())
    rows = m.select(F.col("provenance.model_key").alias("model"), R.factor("gpus").alias("gpus"), R.factor("mmproj").alias("mmproj"), F.year(F.timestamp_millis(R.measured_ms())).alias("year"),
                    F.month(F.timestamp_millis(R.measured_ms())).alias("month"), R.has_spec().alias("spec"), F.struct(R.gpu_used().alias("used"), R.measured_ms().alias("at")).alias("v"), "pos")
    out = P.pair_twins(rows, ["model", "gpus", "mmproj", "year", "month"], F.col("spec"), True, False, F.col("v"), "pos", "last")
    out = P.same_sitting(out.select("model", "gpus", "mmproj", "year", "month", F.col("a.used").alias("on_used"), F.col("a.at").alias("on_at"), F.col("b.used").alias("off_used"), F.col("b.at").alias("off_at")), "on_at", "off_at", 15 * 86_400_000)
    return out.withColumn("delta", F.col("on_used") - F.col("off_used")).filter("delta > 0")


def _twins_max(s, d):
    m = M.measurements(s, d)
    rows = m.select(R.variant().alias("variant"), R.factor("ctx").alias("ctx"), R.factor("gpus").alias("gpus"), (R.factor("probe_prompt_tokens") >= R.CHECKPOINT_STEP).alias("steady"), R.owned_mib().alias("owned"), "pos")
    return P.pair_twins(rows, ["variant", "ctx", "gpus"], F.col("steady"), True, False, F.col("owned"), "pos", "max")


def _twins_cards(s, d):
    m = M.measurements(s, d).filter(R.factor("label").startswith("devices-") & (R.factor("ngl") == 0))
    rows = m.select(F.col("provenance.model_key").alias("model"), R.cards_or(0).alias("cards"), R.owned_mib().alias("owned"), "pos")
    return P.pair_twins(rows, ["model"], F.col("cards"), 1, 2, F.col("owned"), "pos", "last")


def _lookup(s, d):
    m = M.measurements(s, d)
    rates = m.filter(R.parsed("arch").isin("qwen3", "laguna", "llama")).groupBy(R.parsed("arch").alias("key")).agg(F.max(R.parsed("n_layer")).alias("value"))
    default = P.worst_rate(rates)
    return P.rate_lookup(m.select("cell", R.parsed("arch").alias("arch")), F.col("arch"), rates, default).groupBy("arch", "rate").count()


def _coefficients(s, d):
    m = M.measurements(s, d)
    rows = m.select(R.factor("runtime").alias("runtime"), R.split_or_layer().alias("split"), R.parsed("arch").alias("arch"),
                    F.when(R.parsed("per_layer_token_embd"), F.lit("e")).alias("variant"), R.tokens().cast("double").alias("tokens"))
    entries = m.groupBy(F.when(R.is_ik(), F.lit("ik")).alias("runtime"), R.split_or_layer().alias("split"), R.parsed("arch").alias("arch"), F.lit(None).cast("string").alias("variant")).agg(
        F.struct(F.max(R.parsed("n_layer")).cast("double").alias("flat")).alias("coefficients")
    ).filter("arch in ('qwen3', 'gemma4', 'laguna') and (runtime is not null or split = 'layer')")
    out = P.coefficient_lookup(rows, entries, {"flat": 7.0})
    return out.groupBy("runtime", "split", "arch", "variant", "tier", F.col("coefficients.flat").alias("flat")).count()


def _weights_equal(s, d):
    m = M.measurements(s, d)
    rows = m.select(F.col("provenance.model_key").alias("model"), R.factor("gpus").alias("gpus"), R.factor("split").alias("split"), R.factor("kv_type").alias("kv"), R.resident_weights().alias("w"), "pos")
    pairs = P.pair_twins(rows, ["model", "gpus", "split"], F.col("kv"), "q8_0", "f16", F.col("w"), "pos", "first")
    return pairs.withColumn("same", R.same_weights(F.col("a"), F.col("b")))


def _liveness(s, d):
    m = M.measurements(s, d)
    last = m.agg(F.max(R.measured_ms())).first()[0]
    return H.liveness(m, last + 31 * 60_000)


def _grid(s, d):
    axes = B.table(s, d, "lineitem").agg(F.collect_set("l_returnflag").alias("flag"), F.collect_set("l_linestatus").alias("status"), F.collect_set("l_linenumber").alias("line"))
    return H.factor_grid(axes, ["flag", "status", "line"])


def _trace(s, d):
    """Memory traces: one sample per event, two counters and one reading per card."""
    k = F.expr(B.SPARK_K)
    rows = B.table(s, d, "events").select(F.col("user_id").alias("cell"), F.struct(F.expr(B.SPARK_MS.format("ts")).alias("ms"), F.col("event_id").alias("id")).alias("t"), F.explode(F.array(
        F.struct(F.lit("rss_anon_kb").alias("counter"), (k * 1024).alias("value")), F.struct(F.lit("rss_file_kb").alias("counter"), F.floor("value").cast("long").alias("value")),
        F.struct(F.concat(F.lit("gpu"), (F.col("event_id") % 2).cast("string"), F.lit("_used_mib")).alias("counter"), F.when(F.col("event_type") == "view", k * 8).alias("value")),
    )).alias("c")).select("cell", "t", "c.*")
    finals = B.table(s, d, "customer").select((F.col("c_custkey") % 400).alias("cell"), F.lit("rss_anon_kb").alias("counter"), "c_acctbal").groupBy("cell", "counter").agg(F.max(F.floor("c_acctbal")).cast("long").alias("value"))
    return H.trace_summary(rows, finals)


DEFAULTS = {"ctx": 32768, "ubatch": 512, "parallel": 1, "ngl": 99, "split": None, "kv_type": "f16", "kv_unified": False, "flash_attn": "on", "gpus": "0", "runtime": "mainline", "model": "", "n_cpu_moe": None}


def _headroom(s, d):
    m = M.measurements(s, d)
    rows = m.select(R.parsed("arch").alias("architecture"), R.factor("ctx").alias("context"), (F.col("rss.gpu_used_mib") - F.col("pos.cents") % 700).alias("predicted"),
                    F.coalesce(F.col("rss.gpu_used_mib"), F.lit(0)).alias("actual"))
    return H.headroom_line(rows.withColumn("predicted", F.coalesce("predicted", F.lit(0)))).withColumn("worst_pct", F.round("worst_pct", 6))


def _group_order(s, d):
    from meterloom.operators.report import group_order

    m = M.measurements(s, d)
    return group_order(m.select(R.factor("runtime").alias("runtime"), R.split_or_layer().alias("split"), R.parsed("arch").alias("arch"), F.when(R.parsed("per_layer_token_embd"), F.lit("e")).alias("variant")))


def _scoreboard(s, d):
    from meterloom.operators.report import scoreboard

    m = M.measurements(s, d)
    predicted = m.filter(R.factor("label").startswith("prod-")).groupBy(F.regexp_extract(R.factor("label"), r"^(prod-\d+)", 1).alias("label")).agg(F.max("rss.gpu_used_mib").alias("predicted_mib"))
    return scoreboard(m, predicted, PROD + ["prod-99"])


QUERIES = {
    "w1_latest_per_cell": lambda s, d: H.latest_measurement(M.measurements(s, d)).select("cell", "status", F.col("pos.p1").alias("p1"), F.col("pos.cents").alias("cents")),
    "w2_first_per_configuration": lambda s, d: H.first_per_configuration(
        M.measurements(s, d).select(*[R.factor(c).alias(c) for c in R.CONFIGURATION], "pos", "cell"), R.CONFIGURATION, "pos"
    ).select("model", "runtime", "gpus", "ctx", "split", "mmproj", "cell", "duplicates"),
    "w20_production_readings": _m(lambda m: H.production_readings(m, PROD)),
    "f4_usable": _m(lambda m: H.usable(m).groupBy("status").count()),
    "f5_factor_columns": _m(lambda m: m.select(
        "cell", R.split_or_layer().alias("split"), R.cards_or(1).alias("cards"), R.cards_nonempty().alias("cards_nonempty"), R.tokens().alias("tokens"),
        R.ubatch_or_default().alias("ubatch"), R.flash_on().alias("fa_on"), R.flash_off().alias("fa_off"), R.charged_unfused().alias("unfused"), R.mask_width().alias("width"),
        R.kv_quantised().alias("quantised"), R.fully_offloaded().alias("offloaded"), R.is_hybrid().alias("hybrid"), R.has_spec().alias("spec"), R.is_ik().alias("ik"), F.col("pos.cents").alias("cents"))),
    "f6_readings": _m(lambda m: m.select(
        "cell", F.col("pos.cents").alias("cents"), R.owned_bytes().alias("owned_bytes"), R.owned_mib().alias("owned_mib"), R.card_used(F.lit(0)).alias("card0"), R.cards_measured().alias("cards_measured"))),
    "f11_skip_reasons": _m(lambda m: H.skip_counts(m, _reasons(R.factor("model").contains("-0")))),
    "f12_regime_members": _m(lambda m: H.regime_members(m, _regimes())),
    "f10_label_filter": _m(lambda m: H.label_filter(m.select("cell", R.factor("label").alias("label"), F.col("pos.cents").alias("cents")), "prod-")),
    "a19_trace_summary": _trace,
    "f13_query_heads": _m(lambda m: m.groupBy(R.parsed("arch").alias("arch"), R.query_heads().alias("heads")).count()),
    "f14_keys": _m(lambda m: m.groupBy(R.file_name(R.factor("model")).alias("file"), R.variant().alias("variant"), R.variant_environment().alias("environment"), R.arch_cards().alias("arch_cards")).count()),
    "j4_twins_first": _twins_fa,
    "j5_twins_last": _twins_kv,
    "j6_twin_medians": _twins_median,
    "j7_twins_same_sitting": _twins_sitting,
    "j8_twins_max": _twins_max,
    "j9_twins_by_cards": _twins_cards,
    "j10_retirable_builds": _m(lambda m: H.retirable_builds(m, 0.6)),
    "j11_retired_rows": _m(lambda m: H.retire(m, H.retirable_builds(m, 0.6)).groupBy("status").count()),
    "j12_rate_lookup": _lookup,
    "j13_coefficient_lookup": _coefficients,
    "j14_plan_progress": lambda s, d: H.plan_progress(_plan(s, d), H.membership(M.measurements(s, d))),
    "j19_equal_weights": _weights_equal,
    "u1_merged_plans": _merged,
    "u2_outstanding": lambda s, d: H.outstanding(_plan(s, d).select("cell").distinct(), H.membership(M.measurements(s, d))),
    "u5_factor_grid": _grid,
    "u6_repeats": lambda s, d: H.with_repeats(B.table(s, d, "orders").select("o_orderkey"), 3),
    "s6_membership": _m(H.membership),
    "a13_medians": lambda s, d: RD.medians(B.table(s, d, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long")), ["l_returnflag", "l_linestatus"], "cents").select("l_returnflag", "l_linestatus", "n", "median"),
    "a14_drift_summary": lambda s, d: H.drift_summary(_drift_rows(s, d), "drift_pct", 2.0).select("n", F.round("mean", 6).alias("mean"), F.round("lowest", 9).alias("lowest"), F.round("highest", 9).alias("highest"), "outside", F.round("upper_median", 9).alias("upper_median")),
    "a15_consensus": _m(lambda m: RD.consensus(m.select(R.parsed("arch").alias("arch"), R.factor("ctx").alias("ctx"), R.owned_mib().alias("owned")), ["arch", "ctx"], "owned", 0.6).drop("spread")),
    "a16_guarded_max": _m(lambda m: RD.guarded_max(m.select(R.parsed("arch").alias("arch"), (F.col("pos.cents") % 100_000 * F.when(F.col("pos.q") == 50, 9).otherwise(1)).alias("v")), ["arch"], "v", 1.05).drop("runner_up")),
    "a17_worst_clamped": _m(lambda m: m.groupBy(R.parsed("arch").alias("arch")).agg(RD.worst_clamped((F.col("pos.cents") % 1000 - 1200) / F.lit(4.0) + F.col("pos.q")).alias("worst"))),
    "a18_half_even": lambda s, d: B.table(s, d, "lineitem").select("l_quantity", "l_partkey").groupBy(RD.half_even((F.col("l_quantity") - 25) / F.lit(2.0)).alias("rounded"), RD.tenths_half_even(F.col("l_quantity") / F.lit(4.0)).alias("tenths")).count(),
    "a20_stale_builds": _m(H.stale_builds),
    "a21_build_disagreements": _m(lambda m: H.build_disagreements(m, 0.2)),
    "a22_coverage": _m(lambda m: H.coverage(m, _regimes())),
    "a23_question_progress": lambda s, d: H.question_progress(_plan(s, d), M.measurements(s, d)),
    "a24_liveness": _liveness,
    "a25_headroom_line": _headroom,
    "a27_shard_sizes": lambda s, d: H.shard_sizes(_sizes(s, d)),
    "a28_evidence": _m(lambda m: T.evidence_per_group(m.groupBy(R.parsed("arch").alias("arch"), R.factor("ctx").alias("ctx")).agg(F.max("rss.gpu_used_mib").alias("worst")), ["arch"], "ctx", F.format_string("ctx%d %d MiB", F.col("ctx"), F.col("worst")))),
    "a29_distinct_models": _m(lambda m: m.select(R.file_name(R.factor("model")).alias("model")).distinct().orderBy("model")),
    "a30_band_check": _m(lambda m: H.band_check(m.select(F.col("rss.gpu_used_mib").alias("o"), (F.expr("pos.cents % 9000") + 3000).alias("p")), "o", "p").select("checked", "outside", F.round("lowest", 9).alias("lowest"), F.round("highest", 9).alias("highest"))),
    "a30_shortfall_check": _m(lambda m: H.shortfall_check(m.select((F.expr("pos.cents % 900") + 5000).alias("r"), F.col("rss.gpu_used_mib").alias("u")), "r", "u").select("checked", "beyond", F.round("worst", 9).alias("worst"))),
    "a31_inert_factor": _m(lambda m: H.inert_factor(m.filter(R.factor("label").startswith("threads")).select(R.factor("model").alias("model"), R.factor("ctx").alias("ctx"), F.col("pos.q").alias("threads"), R.parsed("arena_mib").alias("arena")), ["model", "ctx"], "threads", "arena").withColumn("moved", F.round("moved", 6))),
    "l5_plan_order": _ordered,
    "l6_group_order": _group_order,
    "l7_validation_listing": lambda s, d: _validation(s, d).orderBy("drift_pct").select("label", "predicted_mib", "measured_mib", F.round("drift_pct", 9).alias("drift_pct")),
    "m9_validation_report": lambda s, d: _validation(s, d).groupBy("arch").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs("drift_pct")), 9).alias("worst")),
    "m10_scoreboard": _scoreboard,
    "x4_cell_ids": _m(lambda m: m.groupBy(H_cell()).count().groupBy("count").agg(F.count(F.lit(1)).alias("cells"))),
    "x18_percent_error": lambda s, d: _drift_rows(s, d).groupBy("arch").agg(F.round(F.max("drift_pct"), 9).alias("worst")),
}


def H_cell():
    return R.cell_id("factors", DEFAULTS).alias("id")


CONF = "stem, runtime, gpus, ctx, ubatch, parallel, ngl, split, kv_type, kv_unified, flash_attn, n_cpu_moe, mmproj, draft, spec_type, no_mmap, rtr, concurrency, probe_prompt_tokens, embeddings, bench, served, ik and sparse"
REASON = """case when status <> 'ok' then 'run ended ' || status when coalesce(gpu_used, 0) = 0 then 'device memory not read' when not served then 'never served'
  when not contains(stem, '-0') then 'model without a prediction' when ngl <> 99 and n_cpu_moe is null then 'layers placed by hand: ' || cast(ngl as varchar) when embeddings then 'embeds only' end"""
ENV = "variant || case when ik then '@ik' else '' end || case when flash_attn <> 'on' then '@nofa' else '' end"
CARDS1 = "case when gpus = '' then 1 else n_cards end"
REGIME_SQL = {n: (f"{name} = '{value}'" if isinstance(value, str) else f"{name} = {value}", axes) for n, (_, name, value, axes) in REGIMES.items()}


def _coverage_sql() -> str:
    parts = []
    for name, (rule, axes) in REGIME_SQL.items():
        points = [f"count(distinct {a})" for a in axes]
        names = ["ubatch" if a == "ub" else a for a in axes]
        least = f"least({', '.join(points)})"
        pick = "case " + " ".join(f"when {p} = {least} then '{n}'" for p, n in zip(points, names)) + " end"
        parts.append(
            f"select '{name}' as regime, count(*) as cells, {least} as points, case when count(*) = 0 then 'never measured' else {pick} end as thinnest, count(*) > 0 and {least} < 2 as thin from m where status = 'ok' and arena_mib > 0 and {rule}"
        )
    return " union all ".join(parts)


def _agg_last(value: str, at: str = POS) -> str:
    return f"arg_max({value}, row({at}))"


VALID = f""", c as (select cell, max(gpu_used) as predicted, max(n_layer % 2 + 1) as placed from m group by 1),
  k as (select *, {REASON} as reason from m),
  f as (select * from k where reason is null qualify row_number() over (partition by {CONF} order by {POS}) = 1),
  v as (select f.label, f.arch, c.predicted as predicted_mib, f.gpu_used as measured_mib, 100.0::double * (c.predicted - f.gpu_used) / f.gpu_used as drift_pct,
     case when f.n_cards > 0 and f.card_used > 0 then f.n_cards else 0 end as measured_cards, placed from f join c on c.cell = f.cell where c.predicted > 0),
  vv as (select * from v where measured_cards = 0 or measured_cards = placed) """

ORACLE = {
    "w1_latest_per_cell": sql(f"select cell, status, p1, cents from m qualify row_number() over (partition by cell order by measured_ms desc, {POS}) = 1"),
    "w2_first_per_configuration": sql(
        f"""select '/models/' || stem || '.gguf' as model, runtime, gpus, ctx, split, mmproj, cell, duplicates from (
        select *, count(*) over (partition by {CONF}) - 1 as duplicates, row_number() over (partition by {CONF} order by {POS}) as rn from m) where rn = 1"""
    ),
    "w20_production_readings": sql(
        f"""select label, used, at_ms as "at" from (select l as label, gpu_used as used, measured_ms as at_ms, row_number() over (partition by l order by measured_ms desc, {POS}) as rn
        from (select *, unnest([label, regexp_extract(label, '^(.*)-[^-]*$', 1)]) as l from m where status = 'ok' and label like 'prod-%' and gpu_used is not null) where l in ({LABELS_SQL})) where rn = 1"""
    ),
    "f4_usable": sql("select status, count(*) as count from m where status = 'ok' group by 1"),
    "f5_factor_columns": sql(
        f"""select cell, split_l as split, {CARDS1} as cards, greatest(n_cards, 1) as cards_nonempty, tokens, ub as ubatch, flash_attn = 'on' as fa_on, flash_attn = 'off' as fa_off,
        flash_attn <> 'on' as unfused, width, kv_type = 'q8_0' as quantised, ngl = 99 as offloaded, hybrid, spec, ik, cents from m"""
    ),
    "f6_readings": sql(
        """select cell, cents, (anon_kb + shmem_kb) * 1024 as owned_bytes, (anon_kb + shmem_kb) // 1024 as owned_mib,
        case when n_cards > 0 then nullif(card_used, 0) end as card0, case when card_used > 0 then n_cards else 0 end as cards_measured from m"""
    ),
    "f11_skip_reasons": sql(
        f""", r as (select *, {REASON} as reason from m) select reason, count(*) as count from r where reason is not null group by 1
        union all select 'duplicate configuration', sum(n - 1) from (select count(*) as n from r where reason is null group by {CONF}) having sum(n - 1) > 0"""
    ),
    "f12_regime_members": sql(" union all ".join(f"select '{n}' as regime, count(*) as count from m where {r} having count(*) > 0" for n, (r, _) in REGIME_SQL.items())),
    "f10_label_filter": sql("select cell, label, cents from m where contains(label, 'prod-')"),
    "a19_trace_summary": f"""with t as (select user_id as cell, {B.ANSI_MS.format('ts')} as ms, event_id as id, {B.ANSI_K} as k, value as v, event_type from events),
      l as (select cell, ms, id, 'rss_anon_kb' as counter, k * 1024 as value from t union all select cell, ms, id, 'rss_file_kb', cast(floor(v) as bigint) from t
        union all select cell, ms, id, 'gpu' || cast(id % 2 as varchar) || '_used_mib', case when event_type = 'view' then k * 8 end from t),
      s as (select cell, counter, max(value) as pk, arg_min(value, row(ms, id)) filter (value is not null) as fi, arg_max(value, row(ms, id)) filter (value is not null) as la, count(value) as n from l group by 1, 2),
      f as (select c_custkey % 400 as cell, 'rss_anon_kb' as counter, cast(max(floor(c_acctbal)) as bigint) as fin from customer group by 1)
      select coalesce(s.cell, f.cell) as cell, coalesce(s.counter, f.counter) as counter, coalesce(pk, fin) as peak, fi as "first", la as "last", fin as final, coalesce(pk - fi, 0) as growth, coalesce(n, 0) as samples
      from s full join f on f.cell = s.cell and f.counter = s.counter""",
    "f13_query_heads": sql(
        """select arch, case when n_head <> 0 then n_head else greatest(n_embd // 128, 0) end as heads, count(*) as count from m group by 1, 2"""
    ),
    "f14_keys": sql(f"select stem || '.gguf' as file, variant, {ENV} as environment, arch || '@' || cast({CARDS1} as varchar) as arch_cards, count(*) as count from m group by 1, 2, 3, 4"),
    "j4_twins_first": sql(
        f"""select '/models/' || stem || '.gguf' as model, ctx, split, kv_type, gpus, arg_min(gpu_used, row({POS})) filter (flash_attn = 'off') as a, arg_min(gpu_used, row({POS})) filter (flash_attn = 'on') as b
        from m where gpu_used <> 0 group by 1, 2, 3, 4, 5 having a is not null and b is not null"""
    ),
    "j5_twins_last": sql(
        f"""select '/models/' || stem || '.gguf' as model, ctx, ubatch, split, mmproj, arg_max(gpu_used, row({POS})) filter (kv_type = 'q8_0') as a, arg_max(gpu_used, row({POS})) filter (kv_type = 'f16') as b
        from m where gpu_used <> 0 and arena_mib <> 0 group by 1, 2, 3, 4, 5 having a is not null and b is not null"""
    ),
    "j6_twin_medians": sql(
        """select 'org/' || stem as model, ctx, median((anon_kb + shmem_kb) // 1024) filter (split_l = 'tensor') as a, median((anon_kb + shmem_kb) // 1024) filter (split_l = 'layer') as b
        from m group by 1, 2 having a is not null and b is not null"""
    ),
    "j7_twins_same_sitting": sql(
        f""", g as (select 'org/' || stem as model, gpus, mmproj, year(make_timestamp(measured_ms * 1000)) as year, month(make_timestamp(measured_ms * 1000)) as month,
          arg_max(gpu_used, row({POS})) filter (spec) as on_used, arg_max(measured_ms, row({POS})) filter (spec) as on_at,
          arg_max(gpu_used, row({POS})) filter (not spec) as off_used, arg_max(measured_ms, row({POS})) filter (not spec) as off_at from m where gpu_used <> 0 group by 1, 2, 3, 4, 5)
        select *, on_used - off_used as delta from g where on_used > off_used and abs(on_at - off_at) <= 15 * 86400000::bigint"""
    ),
    "j8_twins_max": sql(
        """select variant, ctx, gpus, max((anon_kb + shmem_kb) // 1024) filter (probe_prompt_tokens >= 8192) as a, max((anon_kb + shmem_kb) // 1024) filter (probe_prompt_tokens < 8192) as b
        from m group by 1, 2, 3 having a is not null and b is not null"""
    ),
    "j9_twins_by_cards": sql(
        f"""select 'org/' || stem as model, arg_max((anon_kb + shmem_kb) // 1024, row({POS})) filter (n_cards = 1) as a, arg_max((anon_kb + shmem_kb) // 1024, row({POS})) filter (n_cards = 2) as b
        from m where label like 'devices-%' and ngl = 0 group by 1 having a is not null and b is not null"""
    ),
    "j10_retirable_builds": sql(
        f""", l as (select arch, cell, build, arg_max(gpu_used, row({POS}))::double as used, arg_max(measured_ms, row({POS})) as t from m where status = 'ok' and gpu_used <> 0 group by 1, 2, 3)
        select distinct a.arch, a.build from l a join l b on a.arch = b.arch and a.cell = b.cell and a.build <> b.build and a.t < b.t where abs(b.used - a.used) / a.used > 0.6"""
    ),
    "j11_retired_rows": sql(
        f""", l as (select arch, cell, build, arg_max(gpu_used, row({POS}))::double as used, arg_max(measured_ms, row({POS})) as t from m where status = 'ok' and gpu_used <> 0 group by 1, 2, 3),
        s as (select distinct a.arch, a.build from l a join l b on a.arch = b.arch and a.cell = b.cell and a.build <> b.build and a.t < b.t where abs(b.used - a.used) / a.used > 0.6)
        select case when status = 'ok' and s.arch is not null then 'stale-runtime' else status end as status, count(*) as count from m left join s on s.arch = m.arch and s.build = m.build group by 1"""
    ),
    "j12_rate_lookup": sql(
        """, r as (select arch, max(n_layer) as v from m where arch in ('qwen3', 'laguna', 'llama') group by 1)
        select m.arch, coalesce(v, (select max(v) from r)) as rate, count(*) as count from m left join r on r.arch = m.arch group by 1, 2"""
    ),
    "j13_coefficient_lookup": sql(
        """, e as (select case when ik then 'ik' end as rt, split_l, arch, max(n_layer)::double as flat from m where arch in ('qwen3', 'gemma4', 'laguna') and (ik or split_l = 'layer') group by 1, 2, 3)
        select runtime, m.split_l as split, m.arch, case when per_layer then 'e' end as variant, case when o.flat is not null then 'runtime' when h.flat is not null then 'shared' else 'default' end as tier,
          coalesce(o.flat, h.flat, 7.0) as flat, count(*) as count from m
        left join e o on o.rt = 'ik' and ik and o.arch = m.arch and o.split_l = m.split_l and not per_layer
        left join e h on h.rt is null and h.arch = m.arch and h.split_l = m.split_l and not per_layer group by all"""
    ),
    "j14_plan_progress": sql(
        """, d as (select distinct cell from m where status = 'ok'), p as (select distinct cell from plan)
        select coalesce(p.cell, d.cell) as cell, case when p.cell is null then 'unplanned' when d.cell is null then 'outstanding' else 'measured' end as state from p full join d on p.cell = d.cell""",
        plan=PLAN_SQL,
    ),
    "j19_equal_weights": sql(
        f""", w as (select *, case when has_table then (case when fused then 1 else n_cards end) * dev_model else weights_mib end::double as w from m),
        g as (select 'org/' || stem as model, gpus, split, arg_min(w, row({POS})) filter (kv_type = 'q8_0') as a, arg_min(w, row({POS})) filter (kv_type = 'f16') as b from w group by 1, 2, 3)
        select *, a = 0 or b = 0 or abs(a - b) / nullif(greatest(a, b), 0) <= 0.01 as same from g where a is not null and b is not null"""
    ),
    "u1_merged_plans": sql(
        """, t as (select '/models/' || stem || '.gguf' as model, ctx, ubatch, kv_type, q % 6 as rank, min(p1) as p1 from m group by 1, 2, 3, 4, 5)
        select model, ctx, ubatch, kv_type, arg_min(p1, rank) as p1, list('q' || cast(rank as varchar) order by rank) as purpose from t group by 1, 2, 3, 4"""
    ),
    "u2_outstanding": sql("select distinct cell from plan where cell not in (select cell from m where status = 'ok')", plan=PLAN_SQL),
    "u5_factor_grid": """select flag, status, line from (select distinct l_returnflag as flag from lineitem), (select distinct l_linestatus as status from lineitem), (select distinct l_linenumber as line from lineitem)""",
    "u6_repeats": "select o_orderkey, unnest([0, 1, 2]) as repeat from orders",
    "s6_membership": sql("select distinct cell from m where status = 'ok'"),
    "a13_medians": "select l_returnflag, l_linestatus, count(*) as n, median(cast(round(l_extendedprice * 100) as bigint)) as median from lineitem group by 1, 2",
    "a14_drift_summary": sql(
        "select count(*) as n, round(avg(drift_pct), 6) as mean, round(min(drift_pct), 9) as lowest, round(max(drift_pct), 9) as highest, sum(case when abs(drift_pct) > 2 then 1 else 0 end) as outside, round(list_sort(list(drift_pct))[count(*) // 2 + 1], 9) as upper_median from dr",
        dr=DRIFT[len("dr as ("):-1],
    ),
    "a15_consensus": sql(
        """, g as (select arch, ctx, count(*) as n, min((anon_kb + shmem_kb) // 1024) as lowest, max((anon_kb + shmem_kb) // 1024) as highest, median((anon_kb + shmem_kb) // 1024) as median from m group by 1, 2)
        select *, case when highest - lowest <= 0 or median = 0 or (highest - lowest) / abs(median) <= 0.6 then 'ok' else 'disagree' end as status from g"""
    ),
    "a16_guarded_max": sql(
        """, x as (select arch, cents % 100000 * case when q = 50 then 9 else 1 end as v from m), r as (select *, row_number() over (partition by arch order by v desc) as rn, count(*) over (partition by arch) as n from x)
        select arch, any_value(n) as n, max(v) as top, case when any_value(n) >= 3 and min(v) > 0 and max(v)::double / min(v) > 1.05 then 'outlier' else 'ok' end as status from r where rn <= 2 group by 1"""
    ),
    "a17_worst_clamped": sql("select arch, greatest(cast(round_even(max((cents % 1000 - 1200) / 4.0::double + q), 0) as bigint), 0) as worst from m group by 1"),
    "a18_half_even": "select cast(round_even((l_quantity - 25) / 2.0::double, 0) as bigint) as rounded, cast(round_even(l_quantity / 4.0::double * 10.0::double, 0) as bigint) as tenths, count(*) as count from lineitem group by 1, 2",
    "a20_stale_builds": sql(
        """, b as (select runtime, build, count(*) as n, max(measured_ms) as t from m where status = 'ok' group by 1, 2)
        select runtime, arg_max(build, row(t, build)) as newest, sum(n) - arg_max(n, row(t, build)) as stale, sum(n) as total from b group by 1 having count(*) >= 2"""
    ),
    "a21_build_disagreements": sql(
        f""", l as (select cell, build, arg_max(gpu_used, row({POS})) as used from m where status = 'ok' and gpu_used <> 0 group by 1, 2)
        select cell, count(*) as builds, min(used) as low, max(used) as high from l group by 1 having count(*) >= 2 and (max(used) - min(used))::double / min(used) > 0.2"""
    ),
    "a22_coverage": sql(_coverage_sql()),
    "a23_question_progress": sql(
        f""", b as (select cell, case when bool_or(status = 'ok') then 'ok' else arg_min(status, row({POS})) end as status from m group by 1),
        c as (select question, status, count(*) as n from (select distinct question, cell from plan) p left join b using (cell) group by 1, 2)
        select question, sum(n) as planned, coalesce(sum(n) filter (status = 'ok'), 0) as measured,
          coalesce(string_agg(cast(n as varchar) || 'x ' || status, ', ' order by n desc, status) filter (status <> 'ok'), '') as issues from c group by 1""",
        plan=PLAN_SQL,
    ),
    "a24_liveness": sql("select max(measured_ms) as last_ms, 31 as idle_minutes, 'running' as state from m"),
    "a25_headroom_line": sql(
        """, e as (select arch, ctx, gpu_used - (gpu_used - cents % 700) as delta, gpu_used from m where arch <> '' and coalesce(gpu_used, 0) <> 0),
        p as (select arch, ctx, max(delta) as worst, max(100.0::double * delta / gpu_used) as pct from e group by 1, 2),
        g as (select arch, count(*) as contexts, max(worst) as worst_mib, round(max(pct), 6) as worst_pct, min(ctx) as x0, max(ctx) as x1, arg_min(worst, ctx) as y0, arg_max(worst, ctx) as y1 from p group by 1),
        s as (select *, (y1 - y0)::double / nullif((x1 - x0) / 1024.0::double, 0) as sl from g)
        select arch, contexts, worst_mib, worst_pct, trunc(y0 - sl * (x0 / 1024.0::double) + 64)::bigint as base_mib, trunc(sl + 0.5)::bigint as slope_mib_per_1k from s"""
    ),
    "a27_shard_sizes": """select '/models' as folder, 'm' || cast(o_custkey % 40 as varchar) || '.gguf' as model, sum(cast(round(o_totalprice) as bigint)) as bytes, count(*) as shards from orders group by 1, 2""",
    "a28_evidence": sql(
        """, g as (select arch, ctx, max(gpu_used) as worst from m group by 1, 2)
        select arch, count(*) as n, string_agg('ctx' || cast(ctx as varchar) || ' ' || cast(worst as varchar) || ' MiB', ', ' order by ctx) as evidence from g group by 1"""
    ),
    "a29_distinct_models": sql("select distinct stem || '.gguf' as model from m"),
    "a30_band_check": sql(
        """, r as (select gpu_used::double / (cents % 9000 + 3000) as x from m where gpu_used > 0)
        select count(*) as checked, sum(case when x between 0.8 and 1.5 then 0 else 1 end) as outside, round(min(x), 9) as lowest, round(max(x), 9) as highest from r"""
    ),
    "a30_shortfall_check": sql(
        """, r as (select greatest(1.0 - (cents % 900 + 5000) / gpu_used::double, 0) as x from m where gpu_used > 0)
        select count(*) as checked, sum(case when x > 0.13 then 1 else 0 end) as beyond, round(max(x), 9) as worst from r"""
    ),
    "a31_inert_factor": sql(
        """select '/models/' || stem || '.gguf' as model, ctx, count(*) as n, round(max(arena_mib) - min(arena_mib), 6) as moved, max(arena_mib) - min(arena_mib) < 0.01 as inert
        from m where label like 'threads%' group by 1, 2 having min(q) <> max(q)"""
    ),
    "l5_plan_order": sql(
        """, z as (select stem, max(n_layer) as b from m group by 1) select '/models/' || stem || '.gguf' as model, b as model_bytes, gpus, ctx, ubatch, p1 from m join z using (stem)"""
    ),
    "l6_group_order": sql("select runtime, split_l as split, arch, case when per_layer then 'e' end as variant, count(*) as n from m group by all"),
    "l7_validation_listing": sql(VALID + "select label, predicted_mib, measured_mib, round(drift_pct, 9) as drift_pct from vv"),
    "m9_validation_report": sql(VALID + "select arch, count(*) as n, round(max(abs(drift_pct)), 9) as worst from vv group by 1"),
    "m10_scoreboard": sql(
        f""", p as (select regexp_extract(label, '^(prod-\\d+)', 1) as label, max(gpu_used) as predicted_mib from m where label like 'prod-%' group by 1),
        w as (select label, used from (select l as label, gpu_used as used, row_number() over (partition by l order by measured_ms desc, {POS}) as rn
          from (select *, unnest([label, regexp_extract(label, '^(.*)-[^-]*$', 1)]) as l from m where status = 'ok' and label like 'prod-%' and gpu_used is not null) where l in ({LABELS_SQL})) where rn = 1)
        select l as label, predicted_mib, used as measured_mib, round(case when used <> 0 then 100.0::double * (predicted_mib - used) / used end, 6) as drift_pct,
          case when used is null or predicted_mib is null or used = 0 then 'missing' when abs(100.0::double * (predicted_mib - used) / used) <= 5 then 'ok' else 'outside' end as state
        from (select unnest([{LABELS_SQL}, 'prod-99']) as l) left join p on p.label = l left join w on w.label = l"""
    ),
    "x4_cell_ids": sql(
        """select n as count, count(*) as cells from (select count(*) as n from m group by ctx, ubatch, parallel, ngl, split, kv_type, kv_unified, flash_attn, gpus, runtime, stem, n_cpu_moe) group by 1"""
    ),
    "x18_percent_error": sql("select arch, round(max(drift_pct), 9) as worst from dr group by 1", dr=DRIFT[len("dr as ("):-1]),
}
