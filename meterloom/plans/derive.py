"""Constants derived from measurement records.

Each job reduces records to `key, value, n, status`: one row per key of a rate
table, or one row for a single constant. A refusal is a status, never an
exception. Results hold one row per architecture-sized key, so they are small
by construction while every reduction before them is map-side combined.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions import records as R
from meterloom.functions.reduce import consensus, evidence, guarded_max, half_even, medians
from meterloom.operators.pairs import pair_medians, pair_twins, rate_lookup, worst_rate
from meterloom.session import settle

MIB = R.MIB
# Tolerances, floors and exceptions that the results depend on.
E_VARIANT_FLOOR = 500.0
MOE_PRESENT = 1024.0
SITTING_MS = 3_600_000
AGREEMENT_MIB = 1.0
RECURRENT_TOLERANCE = 0.02
ARENA_TOLERANCE = 5.0
HOST_MARGIN = 1.10
JOBS = 6
MAY_DISAGREE = ["glm-dsa", "laguna"]


def _out(df: DataFrame, key: Column | str, value: Column, *more: Column) -> DataFrame:
    key = F.lit(key) if isinstance(key, str) else key
    return df.select(key.alias("key"), value.cast("long").alias("value"), F.col("n"), F.col("status"), *more)


def _agree(df: DataFrame, keys: list[str], tolerance: float = 0.15, floor: float = 0.0) -> DataFrame:
    # The rank selection reads its points several times; the narrow points are
    # written once instead of being modelled again from the wide records.
    points = settle(df.filter(F.col("v").isNotNull()).select(*keys, "v"), "points")
    return consensus(points, keys, "v", tolerance, floor)


def _agreed(table: DataFrame) -> DataFrame:
    """Key and value of a rate table; what a derivation refused is left out."""
    return (table.filter("status = 'ok'") if "status" in table.columns else table).select("key", "value")


def _maxima(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).withColumn("status", F.lit("ok"))


def _plain(records: DataFrame) -> DataFrame:
    """Fully offloaded rows on some card with an arena reading."""
    return records.filter(R.arena().isNotNull() & R.fully_offloaded() & (R.factor("gpus") != ""))


# --- graph arena -----------------------------------------------------------


def mask_copy_points(records: DataFrame, rates: R.Rates) -> DataFrame:
    t = R.arena_terms(rates)
    masks = t["mask"] + t["swa"]
    rows = _plain(records).filter(
        ~R.is_ik() & R.flash_on() & (R.parsed("arch") != "gemma4") & ~R.is_hybrid() & (masks > 0) & (R.cards_or(1) > 1) & (R.split_or_layer() == "layer")
    )
    return rows.select(R.file_name(R.factor("model")).alias("model"), ((R.arena() - t["hidden"]) / masks).alias("v"))


def mask_copies(records: DataFrame, rates: R.Rates) -> DataFrame:
    """How many copies of the masks a layer split holds."""
    return _out(_agree(mask_copy_points(records, rates), []), "mask_copies", half_even(F.col("median")))


def offload_batch(records: DataFrame, rates: R.Rates) -> DataFrame:
    """Batch ratio from which the expert term disappears, bracketed by the data."""
    t = R.arena_terms(rates, charge_moe=False)
    experts, used = R.parsed("n_expert"), R.parsed("n_expert_used")
    rows = records.filter(R.is_ik() & R.arena().isNotNull() & (experts != 0) & (used != 0) & R.flash_on() & R.fully_offloaded())
    per_token = (R.arena() - (t["mask"] + t["swa"] + t["hidden"])) * F.lit(MIB) / R.tokens()
    ratio = R.tokens() * used / experts
    both = rows.select((per_token > MOE_PRESENT).alias("on"), ratio.cast("double").alias("ratio")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("on"), F.col("ratio"))).alias("worst_on"), F.min(F.when(~F.col("on"), F.col("ratio"))).alias("first_off")
    )
    held = F.col("worst_on").isNotNull() & F.col("first_off").isNotNull()
    return _out(both.withColumn("status", F.when(held, "ok").otherwise("no-data")), "offload_min_batch", half_even(F.col("first_off")), F.col("worst_on"))


def tensor_moe_points(records: DataFrame, rates: R.Rates) -> DataFrame:
    t = R.arena_terms(rates, charge_moe=False)
    rows = records.filter(~R.is_ik() & R.is_hybrid() & (R.split_or_layer() == "tensor") & R.flash_on() & ~R.has_spec() & R.arena().isNotNull() & R.fully_offloaded())
    excess = (R.arena() - (t["mask"] + t["swa"] + t["hidden"])) * F.lit(MIB)
    return rows.filter(excess > 0).select(R.file_name(R.factor("model")).alias("model"), (excess / R.tokens() / R.parsed("n_embd")).alias("v"))


def tensor_moe(records: DataFrame, rates: R.Rates) -> DataFrame:
    """Expert bytes per hidden unit and token that a tensor split adds to a hybrid."""
    return _out(_agree(tensor_moe_points(records, rates), []), "tensor_moe_rate", half_even(F.col("median")))


def fork_moe(records: DataFrame, rates: R.Rates) -> DataFrame:
    """Expert rate per architecture and card count; only two architectures may differ across cards."""
    t = R.arena_terms(rates, charge_moe=False)
    experts, used = R.parsed("n_expert"), R.parsed("n_expert_used")
    rows = records.filter(
        R.is_ik() & R.arena().isNotNull() & (experts != 0) & (used != 0) & (R.tokens() * used < R.MOE_OFFLOAD_RATIO * experts) & R.flash_on() & R.fully_offloaded()
    )
    excess = (R.arena() - (t["mask"] + t["swa"] + t["hidden"])) * F.lit(MIB) / R.tokens()
    points = rows.select(R.parsed("arch").alias("arch"), R.arch_cards().alias("key"), (excess / R.parsed("n_embd")).alias("v"))
    inner = _agree(points, ["arch", "key"])
    outer = _agree(points, ["arch"]).select(F.col("arch").alias("__arch"), F.col("status").alias("__across"))
    joined = inner.join(outer, F.col("arch") == F.col("__arch"))
    excused = F.col("arch").isin(MAY_DISAGREE)
    status = F.when(F.col("status") != "ok", F.col("status")).when(~excused & (F.col("__across") != "ok"), F.lit("disagree")).otherwise(F.lit("ok"))
    return _out(joined.withColumn("status", status), F.col("key"), half_even(F.greatest(F.col("highest"), F.lit(0.0))))


# --- terms pinned by one factor --------------------------------------------


def layer_token_term(records: DataFrame, rates: R.Rates) -> DataFrame:
    """Bytes per layer and token of the embedding variant, against same-architecture controls."""
    t = R.arena_terms(rates)
    rows = _plain(records).filter((R.parsed("arch") == "gemma4") & R.flash_on() & ~R.has_spec() & ~R.kv_quantised())
    residual = R.arena() - (R.layer_split_copies() * (t["mask"] + t["swa"]) + t["hidden"])
    per = rows.select((residual * F.lit(MIB) / (R.parsed("n_layer").cast("double") * R.tokens())).alias("v")).withColumn("variant", F.col("v") > E_VARIANT_FLOOR)
    mids = _agree(per, ["variant"])
    control = F.coalesce(F.max(F.when(~F.col("variant"), F.col("median"))), F.lit(0.0))
    one = mids.agg(
        F.max(F.when(F.col("variant"), F.col("median"))).alias("m"), F.max(F.when(F.col("variant"), F.col("n"))).alias("n"),
        F.coalesce(F.max(F.when(F.col("variant"), F.col("status"))), F.lit("no-data")).alias("status"), control.alias("control"),
    )
    return _out(one, "layer_token_bytes", half_even(F.col("m")), F.col("control"))


def quantised_cache(records: DataFrame) -> DataFrame:
    """Extra bytes per batch token and copy under a quantised cache, by architecture."""
    names = ["ctx", "ubatch", "parallel", "kv_unified", "split", "gpus", "flash_attn", "served", "no_mmap", "rtr", "mmproj"]
    rows = _plain(records).filter(~R.has_spec()).select(
        F.col("provenance.model_key").alias("model_key"), *[R.factor(c).alias(c) for c in names], F.coalesce(R.factor("n_cpu_moe"), F.lit(0)).alias("moe"),
        F.coalesce(R.factor("numa"), F.lit("-")).alias("numa"), R.factor("kv_type").alias("kv"), R.arena().alias("arena"), R.parsed("arch").alias("arch"), "pos",
    )
    keys = ["model_key", *names, "moe", "numa"]
    # The last row of each half stands, and exactly the two cache types may occur.
    per = rows.groupBy(*keys, "kv").agg(F.max_by("arena", "pos").alias("arena"))
    pairs = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("kinds"), F.max(F.when(F.col("kv") == "q8_0", F.col("arena"))).alias("q"), F.max(F.when(F.col("kv") == "f16", F.col("arena"))).alias("f")
    ).filter((F.col("kinds") == 2) & F.col("q").isNotNull() & F.col("f").isNotNull())
    archs = rows.groupBy("model_key").agg(F.max_by("arch", "pos").alias("arch"))
    copies = F.when((F.size(F.split("gpus", ",")) > 1) & (F.coalesce("split", F.lit("")) == "layer") & (F.col("moe") == 0), 4.0).otherwise(1.0)
    rate = F.try_divide((F.col("q") - F.col("f")) * F.lit(MIB), F.least("ctx", "ubatch").cast("double")) / copies
    return _out(_agree(pairs.join(archs, "model_key").select("arch", rate.alias("v")), ["arch"], 0.05), F.col("arch"), half_even(F.col("highest")))


def unfused_host(records: DataFrame, rates: R.Rates) -> DataFrame:
    """Host bytes per batch token and copy with flash attention off, by variant."""
    t = R.arena_terms(rates)
    rows = _plain(records).filter(R.flash_off() & ~R.has_spec() & ~R.is_ik())
    copies = F.when((F.size(F.split(R.factor("gpus"), ",")) > 1) & (R.split_or_layer() == "layer") & ~R.is_hybrid(), 4.0).otherwise(1.0)
    extra = F.when(R.parsed("per_layer_token_embd"), F.lit(rates.get("layer_token_bytes")) * R.parsed("n_layer") * R.tokens() / F.lit(MIB)).otherwise(0.0)
    residual = R.arena() - (copies * (t["mask"] + t["swa"]) + t["hidden"]) - extra
    points = rows.select(R.variant().alias("variant"), (residual * F.lit(MIB) / R.tokens() / copies).alias("v"))
    return _out(_agree(points, ["variant"], 0.10, 4096.0), F.col("variant"), F.greatest(half_even(F.col("highest")), F.lit(0)))


def unfused_score(records: DataFrame) -> DataFrame:
    """Hundredths of a byte per head, cache token and batch token without fused attention."""
    names = ["model", "ctx", "kv_type", "gpus", "parallel", "kv_unified", "runtime", "ngl", "embeddings", "served"]
    rows = records.filter(R.gpu_used().isNotNull() & R.arch_named().isNotNull()).select(
        R.arch_named().alias("arch"), *[R.factor(c).alias(c) for c in names], R.ubatch_or_default().alias("ub"), R.split_or_layer().alias("split"),
        F.coalesce(R.factor("n_cpu_moe"), F.lit(0)).alias("moe"), R.has_spec().alias("spec"), R.present("mmproj").alias("vision"), R.factor("flash_attn").alias("fa"),
        F.struct(R.gpu_used().alias("used"), R.query_heads().alias("heads"), R.resident_weights().alias("weights")).alias("r"), "pos",
    )
    keys = ["arch", *names, "ub", "split", "moe", "spec", "vision"]
    pairs = pair_twins(rows, keys, F.col("fa"), "off", "on", F.col("r"), "pos", "first")
    streams = F.when(F.col("kv_unified"), F.lit(1)).otherwise(F.greatest("parallel", F.lit(1)))
    cells = F.floor(F.col("ctx") / streams)
    cards = F.greatest(F.size(F.filter(F.split("gpus", ","), lambda x: x != "")), F.lit(1))
    per = (F.col("a.used") - F.col("b.used")).cast("double") / cards
    entries = F.col("a.heads") * cells * F.least(cells, F.col("ub"))
    points = pairs.filter((F.col("a.heads") != 0) & R.same_weights(F.col("a.weights"), F.col("b.weights")) & (per > 0)).select("arch", (per * F.lit(MIB) / entries).alias("v"))
    return _out(_maxima(points, ["arch"]), F.col("arch"), F.greatest(F.ceil(F.col("top") * 100.0), F.lit(1)))


def vision_points(records: DataFrame) -> DataFrame:
    reserved = F.nullif(F.try_element_at(R.parsed("mmproj_reserved_mib"), F.lit("CUDA0")), F.lit(0.0))
    tensors = F.nullif(R.parsed("mmproj_tensor_bytes"), F.lit(0).cast("long"))
    return records.filter(reserved.isNotNull() & tensors.isNotNull()).select(
        R.file_name(R.factor("model")).alias("model"), (reserved * F.lit(MIB) - tensors).alias("v"),
        F.coalesce(R.parsed("clip_image_size"), F.lit(0)).alias("image"), F.coalesce(R.parsed("clip_n_merge"), F.lit(0)).alias("merge"),
    )


def vision_graph(records: DataFrame) -> DataFrame:
    """Bytes a projector's graph reserves beyond its tensors: the worst measured."""
    rows = vision_points(records)
    shapes = rows.groupBy("image", "merge", half_even(F.col("v") / F.lit(MIB)).alias("mib")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    text = F.format_string("image %d/merge %d takes %d MiB", F.col("image").cast("long"), F.col("merge").cast("long"), F.col("mib"))
    one = shapes.agg(F.sum("n").alias("n"), F.max("top").alias("top"), evidence(F.struct("image", "merge", "mib"), text).alias("evidence"))
    return _out(one.withColumn("status", F.when(F.col("top").isNull(), "no-data").otherwise("ok")), "vision_graph_bytes", half_even(F.col("top")), F.col("evidence"))


def recorded_remainders(records: DataFrame) -> DataFrame:
    """Largest per-device remainder by architecture, context and batch, where no table is printed."""
    rows = records.filter((F.size(R.parsed("devices")) == 0) & R.arch_named().isNotNull() & R.flash_on() & ~R.has_spec() & R.table_less_compute().isNotNull())
    point = F.concat(F.lit("ctx"), R.factor("ctx").cast("string"), F.lit("/ub"), R.ubatch_or_default().cast("string"))
    points = rows.select(F.concat(R.arch_named(), F.lit(" "), point).alias("key"), half_even(R.table_less_compute()).alias("v"))
    return _out(_maxima(points, ["key"]), F.col("key"), F.greatest(F.col("top"), F.lit(0)))


# --- host baselines --------------------------------------------------------


def _baseline_rows(records: DataFrame) -> DataFrame:
    f = R.factor
    return _plain(records).filter(
        ~R.has_spec() & ~R.is_hybrid() & f("served") & ~f("bench") & (f("parallel") == 1) & ~f("no_mmap") & (f("probe_prompt_tokens") < R.CHECKPOINT_STEP)
    )


#: What the host baseline is measured against; without one of them there is no offset.
BASELINE_TERMS = ["base", "base_per_layer", "base_moe", "pinned_extra", "base_per_device"]


def baseline_offset(records: DataFrame, rates: R.Rates, unfused: DataFrame) -> DataFrame:
    """Owned host bytes beyond everything modelled, by variant and environment: the largest.

    Refused, one row with the reason as its status, when a modelled term is not
    known yet or no unfused rate was agreed on. Rates that were refused
    themselves are not used.
    """
    listed = _agreed(unfused)
    missing = [name for name in BASELINE_TERMS if name not in rates.values]
    reason = f"no {', '.join(missing)}" if missing else "no unfused rate" if listed.isEmpty() else None
    if reason:
        refused = records.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(reason).alias("status"))
        return _out(refused, F.lit(None).cast("string"), F.lit(None))
    worst = worst_rate(listed)
    rows = _baseline_rows(records).filter((R.split_or_layer() == "layer") & (R.parsed("n_layer") != 0))
    rows = rate_lookup(rows, R.variant(), listed, float(worst), "__no_fa")
    t = R.arena_terms(rates)
    cards = R.cards_or(1)
    copies = F.when((cards > 1) & ~R.is_ik(), 4.0).otherwise(1.0)
    no_fa = F.when(R.charged_unfused(), F.col("__no_fa") * R.tokens() * copies).otherwise(0.0)
    modelled = F.lit(rates.get("base")) + R.parsed("n_layer") * F.lit(rates.get("base_per_layer")) + F.when(R.parsed("n_expert") != 0, F.lit(rates.get("base_moe"))).otherwise(0.0)
    residual = (
        R.owned_bytes().cast("double") - (copies * (t["mask"] + t["swa"]) + t["hidden"]) * F.lit(MIB) - no_fa
        - F.lit(rates.get("pinned_extra")) - F.lit(rates.get("base_per_device")) * (cards - 1) - modelled
    )
    return _out(_maxima(rows.select(R.variant_environment().alias("k"), residual.alias("v")), ["k"]), F.col("k"), half_even(F.col("top")))


def tensor_baseline(records: DataFrame, rates: R.Rates) -> DataFrame:
    """What a tensor split costs over a layer split at matching settings, by architecture."""
    t = R.arena_terms(rates)
    copies = F.when(R.split_or_layer() == "layer", 4.0).otherwise(1.0)
    base = (R.owned_bytes().cast("double") - (copies * (t["mask"] + t["swa"]) + t["hidden"]) * F.lit(MIB)) / F.lit(MIB)
    rows = _baseline_rows(records).filter(R.factor("gpus") == "0,1").select(
        F.col("provenance.model_key").alias("model"), R.factor("ctx").alias("ctx"), R.factor("ubatch").alias("ubatch"), R.parsed("arch").alias("arch"), R.split_or_layer().alias("split"), base.alias("base")
    )
    pairs = pair_medians(rows, ["model", "ctx", "ubatch", "arch"], "split", "tensor", "layer", "base")
    return _out(_agree(pairs.select("arch", (F.col("a") - F.col("b")).alias("v")), ["arch"], 0.20), F.col("arch"), half_even(F.col("highest") * F.lit(MIB)))


def device_cost(records: DataFrame) -> DataFrame:
    """Host bytes a second card costs, measured with everything on the CPU."""
    label = R.factor("label")
    rows = records.filter((label.startswith("devices-") | label.startswith("offload-ngl0")) & (R.factor("ngl") == 0)).select(
        F.col("provenance.model_key").alias("model"), R.cards_or(0).alias("cards"), F.expr("rss.rss_anon_kb + rss.rss_shmem_kb").alias("owned"), "pos"
    )
    pairs = pair_twins(rows, ["model"], F.col("cards"), 1, 2, F.col("owned"), "pos", "last")
    return _out(_agree(pairs.select(((F.col("b") - F.col("a")) * 1024).cast("double").alias("v")), []), "base_per_device", half_even(F.col("median")))


def slot_cost(records: DataFrame) -> DataFrame:
    """Anonymous bytes per concurrently active slot, by architecture: worst slope from the lowest point."""
    f = R.factor
    names = ["runtime", "ctx", "ubatch", "gpus", "kv_type", "kv_unified", "soak"]
    rows = records.filter(f("served") & ~f("bench") & ~R.has_spec() & ~R.is_hybrid() & R.arch_named().isNotNull()).select(
        R.arch_named().alias("arch"), *[f(c).alias(c) for c in names], R.split_or_layer().alias("split"), F.greatest(f("concurrency"), F.lit(1)).alias("c"), (F.col("rss.rss_anon_kb") * 1024).alias("owned")
    )
    keys = ["arch", *names, "split"]
    points = rows.groupBy(*keys, "c").agg(F.min("owned").alias("owned"))
    # A key holds one point per concurrency level; the base is joined back by aggregation.
    base = points.groupBy(*keys).agg(F.min(F.struct("c", "owned")).alias("lo"), F.collect_list(F.struct("c", "owned")).alias("all"))
    slopes = F.transform(F.filter("all", lambda p: p["c"] > F.col("lo.c")), lambda p: (p["owned"] - F.col("lo.owned")) / (p["c"] - F.col("lo.c")))
    worst = base.select("arch", F.array_max(slopes).alias("v")).filter(F.col("v").isNotNull())
    return _out(guarded_max(worst, ["arch"], "v"), F.col("arch"), F.greatest(half_even(F.col("top")), F.lit(0)))


def checkpoint_headroom(records: DataFrame) -> DataFrame:
    """Extra bytes a prompt past the checkpoint spacing leaves behind, by variant."""
    f = R.factor
    names = ["runtime", "ctx", "ubatch", "gpus", "kv_type", "parallel", "flash_attn", "soak", "concurrency", "cram", "no_mmap"]
    rows = records.filter(R.is_ok() & f("served") & ~f("bench") & ~R.has_spec() & ~R.is_hybrid() & R.fully_offloaded()).select(
        R.variant().alias("variant"), *[f(c).alias(c) for c in names], R.split_or_layer().alias("split"), (f("probe_prompt_tokens") >= R.CHECKPOINT_STEP).alias("steady"), R.owned_mib().alias("owned"), "pos"
    )
    pairs = pair_twins(rows, ["variant", *names, "split"], F.col("steady"), True, False, F.col("owned"), "pos", "max")
    gaps = pairs.select("variant", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("v"))
    return _out(guarded_max(gaps, ["variant"], "v"), F.col("variant"), F.col("top") * int(MIB))


# --- draft models ----------------------------------------------------------

IDENTITY = ["model", "ctx", "parallel", "kv_unified", "split", "gpus", "ubatch", "kv_type", "served", "mmproj"]


def draft_pairs(records: DataFrame, within_ms: int = SITTING_MS) -> DataFrame:
    """With/without pairs of one sitting: `model, ctx, parallel, cards, delta, host_delta`, and both sides' contexts.

    The last row of each half stands for it, so an identity yields one pair.
    """
    f = R.factor
    side = F.struct(
        R.gpu_used().alias("used"), R.measured_ms().alias("at"), R.owned_mib().alias("owned"), R.parsed("arch").alias("arch"), f("draft").alias("draft"),
        f("spec_type").alias("spec_type"), R.context_sums(R.parsed("contexts")).alias("sums"),
    )
    rows = records.filter(R.arch_named().isNotNull()).select(
        F.col("provenance.model_key").alias("model"), *[f(c).alias(c) for c in IDENTITY[1:]], R.has_spec().alias("spec"), side.alias("v"), "pos"
    )
    pairs = pair_twins(rows, IDENTITY, F.col("spec"), True, False, F.col("v"), "pos", "last")
    near = F.abs(F.col("a.at") - F.col("b.at")) <= within_ms
    cards = F.greatest(F.size(F.filter(F.split("gpus", ","), lambda x: x != "")), F.lit(1))
    out = pairs.filter(F.col("a.used").isNotNull() & F.col("b.used").isNotNull() & near & (F.col("a.used") > F.col("b.used")))
    return out.select(
        "model", "ctx", "parallel", cards.alias("cards"), (F.col("a.used") - F.col("b.used")).alias("delta"), (F.col("a.owned") - F.col("b.owned")).alias("host_delta"),
        F.when(F.coalesce("a.draft", F.lit("")) != "", "separate").otherwise("embedded").alias("shape"), F.col("a.spec_type").alias("mechanism"),
        F.col("a.sums").alias("on_sums"), F.col("b.sums").alias("off_sums"),
    )


def _endpoints(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Line through the smallest and largest context of a series with two or more."""
    ends = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("ctx").alias("x0"), F.max("ctx").alias("x1"), F.min_by(value, "ctx").alias("y0"), F.max_by(value, "ctx").alias("y1")
    )
    return ends.withColumn("slope", F.try_divide((F.col("y1") - F.col("y0")).cast("double"), (F.col("x1") - F.col("x0")) / F.lit(1024.0)))


def draft_slope(pairs: DataFrame) -> DataFrame:
    """MiB per 1024 context tokens of a separate draft, by mechanism."""
    points = pairs.filter(F.col("shape") == "separate").groupBy("mechanism", "ctx").agg(F.max("delta").alias("delta"))
    ends = _endpoints(points, ["mechanism"], "delta").filter("n >= 2").withColumn("status", F.lit("ok"))
    return _out(ends, F.col("mechanism"), F.ceil("slope"))


def draft_unaccounted(pairs: DataFrame) -> DataFrame:
    """Per-device MiB of an embedded draft that no named buffer explains: the largest."""
    draft, on, off = R.draft_context(F.col("on_sums")), R.main_context(F.col("on_sums")), R.main_context(F.col("off_sums"))
    cards = F.col("cards").cast("double")
    named = draft["kv"] + cards * draft["compute"] + cards * (on["rs"] - off["rs"]) + cards * (on["compute"] - off["compute"])
    gaps = pairs.filter(F.col("shape") == "embedded").select(((F.col("delta") - named) / cards).alias("v")).filter("v > 0")
    one = gaps.agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).withColumn("status", F.when(F.col("top").isNull(), "no-data").otherwise("ok"))
    return _out(one, "draft_unaccounted_mib", half_even(F.col("top")))


def draft_line(records: DataFrame) -> DataFrame:
    """Base and slope of an embedded draft's graph over context, lifted to cover every point.

    Refused where the runtime's own total disagrees with its buffer lines.
    """
    contexts = R.parsed("contexts")
    first = R.context_sums(F.slice(contexts, 1, 1))[0]
    rows = records.filter(R.has_spec() & ~R.present("draft") & (F.size(contexts) >= 2)).select(
        R.parsed("arch").alias("arch"), R.factor("ctx").alias("ctx"), first["compute"].alias("share"), first["kv"].alias("cache"), R.parsed("mtp_context_mib").alias("reported"), "pos"
    ).filter("share > 0")
    bad = (F.col("reported") != 0) & (F.abs(F.col("reported") - (F.col("cache") + F.col("share"))) > AGREEMENT_MIB)
    points = rows.groupBy("arch", "ctx").agg(F.max_by("share", "pos").alias("y"), F.bool_or(bad).alias("bad")).withColumn("x", F.col("ctx") / F.lit(1024.0))
    fit = points.groupBy("arch").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("bad").alias("bad"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my")
    ).filter("n >= 2").withColumn("base", F.col("my") - F.col("slope") * F.col("mx"))
    gaps = points.select(F.col("arch").alias("__arch"), "x", "y").join(fit, F.col("__arch") == F.col("arch"))
    lifted = gaps.groupBy("arch", "n", "bad", "slope", "base").agg(F.max(F.col("y") - (F.col("base") + F.col("slope") * F.col("x"))).alias("deficit"))
    base = F.col("base") + F.greatest(F.col("deficit"), F.lit(0.0))
    out = lifted.withColumn("status", F.when(F.col("bad"), "disagree").otherwise("ok"))
    return _out(out, F.col("arch"), half_even(base), half_even(F.col("slope") * 1000.0).alias("slope_milli"))


def draft_host(pairs: DataFrame) -> DataFrame:
    """Host MiB of a draft per shape: base with margin and the worst context slope in thousandths."""
    points = pairs.filter(F.col("host_delta") > 0).groupBy("shape", "model", "ctx").agg(F.max("host_delta").alias("y"))
    slopes = _endpoints(points, ["shape", "model"], "y").filter("n >= 2").groupBy("shape").agg(F.max("slope").alias("worst"))
    milli = points.select("shape").distinct().join(slopes, "shape", "left").select(F.col("shape").alias("__shape"), F.coalesce(half_even(F.col("worst") * 1000.0), F.lit(0)).alias("slope_milli"))
    rest = F.col("y") - F.col("slope_milli") / F.lit(1000.0) * (F.col("ctx") / F.lit(1024.0))
    fit = points.join(milli, F.col("shape") == F.col("__shape")).groupBy("shape", "slope_milli").agg(F.count(F.lit(1)).alias("n"), F.max(rest).alias("worst"))
    return _out(fit.withColumn("status", F.lit("ok")), F.col("shape"), F.ceil(F.col("worst") * HOST_MARGIN) * int(MIB), F.col("slope_milli"))


def draft_host_slope(host: DataFrame) -> DataFrame:
    """One slope for both shapes: the larger."""
    return _out(host.agg(F.sum("n").alias("n"), F.max("slope_milli").alias("v")).withColumn("status", F.lit("ok")), "draft_host_slope_milli", F.col("v"))


def slot_series(pairs: DataFrame) -> DataFrame:
    """Driver delta over slot counts at a fixed context, reported only."""
    name = R.file_name(F.col("model"))
    order = F.struct(F.when(F.col("shape") == "separate", 1).otherwise(0).alias("s"), "delta")
    points = pairs.groupBy(name.alias("name"), "ctx", "parallel").agg(F.max_by("delta", order).alias("delta"))
    text = F.format_string("np%d %d MiB", F.col("parallel"), F.col("delta"))
    return points.groupBy("name", "ctx").agg(F.count(F.lit(1)).alias("n"), evidence(F.col("parallel"), text).alias("series")).filter("n > 1")


def recurrent_pools(records: DataFrame) -> DataFrame:
    """Each recurrent pool beside its modelled size."""
    pools = records.select("parsed", F.explode(R.parsed("contexts")).alias("c")).filter("c.rs_pool is not null")
    return pools.select(R.parsed("arch").alias("arch"), F.col("c.rs_pool").alias("pool"), R.recurrent_state(F.col("c.rs_pool")).alias("model"))


def rollback_depth(records: DataFrame, tolerance: float = RECURRENT_TOLERANCE) -> DataFrame:
    """The single rollback depth of speculative pools; refused if the size model or the depth disagrees."""
    pools = recurrent_pools(records)
    gap = F.greatest(F.abs(F.col("model.r") - F.col("pool.r_mib")), F.abs(F.col("model.s") - F.col("pool.s_mib")))
    depth = F.when(F.col("pool.rs_seq") > 0, F.col("pool.rs_seq"))
    one = pools.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("worst"), F.min(depth).alias("lo"), F.max(depth).alias("hi"))
    status = F.when(F.coalesce(F.col("worst"), F.lit(0.0)) > tolerance, "model-drift").when(F.col("lo").isNull(), "no-data").when(F.col("lo") != F.col("hi"), "disagree").otherwise("ok")
    return _out(one.withColumn("status", status), "rollback_depth", F.col("hi"))


def recurrent_errors(records: DataFrame) -> DataFrame:
    """Worst modelled error of each recurrent half by architecture."""
    pools = recurrent_pools(records).filter("model is not null")
    halves = pools.select("arch", F.explode(F.array(
        F.struct(F.lit("R").alias("half"), F.abs(F.col("model.r") - F.col("pool.r_mib")).alias("e")), F.struct(F.lit("S").alias("half"), F.abs(F.col("model.s") - F.col("pool.s_mib")).alias("e"))
    )).alias("h"))
    return halves.groupBy("arch", F.col("h.half").alias("half")).agg(F.max("h.e").alias("error"))


def arena_check(records: DataFrame, rates: R.Rates, unfused: DataFrame, quantised: DataFrame, tolerance: float = ARENA_TOLERANCE) -> DataFrame:
    """Worst cell of the arena model per architecture, and whether it is within tolerance."""
    rows = records.filter(R.arena().isNotNull() & ~R.has_spec() & (R.split_or_layer() != "tensor") & ~R.is_hybrid() & R.fully_offloaded())
    no_fa, quant = _agreed(unfused), _agreed(quantised)
    rows = rate_lookup(rows, R.variant(), no_fa, float(worst_rate(no_fa)), "__no_fa")
    rows = rate_lookup(rows, R.parsed("arch"), quant, float(worst_rate(quant)), "__quant")
    t = R.arena_terms(rates)
    per = R.tokens() / F.lit(MIB)
    copies = F.when((R.cards_or(1) > 1) & ~R.is_ik(), 4.0).otherwise(1.0)
    fa = F.when(~R.is_ik() & R.charged_unfused(), F.col("__no_fa") * per).otherwise(0.0)
    q = F.when(R.kv_quantised(), F.col("__quant") * per).otherwise(0.0)
    e = F.when(R.parsed("per_layer_token_embd"), F.lit(rates.get("layer_token_bytes")) * R.parsed("n_layer") * per).otherwise(0.0)
    error = F.abs(R.arena() - (copies * (t["mask"] + t["swa"] + fa) + t["hidden"] + q + e))
    worst = rows.groupBy(R.parsed("arch").alias("arch")).agg(F.max(error).alias("error"), F.max_by("log", F.struct(error.alias("e"), F.col("log"))).alias("log"))
    return worst.withColumn("within", F.col("error") <= tolerance)


# --- one run over everything -----------------------------------------------


def _first(df: DataFrame) -> float | None:
    row = df.filter("status = 'ok'").select("value").first()
    return None if row is None or row[0] is None else float(row[0])


def derive_all(records: DataFrame, rates: R.Rates | None = None, within_ms: int = SITTING_MS) -> DataFrame:
    """Every constant as `name, key, value, n, status`, in the order they feed each other.

    Only constants travel through the driver: a handful of numbers that the
    next job reads as literals. Tables stay DataFrames.
    """
    rates = rates or R.Rates()
    fork = fork_moe(records, rates)
    worst_fork = fork.filter("status = 'ok'").agg(F.max("value")).first()[0]
    rates = rates.with_value("ik_moe_rate", worst_fork)
    threaded = {}
    for name, job in [("tensor_moe_rate", tensor_moe), ("layer_token_bytes", layer_token_term)]:
        threaded[name] = job(records, rates)
        rates = rates.with_value(name, _first(threaded[name]))
    threaded["base_per_device"] = device_cost(records)
    rates = rates.with_value("base_per_device", _first(threaded["base_per_device"]))
    unfused = unfused_host(records, rates)
    pairs = draft_pairs(records, within_ms)
    host = draft_host(pairs)
    tables = {
        "fork_moe_rates": fork, **threaded, "mask_copies": mask_copies(records, rates), "offload_min_batch": offload_batch(records, rates),
        "quantised_cache_rates": quantised_cache(records), "unfused_host_rates": unfused, "unfused_score_rates": unfused_score(records),
        "vision_graph_bytes": vision_graph(records), "recorded_remainders": recorded_remainders(records),
        "baseline_offsets": baseline_offset(records, rates, unfused), "tensor_split_baseline": tensor_baseline(records, rates),
        "slot_bytes": slot_cost(records), "checkpoint_headroom": checkpoint_headroom(records), "draft_slopes": draft_slope(pairs),
        "draft_unaccounted_mib": draft_unaccounted(pairs), "draft_lines": draft_line(records), "draft_host_bytes": host,
        "draft_host_slope_milli": draft_host_slope(host), "rollback_depth": rollback_depth(records),
    }
    def write(item: tuple[str, DataFrame]) -> DataFrame:
        name, df = item
        one = df.select(F.lit(name).alias("name"), F.col("key").cast("string").alias("key"), "value", F.col("n").cast("long").alias("n"), "status")
        return settle(one, name)

    # The jobs left are independent of each other, so they share the cluster.
    with ThreadPoolExecutor(JOBS) as pool:
        written = list(pool.map(write, tables.items()))
    return reduce(DataFrame.unionByName, written)


UNSIGNED = ["unfused_host_rates", "quantised_cache_rates", "slot_bytes", "checkpoint_headroom", "draft_slopes"]


def check_committed(committed: DataFrame, derived: DataFrame) -> DataFrame:
    """Committed against derived values: `same`, `changed`, `missing`, `new` or `negative`."""
    c = committed.select("name", "key", F.col("value").alias("committed"))
    d = derived.filter("status = 'ok'").select("name", "key", F.col("value").alias("derived"))
    both = c.join(d, ["name", "key"], "full")
    state = (
        F.when(F.col("name").isin(UNSIGNED) & (F.col("derived") < 0), "negative")
        .when(F.col("derived").isNull(), "missing").when(F.col("committed").isNull(), "new")
        .when(F.col("committed") == F.col("derived"), "same").otherwise("changed")
    )
    return both.withColumn("state", state)
