"""Keeping a measurement dataset clean: superseding, retiring, auditing, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import records as R
from meterloom.functions import scan
from meterloom.functions.reduce import upper_medians
from meterloom.session import settle

BUILD_TOLERANCE = 0.10
IDLE_MINUTES = 45
THIN_POINTS = 2
AUDITED = [
    "ctx", "ubatch", "gpus", "parallel", "concurrency", "probe_prompt_tokens", "flash_attn", "kv_type", "split", "kv_unified", "spec_type", "runtime",
    "n_cpu_moe", "no_mmap",
]


def usable(records: DataFrame) -> DataFrame:
    return records.filter(R.is_ok())


def latest_per_cell(records: DataFrame, cell: str, stamp: Column, position: Column) -> DataFrame:
    """The newest row of each cell; of rows sharing the newest stamp the first read wins.

    One ranked row per cell and map task is kept before the shuffle, so a cell
    re-measured a billion times costs no more than any other, and columns nobody
    asks for are never read. Input order is restored by sorting on the position.
    """
    marked = records.withColumn("__stamp", stamp).withColumn("__pos", position)
    newest = scan.top_per_key(marked, [cell], [F.desc("__stamp"), F.asc("__pos")], 1)
    return newest.select(*records.columns)


def latest_measurement(records: DataFrame) -> DataFrame:
    return latest_per_cell(records, "cell", R.measured_ms(), F.col("pos"))


def first_per_configuration(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """First row of each configuration and how many later rows repeat it."""
    rest = [c for c in rows.columns if c not in keys]
    grouped = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), position).alias("__first"), (F.count(F.lit(1)) - 1).alias("duplicates")
    )
    return grouped.select(*keys, "__first.*", "duplicates")


def stale_builds(records: DataFrame) -> DataFrame:
    """Per runtime with two or more builds: the newest build and how many rows predate it."""
    builds = records.filter(R.is_ok()).groupBy(
        R.factor("runtime").alias("runtime"), F.col("provenance.runtime_sha256").alias("build")
    ).agg(F.count(F.lit(1)).alias("n"), F.max(R.measured_ms()).alias("latest"))
    out = builds.groupBy("runtime").agg(
        F.count(F.lit(1)).alias("builds"),
        F.max_by("build", F.struct("latest", "build")).alias("newest"),
        F.max_by("n", F.struct("latest", "build")).alias("current"),
        F.sum("n").alias("total"),
    )
    return out.filter(F.col("builds") >= 2).select("runtime", "newest", (F.col("total") - F.col("current")).alias("stale"), "total")


def build_disagreements(records: DataFrame, tolerance: float = BUILD_TOLERANCE) -> DataFrame:
    """Cells whose latest readings under two builds lie further apart than the tolerance."""
    rows = records.filter(R.is_ok() & R.gpu_used().isNotNull())
    last = rows.groupBy("cell", F.col("provenance.runtime_sha256").alias("build")).agg(F.max_by(R.gpu_used(), "pos").alias("used"))
    cells = last.groupBy("cell").agg(F.count(F.lit(1)).alias("builds"), F.min("used").alias("low"), F.max("used").alias("high"))
    apart = F.try_divide((F.col("high") - F.col("low")).cast("double"), F.col("low").cast("double")) > tolerance
    return cells.filter((F.col("builds") >= 2) & apart)


def retirable_builds(records: DataFrame, tolerance: float = BUILD_TOLERANCE) -> DataFrame:
    """(arch, build) pairs that a strictly later build contradicts on a shared cell.

    Whether any later reading is too far away only depends on the smallest and
    the largest of them, so one ordered pass per cell replaces comparing every
    pair of builds.
    """
    rows = records.filter(R.is_ok() & R.gpu_used().isNotNull())
    last = rows.groupBy(R.parsed("arch").alias("arch"), "cell", F.col("provenance.runtime_sha256").alias("build")).agg(
        F.max_by(F.struct(R.gpu_used().alias("used"), R.measured_ms().alias("at")), "pos").alias("r")
    ).select("arch", "cell", "build", "r.used", "r.at")
    later = Window.partitionBy("arch", "cell").orderBy((-F.col("at")).asc()).rangeBetween(Window.unboundedPreceding, -1)
    used = F.col("used").cast("double")
    bounds = last.select("arch", "build", used.alias("used"), F.min(used).over(later).alias("low"), F.max(used).over(later).alias("high"))
    apart = F.greatest(F.abs(F.col("high") - F.col("used")), F.abs(F.col("low") - F.col("used"))) / F.col("used")
    return bounds.filter(apart > tolerance).select("arch", "build").distinct()


def retire(records: DataFrame, stale: DataFrame) -> DataFrame:
    """Mark usable rows of retired builds; every reader skips the status.

    The stale list holds one row per (architecture, build).
    """
    marks = stale.select(F.col("arch").alias("__arch"), F.col("build").alias("__build"), F.lit(True).alias("__stale"))
    hit = (R.parsed("arch") == F.col("__arch")) & (F.col("provenance.runtime_sha256") == F.col("__build"))
    joined = records.join(marks, hit, "left")
    status = F.when(R.is_ok() & F.col("__stale"), F.lit("stale-runtime")).otherwise(F.col("status"))
    return joined.withColumn("status", status).select(*records.columns)


def membership(records: DataFrame) -> DataFrame:
    """Distinct measured cells, reading two columns only."""
    return records.select("cell", "status").filter(R.is_ok()).select("cell").distinct()


# --- plans -----------------------------------------------------------------


def plan_progress(plan: DataFrame, measured: DataFrame) -> DataFrame:
    """Each cell once: `measured`, `outstanding` or `unplanned`."""
    done = measured.select("cell").distinct().withColumn("__m", F.lit(True))
    want = plan.select("cell").distinct().withColumn("__p", F.lit(True))
    state = F.when(F.col("__p") & F.col("__m"), "measured").when(F.col("__p"), "outstanding").otherwise("unplanned")
    return want.join(done, "cell", "full").select("cell", state.alias("state"))


def outstanding(plan: DataFrame, measured: DataFrame) -> DataFrame:
    return plan.join(measured.select("cell").distinct(), "cell", "left_anti")


def best_status(records: DataFrame, position: str = "pos") -> DataFrame:
    """`ok` if any row of the cell reached it, else the first row's status."""
    grouped = records.groupBy("cell").agg(F.bool_or(R.is_ok()).alias("ok"), F.min_by("status", position).alias("first"))
    return grouped.select("cell", F.when(F.col("ok"), F.lit("ok")).otherwise(F.col("first")).alias("status"))


def question_progress(plan: DataFrame, records: DataFrame) -> DataFrame:
    """Per question: planned cells, measured cells, and the other statuses, commonest first.

    `plan` has one row per (question, cell). The status list is bounded by the
    number of status words.
    """
    cells = plan.select("question", "cell").distinct().join(best_status(records), "cell", "left")
    counts = cells.groupBy("question", "status").agg(F.count(F.lit(1)).alias("n"))
    issue = F.when(F.col("status").isNotNull() & (F.col("status") != "ok"), F.struct((-F.col("n")).alias("k"), "status", "n"))
    listed = F.transform(F.array_sort(F.collect_list(issue)), lambda e: F.concat(e["n"].cast("string"), F.lit("x "), e["status"]))
    return counts.groupBy("question").agg(
        F.sum("n").alias("planned"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("n"))), F.lit(0)).alias("measured"),
        F.array_join(listed, ", ").alias("issues"),
    )


def liveness(records: DataFrame, now_ms: int, idle: int = IDLE_MINUTES) -> DataFrame:
    """Whole minutes since the last record (null when it lies ahead) and the state."""
    last = records.agg(F.max(R.measured_ms()).alias("last_ms"))
    minutes = F.when(F.col("last_ms") <= now_ms, F.expr(f"({int(now_ms)} - last_ms) div 60000"))
    state = F.when(minutes < idle, "running").when(minutes.isNotNull(), "stalled or finished")
    return last.select("last_ms", minutes.alias("idle_minutes"), state.alias("state"))


def merge_plans(plans: DataFrame, identity: list[str]) -> DataFrame:
    """One row per configuration: its earliest position and its questions in plan order.

    `plans`: identity columns, question, pos (plan order). Questions are
    de-duplicated before they are gathered, so the list is bounded by the
    number of questions.
    """
    asked = plans.groupBy(*identity, "question").agg(F.min("pos").alias("pos"))
    return asked.groupBy(*identity).agg(
        F.min("pos").alias("pos"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "question"))), lambda e: e["question"]).alias("purpose"),
    )


def label_filter(plan: DataFrame, text: str, label: str = "label") -> DataFrame:
    """Planned cells whose label contains a text."""
    return plan.filter(F.col(label).contains(text))


UNREADABLE_SIZE = 1 << 62


def plan_order(plan: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Cheapest-to-switch order: by model size (unreadable last), then every costly switch."""
    f = plan
    if sizes is not None:
        # One row per model: written, its size is known, so a large plan need not be dealt out by its few models.
        sizes = settle(sizes.select("model", F.col("bytes").alias("__size")), "model-sizes")
        f = plan.join(sizes, "model", "left")
        size = F.when(F.col("model") == "", F.lit(0).cast("long")).otherwise(F.coalesce("__size", F.lit(UNREADABLE_SIZE)))
    else:
        size = F.lit(0).cast("long")
    keys = [
        size, *[F.col(c) for c in ("model", "runtime", "no_mmap", "rtr", "gpus")], F.coalesce("split", F.lit("")), F.col("ngl"),
        *[F.coalesce(c, F.lit("")) for c in ("spec_type", "draft", "mmproj")],
        *[F.col(c) for c in ("ctx", "ubatch", "parallel", "kv_type", "flash_attn")], ~F.col("served"), F.col("bench"), F.col("pos"),
    ]
    return f.withColumn("model_bytes", size).orderBy(*keys).select(*plan.columns, "model_bytes")


def factor_grid(axes: DataFrame, names: list[str]) -> DataFrame:
    """Full factorial from one row that holds an array per axis."""
    out = axes.select(*names)
    for name in names:
        out = out.withColumn(name, F.explode(F.array_sort(name)))
    return out


def with_repeats(plan: DataFrame, times: int) -> DataFrame:
    return plan.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def shard_sizes(files: DataFrame) -> DataFrame:
    """Total bytes per model over its shards `stem-00001-of-0000N`."""
    stem = F.regexp_replace("name", r"-\d{5}-of-\d{5}(?=\.gguf$)", "")
    return files.groupBy("folder", stem.alias("model")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("shards"))


# --- traces ----------------------------------------------------------------


def trace_summary(trace: DataFrame, finals: DataFrame) -> DataFrame:
    """Peak, first, last and growth per (cell, counter) of a memory trace.

    `trace`: cell, counter, t, value (null = not read at that sample). A counter
    that starts reporting late has its own first reading. `finals`: cell,
    counter, value; it stands in for the peak where no sample was taken.
    """
    read = F.when(F.col("value").isNotNull(), F.col("t"))
    seen = trace.groupBy("cell", "counter").agg(
        F.max("value").alias("__peak"), F.min_by("value", read).alias("first"), F.max_by("value", read).alias("last"), F.count("value").alias("samples")
    )
    both = seen.join(finals.select("cell", "counter", F.col("value").alias("final")), ["cell", "counter"], "full")
    peak = F.coalesce("__peak", "final")
    return both.select(
        "cell", "counter", peak.alias("peak"), "first", "last", "final", F.coalesce(F.col("__peak") - F.col("first"), F.lit(0)).alias("growth"), F.coalesce("samples", F.lit(0)).alias("samples")
    )


# --- audits ----------------------------------------------------------------


Regimes = dict[str, tuple[Column, list[str]]]
Reasons = list[tuple[Column, Column | str]]


def coverage(records: DataFrame, regimes: Regimes) -> DataFrame:
    """Per regime: measured cells and its thinnest axis; regimes nobody measured are listed.

    `regimes` names a predicate over factors and the axes it rests on. Values
    are made distinct per (regime, axis) before they are counted, so no axis is
    ever gathered. A zero arena reading is no reading.
    """
    # Rules and axes read few factors: rows that share them are counted once first.
    measured = records.filter(R.is_ok() & (R.parsed("arena_mib") > 0))
    combined = measured.groupBy(*[R.factor(c).alias(c) for c in AUDITED]).agg(F.count(F.lit(1)).alias("n"))
    combined = combined.select(F.struct(*AUDITED).alias("factors"), "n")
    points = F.array_compact(F.array(*[
        F.when(rule, F.struct(
            F.lit(name).alias("regime"),
            F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(a).alias("axis"), R.axis(a).alias("value")) for i, a in enumerate(axes)]).alias("axes"),
        ))
        for name, (rule, axes) in regimes.items()
    ]))
    hits = combined.select(F.explode(points).alias("h"), "n").select("h.regime", F.explode("h.axes").alias("a"), "n").select("regime", "a.*", "n")
    values = hits.groupBy("regime", "rank", "axis", "value").agg(F.sum("n").alias("n"))
    axes = values.groupBy("regime", "rank", "axis").agg(F.count(F.lit(1)).alias("points"), F.sum("n").alias("cells"))
    thin = axes.groupBy("regime").agg(F.max("cells").alias("cells"), F.min(F.struct("points", "rank", "axis")).alias("t"))
    listed = records.sparkSession.createDataFrame([(n,) for n in regimes], "regime string")
    out = listed.join(thin, "regime", "left")
    cells, axis_points = F.coalesce("cells", F.lit(0)), F.coalesce("t.points", F.lit(0))
    return out.select(
        "regime", cells.alias("cells"), axis_points.alias("points"),
        F.coalesce("t.axis", F.lit("never measured")).alias("thinnest"), ((cells > 0) & (axis_points < THIN_POINTS)).alias("thin"),
    )


def regime_members(records: DataFrame, regimes: Regimes) -> DataFrame:
    """Records per regime; a record counts in every regime it belongs to."""
    tags = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, (rule, _) in regimes.items()]))
    return records.select(F.explode(tags).alias("regime")).groupBy("regime").count()


def first_reason(reasons: Reasons) -> Column:
    """Text of the first rule that applies to a row, null when none does."""
    return F.coalesce(*[F.when(rule, text if isinstance(text, Column) else F.lit(text)) for rule, text in reasons])


def skip_counts(records: DataFrame, rules: Reasons, duplicates: bool = True) -> DataFrame:
    """Records per exclusion reason, duplicates of a configuration counted as one more reason."""
    reasons = records.withColumn("reason", first_reason(rules))
    skipped = reasons.filter(F.col("reason").isNotNull()).groupBy("reason").count()
    if not duplicates:
        return skipped
    keys = [R.factor(c).alias(f"__{c}") for c in R.CONFIGURATION]
    kept = reasons.filter(F.col("reason").isNull()).groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n"))
    repeated = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")).select(F.lit("duplicate configuration").alias("reason"), "count")
    return skipped.unionByName(repeated.filter("count > 0")).orderBy(F.desc("count"), "reason")


def production_readings(records: DataFrame, labels: list[str]) -> DataFrame:
    """Latest reading per production label; `label-suffix` counts for `label` too."""
    label = R.factor("label")
    rows = records.filter(R.is_ok() & label.startswith("prod-") & F.col("rss.gpu_used_mib").isNotNull())
    base = F.regexp_extract(label, "^(.*)-[^-]*$", 1)
    both = rows.select(F.explode(F.array(label, base)).alias("label"), F.col("rss.gpu_used_mib").alias("used"), R.measured_ms().alias("at"), "pos")
    wanted = both.filter(F.col("label").isin(labels))
    # A strictly later stamp replaces the held one: among equal stamps the first read stays.
    first = wanted.groupBy("label", "at").agg(F.min_by("used", "pos").alias("used"))
    return first.groupBy("label").agg(F.max_by("used", "at").alias("used"), F.max("at").alias("at"))


def inert_factor(rows: DataFrame, rest: list[str], level: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """Groups where one factor was swept: levels seen, how far the value moved, whether it stayed put."""
    spans = rows.groupBy(*rest).agg(
        F.min(level).alias("__lo"), F.max(level).alias("__hi"), (F.max(value) - F.min(value)).alias("moved"), F.count(F.lit(1)).alias("n")
    )
    return spans.filter(F.col("__lo") != F.col("__hi")).select(*rest, "n", "moved", (F.col("moved") < tolerance).alias("inert"))


def band_check(rows: DataFrame, observed: str, predicted: str, low: float = 0.8, high: float = 1.5) -> DataFrame:
    """How many rows land inside the band the correction can reach."""
    ratio = F.try_divide(F.col(observed).cast("double"), F.col(predicted).cast("double"))
    rows = rows.filter((F.col(observed) > 0) & (F.col(predicted) > 0)).withColumn("__ratio", ratio)
    return rows.agg(
        F.count(F.lit(1)).alias("checked"),
        F.sum(F.when(F.col("__ratio").between(low, high), 0).otherwise(1)).alias("outside"),
        F.min("__ratio").alias("lowest"), F.max("__ratio").alias("highest"),
    )


def shortfall_check(rows: DataFrame, reserved: str, measured: str, allowed: float = 0.13) -> DataFrame:
    """Worst share by which a reservation falls below the measurement, against a ratchet."""
    short = F.lit(1.0) - F.col(reserved) / F.col(measured)
    rows = rows.filter(F.col(measured) > 0).withColumn("__short", F.greatest(short, F.lit(0.0)))
    return rows.agg(
        F.count(F.lit(1)).alias("checked"), F.max("__short").alias("worst"), F.sum(F.when(F.col("__short") > allowed, 1).otherwise(0)).alias("beyond")
    )


def drift_summary(rows: DataFrame, drift: str, tolerance: float) -> DataFrame:
    """Upper-middle median, mean, range and count outside the tolerance."""
    middle = upper_medians(rows, [], drift).select(F.lit(1).alias("__k"), "upper_median")
    rest = rows.agg(
        F.lit(1).alias("__k"), F.count(drift).alias("n"), F.avg(drift).alias("mean"), F.min(drift).alias("lowest"), F.max(drift).alias("highest"),
        F.sum(F.when(F.abs(drift) > tolerance, 1).otherwise(0)).alias("outside"),
    )
    return rest.join(middle, "__k").drop("__k")


def headroom_line(rows: DataFrame, margin: int = 64) -> DataFrame:
    """Per architecture: worst delta overall and the line through the worst deltas at its
    smallest and largest context, with a safety margin."""
    arch = F.trim("architecture")
    delta = F.col("actual") - F.col("predicted")
    seen = rows.filter((arch != "") & (F.col("actual") != 0)).select(
        arch.alias("arch"), "context", delta.alias("delta"), (F.lit(100.0) * delta / F.col("actual")).alias("pct")
    )
    per = seen.groupBy("arch", "context").agg(F.max("delta").alias("worst"), F.max("pct").alias("pct"))
    ends = per.groupBy("arch").agg(
        F.count(F.lit(1)).alias("contexts"), F.max("worst").alias("worst_mib"), F.max("pct").alias("worst_pct"),
        F.min("context").alias("x0"), F.max("context").alias("x1"),
        F.min_by("worst", "context").alias("y0"), F.max_by("worst", "context").alias("y1"),
    )
    slope = F.try_divide((F.col("y1") - F.col("y0")).cast("double"), (F.col("x1") - F.col("x0")) / F.lit(1024.0))
    base = F.col("y0") - slope * (F.col("x0") / F.lit(1024.0))
    two = F.col("contexts") >= 2
    return ends.select(
        "arch", "contexts", "worst_mib", "worst_pct",
        F.when(two, (base + margin).cast("long")).alias("base_mib"), F.when(two, (slope + 0.5).cast("long")).alias("slope_mib_per_1k"),
    )
