"""Ordered per-service calculations: peaks, growth, drift, stalls, restarts.

Every operator keeps a busy service spread over many tasks. Where the step is
an associative function (running sums, last value seen, clamped affine maps)
the history is scanned in chunks and the chunks are combined; hysteresis and
grace periods are piecewise functions of one number and combine too
(`functions/fold.py`). Only the restart budget runs blocks side by side and
again those whose entry state turned out different.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import fold, scan
from meterloom.session import discard, settle

MIB = 1024 * 1024

# Rolling correction.
MEAN_LOW, MEAN_HIGH = 0.8, 1.5
TRUSTED_SAMPLES = 3
OOM_BUMP = 1.4
DRIFT_BAND = 0.3
DRIFT_ALERT = 5
DRIFT_EVENT = 0.05
UNDER_ESTIMATE, OVER_RESERVE = 1.2, 0.85

# Memory growth, pledges, ceiling.
WINDOW = 6
PLEDGE_PERMILLE = 50
PLEDGE_FLOOR_MIB = 256
CEILING_PERMILLE = 1100
CEILING_GRACE_MS = 30_000

# Restart budget and stalls.
FLAP_WINDOW_MS = 1_800_000
FLAP_MAX = 3
STALL_TIMEOUT_MS = 300_000

FAN = 256
#: Levels of blocks of blocks: the last gathers rows / FAN ** LEVELS entries, 233 for 10^12 rows of one key.
LEVELS = 4
WIDE = 1e12


# --- rolling correction ----------------------------------------------------


def admit_samples(runs: DataFrame) -> DataFrame:
    """Turn drained runs into (service, pool, observed, base) samples.

    Only runs that became ready count, and a zero peak is no measurement. When
    the mapped counter shows the weights were read into anonymous memory they
    leave the numerator; they always leave the denominator.
    """
    weights = F.col("cpu_weight_bytes")
    anonymous = (weights > 0) & (F.col("peak_file_bytes") < F.expr("cpu_weight_bytes div 2"))
    host = F.when(anonymous, F.greatest(F.col("peak_owned_bytes") - weights, F.lit(0))).otherwise(F.col("peak_owned_bytes"))
    host_base = F.greatest(F.col("host_bytes") - weights, F.lit(0))
    pools = F.array(
        F.struct(F.lit("vram").alias("pool"), F.col("peak_vram_bytes").alias("observed"), F.col("vram_bytes").alias("base")),
        F.struct(F.lit("host").alias("pool"), host.alias("observed"), host_base.alias("base")),
    )
    kept = runs.filter("became_ready").select("service", "seq", F.explode(pools).alias("s")).select("service", "seq", "s.*")
    return kept.filter(F.col("observed") > 0)


def _step(a: Column, b: Column, low: Column, high: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), low.alias("lo"), high.alias("hi"))


def _apply(f: Column, x: Column) -> Column:
    return F.least(F.greatest(f["a"] * x + f["b"], f["lo"]), f["hi"])


def _then(first: Column, second: Column) -> Column:
    """Clamped affine maps are closed under composition, so folds of them combine."""
    return _step(
        second["a"] * first["a"], second["a"] * first["b"] + second["b"], _apply(second, first["lo"]), _apply(second, first["hi"])
    )


def _identity() -> Column:
    return _step(F.lit(1.0), F.lit(0.0), F.lit(-WIDE), F.lit(WIDE))


def clamped_fold(df: DataFrame, keys: list[str], at: str, step: Column, start: Column, name: str, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """State after each row when every row applies `x -> clamp(a*x + b, lo, hi)`.

    `at` numbers a key's rows from zero without holes; `start` is the state
    before row zero and is constant within a key. Rows are folded in blocks of
    `fan`, blocks in blocks of blocks, and entry states flow back down, so no
    task ever sees more than one block of rows.
    """
    rows = df.withColumn("__f", step).withColumn("__start", start)
    starts = rows.groupBy(*keys).agg(F.first("__start").alias("__x"))
    entered = _entry_states(rows.select(*keys, F.col(at).alias("__at"), "__f"), starts, keys, levels, fan)
    out = entered.withColumnRenamed("__at", at)
    return rows.join(out, [*keys, at]).select(*df.columns, _apply(F.col("__f"), F.col("__x")).alias(name))


def _entry_states(rows: DataFrame, starts: DataFrame, keys: list[str], levels: int, fan: int) -> DataFrame:
    """The state before each row (`__x`), from the start state of each key."""
    if levels == 0:
        blocks = rows.withColumn("__block", F.lit(0).cast("long"))
        entries = starts.withColumn("__block", F.lit(0).cast("long"))
    else:
        blocks = rows.withColumn("__block", F.expr(f"__at div {int(fan)}"))
        folded = _gathered(blocks, keys).select(
            *keys, F.col("__block").alias("__at"), F.aggregate("__list", _identity(), lambda acc, e: _then(acc, e["f"])).alias("__f")
        )
        entries = _entry_states(folded, starts, keys, levels - 1, fan).withColumnRenamed("__at", "__block")
    joined = _gathered(blocks, keys).join(entries, [*keys, "__block"])
    states = F.aggregate(
        "__list",
        F.struct(F.col("__x").alias("x"), F.array().cast("array<double>").alias("seen")),
        lambda acc, e: F.struct(_apply(e["f"], acc["x"]).alias("x"), F.concat(acc["seen"], F.array(acc["x"])).alias("seen")),
    )["seen"]
    zipped = F.explode(F.arrays_zip(F.col("__list.at").alias("at"), states.alias("x")))
    return joined.select(*keys, zipped.alias("z")).select(*keys, F.col("z.at").alias("__at"), F.col("z.x").alias("__x"))


def _gathered(blocks: DataFrame, keys: list[str]) -> DataFrame:
    return blocks.groupBy(*keys, "__block").agg(
        F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__f").alias("f")))).alias("__list")
    )


#: What a pool has learned: the lasting mean, its samples and drift streak; inside an out-of-memory
#: episode also those on top of them.
LEARNED = "struct<mean: double, samples: bigint, drift: bigint, inside: boolean, e_mean: double, e_samples: bigint, e_drift: bigint>"


def rolling_correction(events: DataFrame, width: int = scan.CHUNK_MS, levels: int = LEVELS, fan: int = FAN, learned: DataFrame | None = None) -> DataFrame:
    """Learned correction per (service, pool) after each event.

    `events`: service, pool, seq (whole number, unique per service and pool),
    kind (`sample`, `oom`, `clean`), observed, base. A sample moves the mean by
    its ratio and the mean is clamped after every step. An OOM raises the mean
    and passes the trust gate at once; the next clean run restores what had
    been learned before the first OOM, so samples of such an episode never
    reach the lasting history. `learned` (service, pool, `state` of `LEARNED`)
    is what pools bring along; the last column, `state`, is what they have
    learned after each event.
    """
    keys = ["service", "pool"]
    ratio = F.when((F.col("kind") == "sample") & (F.col("base") > 0), F.col("observed") / F.col("base"))
    rows = events.withColumn("ratio", ratio).filter((F.col("kind") != "sample") | F.col("ratio").isNotNull())
    if learned is None:
        rows = rows.withColumn("__old", F.lit(None).cast(LEARNED))
    else:
        rows = rows.join(learned.select(*keys, F.col("state").alias("__old")), keys, "left")
    old = lambda name, default: F.coalesce(F.col(f"__old.{name}"), F.lit(default))
    rows = rows.withColumns({"__n0": old("samples", 0).cast("long"), "__m0": old("mean", 1.0), "__s0": old("drift", 0).cast("long"), "__in0": old("inside", False)})

    mark = F.when(F.col("kind").isin("oom", "clean"), F.col("kind"))
    seen = scan.running(rows, keys, ["seq"], {"__last": scan.last_seen(mark), "__before": scan.seen_before(mark)}, width)
    inside = F.coalesce(F.col("__last") == "oom", F.col("__in0"))
    opens = (F.col("kind") == "oom") & ~F.coalesce(F.col("__before") == "oom", F.col("__in0"))
    tagged = seen.withColumn("__in", inside)
    lasting = (F.col("kind") == "sample") & ~F.col("__in")
    tagged = scan.running(tagged, keys, ["seq"], {
        "episode": scan.total(F.when(opens, 1).otherwise(0).cast("long")),
        "__new": scan.total(F.when(lasting, 1).otherwise(0).cast("long")),
    }, width)
    tagged = tagged.withColumn("n_lasting", F.col("__n0") + F.col("__new"))
    tagged = settle(tagged.select(*keys, "seq", "kind", "ratio", "__in", "episode", "n_lasting", "__new", "__old", "__m0", "__s0"), "correction")

    # The lasting history: only samples outside an episode.
    base = tagged.filter(lasting).withColumn("__at", F.col("__new") - 1)
    n = F.col("n_lasting").cast("double")
    mean_step = _step((n - 1) / n, F.col("ratio") / n, F.lit(MEAN_LOW), F.lit(MEAN_HIGH))
    base = settle(clamped_fold(base, keys, "__at", mean_step, F.col("__m0"), "mean", levels, fan), "correction-base")
    far = F.abs(F.col("mean") - 1.0) > DRIFT_BAND
    base = scan.running(base, keys, ["seq"], {"__calm": scan.last_seen(F.when(~far, F.col("n_lasting")))}, width)
    run = F.when(F.col("__calm").isNull(), F.col("__s0") + F.col("__new")).otherwise(F.col("n_lasting") - F.col("__calm"))
    base = base.select(*keys, "seq", F.col("mean").alias("__m"), run.alias("__s"))
    all_rows = tagged.join(base, [*keys, "seq"], "left")
    all_rows = scan.running(all_rows, keys, ["seq"], {
        "base_mean": scan.last_seen(F.col("__m")), "base_streak": scan.last_seen(F.col("__s")),
    }, width)
    all_rows = all_rows.withColumn("base_mean", F.coalesce("base_mean", "__m0")).withColumn("base_streak", F.coalesce("base_streak", "__s0"))
    # An episode that was open before goes on from where it stood.
    goes_on = (F.col("episode") == 0) & F.col("__old.inside")
    all_rows = all_rows.withColumns({
        "__em0": F.when(goes_on, F.col("__old.e_mean")).otherwise(F.col("base_mean")),
        "__en0": F.when(goes_on, F.col("__old.e_samples")).otherwise(F.greatest(F.col("n_lasting"), F.lit(TRUSTED_SAMPLES))),
        "__es0": F.when(goes_on, F.col("__old.e_drift")).otherwise(F.col("base_streak")),
    })
    all_rows = settle(all_rows.drop("__m", "__s"), "correction-lasting")

    # Episodes: start from what was learned, then raise and sample on top.
    part = [*keys, "episode"]
    episode = all_rows.filter(F.col("__in"))
    episode = scan.running(episode, part, ["seq"], {
        "__row": scan.count(), "__taken": scan.total(F.when(F.col("kind") == "sample", 1).otherwise(0).cast("long")),
    }, width)
    en = (F.col("__en0") + F.col("__taken")).cast("double")
    raised = _step(F.lit(1.0), F.lit(0.0), F.lit(OOM_BUMP), F.lit(WIDE))
    sampled = _step((en - 1) / en, F.col("ratio") / en, F.lit(MEAN_LOW), F.lit(MEAN_HIGH))
    step = F.when(F.col("kind") == "oom", raised).otherwise(sampled)
    episode = clamped_fold(episode.withColumn("__at", F.col("__row") - 1), part, "__at", step, F.col("__em0"), "__em", levels, fan)
    episode = settle(episode, "correction-episodes")
    efar = F.abs(F.col("__em") - 1.0) > DRIFT_BAND
    episode = scan.running(episode, part, ["seq"], {
        "__ecalm": scan.last_seen(F.when((F.col("kind") == "sample") & ~efar, F.col("__taken"))),
    }, width)
    streak = F.when(F.col("__ecalm").isNull(), F.col("__es0") + F.col("__taken")).otherwise(F.col("__taken") - F.col("__ecalm"))
    episode = episode.select(*keys, "seq", "__em", streak.alias("__es"), en.cast("long").alias("__en"))

    out = all_rows.join(episode, [*keys, "seq"], "left").select(
        *keys, "seq", "kind", "ratio",
        F.coalesce("__em", "base_mean").alias("mean"),
        F.coalesce("__en", "n_lasting").alias("samples"),
        F.coalesce("__es", "base_streak").alias("drift_samples"),
        F.when(F.coalesce("__old.inside", F.lit(False)), F.col("__old.e_mean")).otherwise(F.col("__m0")).alias("__start"),
        F.struct(F.col("base_mean").alias("mean"), F.col("n_lasting").alias("samples"), F.col("base_streak").alias("drift"), F.col("__in").alias("inside"), F.col("__em").alias("e_mean"), F.col("__en").alias("e_samples"), F.col("__es").alias("e_drift")).alias("state"),
    )
    out = settle(out, "correction-all")
    out = scan.running(out, keys, ["seq"], {"__prev": scan.previous(F.col("mean"))}, width)
    prev = F.coalesce("__prev", "__start")
    sample = F.col("kind") == "sample"
    return out.select(
        *keys, "seq", "kind", "mean", "samples", "drift_samples",
        trusted_factor(F.col("mean"), F.col("samples")).alias("factor"),
        (sample & (F.col("drift_samples") >= DRIFT_ALERT)).alias("drift_alert"),
        (sample & (F.abs((F.col("mean") - prev) / prev) > DRIFT_EVENT)).alias("drift_event"),
        F.when(F.col("mean") > UNDER_ESTIMATE, "under-estimate").when(F.col("mean") < OVER_RESERVE, "over-reservation").otherwise("steady").alias("class"), "state",
    )


def trusted_factor(mean: Column, samples: Column) -> Column:
    return F.when(samples >= TRUSTED_SAMPLES, mean).otherwise(F.lit(1.0))


# --- peaks and memory windows ----------------------------------------------


def running_peaks(samples: DataFrame, keys: list[str], order: list[str], width: int = scan.CHUNK_MS) -> DataFrame:
    """Monotone peaks per service and run beside the current readings."""
    total = F.col("vram_bytes") + F.col("rss_total")
    return scan.running(samples, keys, order, {
        "peak_bytes": scan.highest(total),
        "peak_vram_bytes": scan.highest(F.col("vram_bytes")),
        "peak_rss_bytes": scan.highest(F.col("rss_total")),
        "peak_owned_bytes": scan.highest(F.col("rss_owned")),
        "peak_file_bytes": scan.highest(F.col("rss_file")),
    }, width)


def sample_windows(
    samples: DataFrame, keys: list[str], order: list[str], value: str, slot: str = "slot", size: int = WINDOW, width: int = scan.CHUNK_MS
) -> DataFrame:
    """The last `size` readings since the slot (null included) last changed, oldest first."""
    pair = F.struct(F.col(slot).alias("s"), F.col(value).alias("v"))
    rows = scan.trailing(samples, keys, order, pair, "__pairs", size, width)
    # Distance from the end of the newest reading taken on another slot.
    foreign = F.transform(
        "__pairs", lambda e, i: F.when(e["s"].eqNullSafe(F.col(slot)), F.lit(0)).otherwise(i + 1)
    )
    kept = F.slice("__pairs", F.array_max(foreign) + 1, F.lit(size))
    return rows.withColumn("window", F.transform(kept, lambda e: e["v"])).drop("__pairs")


def growth(window: Column, floor: Column) -> Column:
    """A rising window: whole-number slope above zero, mostly non-falling steps, and
    the next projected reading past the floor."""
    n = F.size(window).cast("long")
    at = F.transform(window, lambda v, i: F.struct(i.cast("long").alias("x"), v.cast("long").alias("y")))

    def add(f: Callable[[Column], Column]) -> Column:
        return F.aggregate(at, F.lit(0).cast("long"), lambda acc, e: acc + f(e))

    sx, sy = add(lambda e: e["x"]), add(lambda e: e["y"])
    sxy, sxx = add(lambda e: e["x"] * e["y"]), add(lambda e: e["x"] * e["x"])
    slope = whole_div(n * sxy - sx * sy, n * sxx - sx * sx)
    rising = F.aggregate(
        F.arrays_zip(F.slice(window, 1, F.greatest(F.size(window) - 1, F.lit(0))).alias("a"), F.slice(window, 2, F.greatest(F.size(window) - 1, F.lit(0))).alias("b")),
        F.lit(0).cast("long"),
        lambda acc, e: acc + F.when(e["b"] >= e["a"], 1).otherwise(0),
    )
    ready = n >= WINDOW // 2 + 1
    return F.when(~ready, F.lit(False)).otherwise(
        (slope > 0) & (rising * 2 > n - 1) & (F.element_at(window, -1) + slope > floor)
    )


def whole_div(a: Column, b: Column) -> Column:
    """Whole-number division towards zero, null on a zero divisor."""
    d = F.nullif(b, F.lit(0).cast("long"))
    quotient = (F.abs(a) - F.abs(a) % F.abs(d)) / F.abs(d)
    return (F.signum(a.cast("double")) * F.signum(d.cast("double")) * quotient).cast("long")


def floor_div(a: Column, b: int) -> Column:
    """Whole-number division, downwards."""
    return ((a - F.pmod(a, F.lit(b).cast("long"))) / b).cast("long")


def window_pledge(window: Column, min_mib: Column, max_mib: Column) -> Column:
    """Recent peak in whole MiB inside [min, max]."""
    peak = F.array_max(window)
    return F.least(F.greatest((peak - peak % MIB) / MIB, min_mib), max_mib).cast("long")


# --- hysteresis, grace periods and budgets ---------------------------------


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "step_no", width: int = scan.CHUNK_MS) -> DataFrame:
    """Number a key's rows from zero along the order."""
    return scan.running(df, keys, order, {name: scan.count()}, width).withColumn(name, F.col(name) - 1)


def pledge_band(wanted: Column, low: Column) -> tuple[Column, Column]:
    """The pledges (whole MiB, from, to) that a reading leaves as they are.

    A pledge moves when it lies on the other side of the minimum, or so far
    from the reading that the difference reaches the floor and the share of the
    pledge held.
    """
    share, whole = PLEDGE_PERMILLE, 1000
    # held - wanted < floor(held * share / whole), and wanted - held likewise, solved for held.
    up = F.greatest(wanted + (PLEDGE_FLOOR_MIB - 1), floor_div(whole * (wanted - 1), whole - share))
    down = F.least(wanted - (PLEDGE_FLOOR_MIB - 1), -floor_div(-whole * (wanted + 1), whole + share))
    return F.when(wanted > low, F.greatest(down, low + 1)).otherwise(down), F.when(wanted <= low, F.least(up, low)).otherwise(up)


def pledge_updates(samples: DataFrame, keys: list[str], fan: int = fold.FAN, held: Column | None = None) -> DataFrame:
    """Which pledge readings (numbered by `step_no`) are emitted, and the pledge then held.

    `held` is the pledge before a key's first reading, null for none: the first
    reading is then emitted.
    """
    wanted, least = F.col("pledge_mib").cast("long"), F.col("min_mib").cast("long")
    low, high = pledge_band(wanted, least)
    rows = samples.withColumns({"__low": low, "__high": high, "__from": F.lit(-fold.NOTHING) if held is None else F.coalesce(held, F.lit(-fold.NOTHING))})
    out = fold.held_fold(rows, keys, "step_no", F.col("__low"), F.col("__high"), wanted, wanted, F.col("__from"), "__held", fan)
    emitted = ~F.col("__held").between(F.col("__low"), F.col("__high"))
    return out.select(*keys, "step_no", emitted.alias("emitted"), F.when(emitted, wanted).otherwise(F.col("__held")).alias("held_mib"))


def ceiling_bytes(max_mib: Column) -> Column:
    scaled = max_mib.cast("long") * F.lit(MIB).cast("long") * CEILING_PERMILLE
    return ((scaled - scaled % 1000) / 1000).cast("long")


def ceiling_actions(samples: DataFrame, keys: list[str], fan: int = fold.FAN, slot: Column | None = None, since: Column | None = None) -> DataFrame:
    """Arm on the first reading above the ceiling, kill after the grace, disarm below; another slot starts anew.

    The state is the time of arming. `slot` and `since` are those before a
    key's first reading (null: none). Adds `action` and `since_ms`, the time of
    arming after the reading.
    """
    none = F.lit(fold.NOTHING)
    rows = scan.running(samples, keys, ["step_no"], {"__slot": scan.previous(F.struct(F.col("slot").alias("s")))}, fan)
    before = F.when(F.col("__slot").isNotNull(), F.col("__slot.s")).otherwise(F.lit(None).cast("string") if slot is None else slot)
    over = F.coalesce(F.col("enforceable") & (F.col("observed") > F.col("ceiling")), F.lit(False))
    rows = rows.withColumns({"__over": over, "__anew": ~before.eqNullSafe(F.col("slot")), "__from": none if since is None else F.coalesce(since, none)})
    over, anew, at = F.col("__over"), F.col("__anew"), F.col("at_ms").cast("long")
    # While it lasts, a breach keeps a time of arming inside the grace; whatever else came before is replaced.
    keeps = over & ~anew
    low = F.when(keeps, at - CEILING_GRACE_MS).otherwise(F.lit(fold.WIDEST))
    high = F.when(keeps, none - 1).otherwise(F.lit(-fold.WIDEST))
    below = F.when(over & anew, at).otherwise(none)
    above = F.when(over, at).otherwise(none)
    out = fold.held_fold(rows, keys, "step_no", low, high, below, above, F.col("__from"), "__since", fan)
    since_now = F.when(anew, none).otherwise(F.col("__since"))
    action = F.when(~over, "disarm").when(since_now == none, "arm").when(at - since_now > CEILING_GRACE_MS, "kill").otherwise("wait")
    after = F.when(action == "arm", at).when(action == "wait", since_now)
    return out.select(*keys, "step_no", action.alias("action"), after.alias("since_ms"))


def restart_budget(firings: DataFrame, keys: list[str], fan: int = 4096) -> DataFrame:
    """Outcome of each firing; a disabling one is recorded but does not use the budget.

    A firing restarts while fewer than three restarts lie in the window, else
    disables. Blocks of firings are folded from no restarts at first, and again
    where the block before ended with others; restarts age out of the window, so
    a quiet window ends that. Firings without one are walked block by block.
    """
    item = F.struct(F.col("step_no").alias("n"), F.col("at_ms").cast("long").alias("at"))
    rows = firings.withColumn("__block", F.expr(f"step_no div {int(fan)}")).select(*keys, "__block", item.alias("e"))
    part = [*keys, "__block"]
    blocks = settle(rows.groupBy(*part).agg(F.array_sort(F.collect_list("e")).alias("list")), "firings")
    empty = F.array().cast("array<bigint>")

    def step(acc: Column, e: Column) -> Column:
        kept = F.filter(acc["recent"], lambda t: e["at"] - t < FLAP_WINDOW_MS)
        free = F.size(kept) < FLAP_MAX
        seen = F.struct(e["n"].alias("n"), F.when(free, "restarted").otherwise("disabled").alias("outcome"), F.size(kept).alias("recent"))
        return F.struct(F.when(free, F.concat(kept, F.array(e["at"]))).otherwise(kept).alias("recent"), F.concat(acc["out"], F.array(seen)).alias("out"))

    def run(todo: DataFrame) -> DataFrame:
        start = F.struct(F.col("entry").alias("recent"), F.array().cast("array<struct<n: bigint, outcome: string, recent: int>>").alias("out"))
        return blocks.join(todo, part).select(*part, "entry", F.aggregate("list", start, step).alias("s")).select(*part, "entry", F.col("s.recent").alias("exit"), F.col("s.out").alias("out"))

    known = settle(run(blocks.select(*part, empty.alias("entry"))), "budget")
    while True:
        linked = known.withColumn("want", F.coalesce(F.lag("exit").over(Window.partitionBy(*keys).orderBy("__block")), empty))
        todo = settle(linked.where(~F.col("want").eqNullSafe(F.col("entry"))).select(*part, F.col("want").alias("entry")), "budget-todo")
        if todo.isEmpty():
            discard(todo)
            break
        again = settle(known.join(todo.select(*part), part, "left_anti").unionByName(run(todo)), "budget")
        for done in (known, todo):
            discard(done)
        known = again
    return known.select(*keys, F.explode("out").alias("o")).select(*keys, F.col("o.n").alias("step_no"), F.col("o.outcome").alias("outcome"), F.col("o.recent").alias("recent"))


# --- stalls and latches ----------------------------------------------------


def counter_stalls(polls: DataFrame, keys: list[str], timeout_ms: int = STALL_TIMEOUT_MS, width: int = scan.CHUNK_MS, order: tuple[str, ...] = ("at_ms", "poll_id"), value: Column | None = None, advance: Column | None = None) -> DataFrame:
    """Polls at which progress has been flat for the timeout with requests in flight.

    `polls`: keys, at_ms, poll_id, progress (null when unreadable), inflight;
    `order` is total within a key. An advance or a regression reseeds, an idle
    poll resets, a missing reading never fires. `value` and `advance` are the
    progress and the time it last moved before a key's first poll, null for
    none. Adds `flat_ms`, `stalled`, and both as they are after the poll.
    """
    nothing = F.lit(None).cast("bigint")
    known, moved_at = (nothing if c is None else c for c in (value, advance))
    rows = polls.withColumns({"__value": known, "__moved": moved_at})
    rows = scan.running(rows, keys, list(order), {"__prior": scan.seen_before(F.col("progress")), "__first": scan.lowest(F.col("at_ms"))}, width)
    prior = F.coalesce("__prior", "__value")
    moved = F.col("progress").isNotNull() & (prior.isNull() | (F.col("progress") != prior))
    reset = F.when(moved | (F.col("inflight") == 0), F.col("at_ms"))
    rows = scan.running(rows, keys, list(order), {"__advance": scan.last_seen(reset)}, width)
    since = F.coalesce("__advance", "__moved", "__first")
    flat = F.col("at_ms") - since
    fires = F.col("progress").isNotNull() & (F.col("inflight") > 0) & (flat >= timeout_ms)
    return rows.select(*polls.columns, flat.alias("flat_ms"), fires.alias("stalled"), F.coalesce("progress", "__prior", "__value").alias("value_after"), since.alias("advance_after"))


def acceptance_latch(ticks: DataFrame, keys: list[str], width: int = scan.CHUNK_MS, order: tuple[str, ...] = ("at_ms",)) -> DataFrame:
    """Once a run has accepted a draft token it stays armed, whatever retention removes. `order` is total within a key."""
    armed = F.when(F.col("run_accepted") > 0, 1).otherwise(0)
    rows = scan.running(ticks, keys, list(order), {"__armed": scan.highest(armed)}, width)
    return rows.withColumn("ever_accepted", F.col("__armed") > 0).drop("__armed")


def draft_windows(ticks: DataFrame, keys: list[str], window_ms: int, floor: int, width: int = scan.CHUNK_MS, earlier: Column | None = None, ever: Column | None = None) -> DataFrame:
    """Draft counts of the window that ends at each tick, and whether drafting has collapsed.

    `ticks`: keys, at_ms (unique within a key), drafted, accepted. A window
    collapses when enough was drafted, none accepted, and some had been before.
    `earlier` (array of at_ms, drafted, accepted) and `ever` are what a key
    brings along. Adds `window_drafted`, `window_accepted`, `collapsed`,
    `ticks_after` and `ever_after`.
    """
    one = F.struct(F.col("at_ms"), F.col("drafted").cast("bigint").alias("drafted"), F.col("accepted").cast("bigint").alias("accepted"))
    known = F.lit(False) if ever is None else F.coalesce(ever, F.lit(False))
    rows = scan.running(ticks.withColumn("__ever", known), keys, ["at_ms"], {"__now": scan.highest(F.when(F.col("accepted") > 0, 1).otherwise(0))}, width)
    new = rows.select(*keys, "at_ms", one.alias("__tick"), F.col("__ever") | (F.col("__now") > 0), F.lit(True).alias("__new")).toDF(*keys, "at_ms", "__tick", "__armed", "__new")
    if earlier is not None:
        # What a key brings along rides on its first tick.
        first = scan.running(ticks.withColumn("__earlier", earlier), keys, ["at_ms"], {"__n": scan.count()}, width).where("__n = 1")
        old = first.select(*keys, F.explode("__earlier").alias("__tick")).select(*keys, F.col("__tick.at_ms").alias("at_ms"), "__tick", F.lit(None).cast("boolean").alias("__armed"), F.lit(False).alias("__new"))
        new = new.unionByName(old)
    seen = scan.within(new, keys, "at_ms", F.col("__tick"), "__seen", window_ms, width).where("__new")
    total = lambda name: F.aggregate("__seen", F.lit(0).cast("bigint"), lambda acc, t: acc + F.coalesce(t[name], F.lit(0)))
    out = seen.select(*keys, "at_ms", total("drafted").alias("window_drafted"), total("accepted").alias("window_accepted"), F.col("__armed").alias("ever_after"), F.col("__seen").alias("ticks_after"))
    collapsed = (F.col("window_drafted") >= floor) & (F.col("window_accepted") == 0) & F.col("ever_after")
    return out.withColumn("collapsed", collapsed)
