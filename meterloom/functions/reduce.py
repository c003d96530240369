"""Reducing many measurements to one figure, and refusing when they disagree.

A refusal is a result, not an error: every reduction returns a status column,
so one bad group never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.session import discard, settle

DEFAULT_TOLERANCE = 0.15
OUTLIER_RATIO = 4.0

#: Values of a group that are sorted in one place; a larger group is narrowed down to that first.
SORTED = 16_384
#: Approximate quantiles that cut a group, and how finely the sketch that proposes them is built.
CUTS, SKETCH_ACCURACY = 64, 2_000


def rank_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """Exact order statistics per group without gathering a group in one task.

    `ranks` maps an output name to a 0-based rank expression over `n`, the
    number of non-null values. Values of a small group are sorted. A large one
    is cut at approximate quantiles from a mergeable sketch, values are counted
    between the cuts and at each cut (combined before the shuffle), and only the
    piece that holds a rank goes on, until it is small or a single value. The
    counts are exact, so the sketch decides how fast this ends and nothing else;
    least and greatest value are cuts too, so every round gets further.

    Returns the keys, `n`, `lowest`, `highest` and one column per rank. Groups
    without a value give no row.
    """
    rows = df.select(*keys, F.col(value).alias("__v")).filter(F.col("__v").isNotNull())
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lowest"), F.max("__v").alias("highest")).where("n > 0")
    stats = settle(stats, "rank-groups")
    large = stats.where(F.col("n") > SORTED)
    narrowed = not large.isEmpty()
    small = stats.where(F.col("n") <= SORTED)
    few = _null_safe_join(rows, small.select(*keys), keys) if narrowed else rows
    lists = few.groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias("__list"))
    out = _null_safe_join(small, lists, keys)
    out = out.select(*keys, "n", "lowest", "highest", *[F.element_at("__list", F.expr(f"cast({r} + 1 as int)")).alias(name) for name, r in ranks.items()])
    if not narrowed:
        return out
    picked = _narrowed(rows, large, keys, ranks)
    return out.unionByName(_null_safe_join(large, picked, keys).select(*out.columns))


def _narrowed(rows: DataFrame, groups: DataFrame, keys: list[str], ranks: dict[str, str]) -> DataFrame:
    """One column per rank of groups that are too large to be sorted."""
    kind = rows.schema["__v"].dataType
    nothing = F.lit(None).cast(kind)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(f"cast({r} as bigint)").alias("rank")) for name, r in ranks.items()]))
    # Where a rank is looked for: values above `low` and below `high` (null: no bound); `below` come before them.
    todo = groups.select(*keys, "n", wanted.alias("w")).select(*keys, F.col("w.name").alias("__name"), F.col("w.rank").alias("__rank"), nothing.alias("__low"), nothing.alias("__high"), F.lit(0).cast("long").alias("__below"), F.col("n").alias("__inside"), nothing.alias("__found"))
    part = [*keys, "__name"]
    known = settle(todo, "ranks")
    while True:
        todo = known.where(F.col("__found").isNull() & (F.col("__inside") > SORTED))
        if todo.isEmpty():
            break
        held = _held(rows, todo, keys)
        cuts = F.percentile_approx("__v", F.array(*[F.lit(k / CUTS) for k in range(CUTS + 1)]), SKETCH_ACCURACY)
        ends = held.groupBy(*part).agg(cuts.alias("__cuts"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
        # The sketch works on doubles: whole numbers it can't tell apart are halved instead.
        more = [F.col("__a"), F.col("__b")]
        if isinstance(kind, (T.IntegralType, T.DecimalType)):
            half = "__a div 2 + __b div 2" if isinstance(kind, T.IntegralType) else "__a / 2 + __b / 2"
            more.append(F.expr(half).cast(kind))
        grid = ends.select(*part, F.array_sort(F.array_distinct(F.concat(F.col("__cuts"), F.array(*more)))).alias("__grid"))
        placed = _null_safe_join(todo, grid, part)
        # Piece 2k lies below cut k, piece 2k + 1 is that cut itself.
        at = 2 * F.size(F.filter("__grid", lambda g: g < F.col("__v"))) + F.array_contains("__grid", F.col("__v")).cast("int")
        pieces = _held(rows, placed, keys).groupBy(*part, at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
        counted = pieces.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("__pieces"))
        start = F.struct(F.col("__below").alias("upto"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("below"), F.lit(None).cast("long").alias("n"))

        def walk(acc, e):
            here = acc["at"].isNull() & (F.col("__rank") < acc["upto"] + e["n"])
            return F.struct((acc["upto"] + e["n"]).alias("upto"), F.when(here, e["at"]).otherwise(acc["at"]).alias("at"), F.when(here, acc["upto"]).otherwise(acc["below"]).alias("below"), F.when(here, e["n"]).otherwise(acc["n"]).alias("n"))

        hit = _null_safe_join(placed, counted, part).withColumn("__hit", F.aggregate("__pieces", start, walk))
        k, cut = F.expr("__hit.at div 2").cast("int"), F.expr("__hit.at % 2 = 1")
        low = F.when(k > 0, F.get("__grid", k - 1)).otherwise(F.col("__low"))
        high = F.when(k < F.size("__grid"), F.get("__grid", k)).otherwise(F.col("__high"))
        step = hit.select(*part, "__rank", low.alias("__low"), high.alias("__high"), F.col("__hit.below").alias("__below"), F.col("__hit.n").alias("__inside"), F.when(cut, F.get("__grid", k)).alias("__found"))
        rest = known.where(F.col("__found").isNotNull() | (F.col("__inside") <= SORTED))
        after = settle(rest.unionByName(step), "ranks")
        discard(known)
        known = after
    short = known.where(F.col("__found").isNull())
    lists = _held(rows, short, keys).groupBy(*part).agg(F.array_sort(F.collect_list("__v")).alias("__list"))
    found = _null_safe_join(short, lists, part).select(*part, F.element_at("__list", (F.col("__rank") - F.col("__below") + 1).cast("int")).alias("__found"))
    whole = known.where(F.col("__found").isNotNull()).select(*part, "__found").unionByName(found)
    return whole.groupBy(*keys).agg(*[F.first(F.when(F.col("__name") == name, F.col("__found")), ignorenulls=True).alias(name) for name in ranks])


def _held(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """The values between each rank's bounds."""
    above, below = F.col("__low").isNull() | (F.col("__v") > F.col("__low")), F.col("__high").isNull() | (F.col("__v") < F.col("__high"))
    return _null_safe_join(rows, bounds, keys).where(above & below)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null, keeping the left side's key columns."""
    if not keys:
        # Without keys the right side is a global aggregate: one row, or one per rank.
        return left.withColumn("__one", F.lit(1)).join(F.broadcast(right.withColumn("__one", F.lit(1))), "__one").drop("__one")
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, condition).drop(*[f"__r_{k}" for k in keys])


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median: the mean of the two middle values on an even count."""
    return _middle(rank_values(df, keys, value, {"__a": "(n - 1) div 2", "__b": "n div 2"}))


def _middle(out: DataFrame) -> DataFrame:
    middle = (F.col("__a") + F.col("__b")) / F.lit(2.0)
    return out.withColumn("median", F.when(F.col("__a") == F.col("__b"), F.col("__a").cast("double")).otherwise(middle)).drop("__a", "__b")


def upper_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper middle value, which on an even count is not the median."""
    return rank_values(df, keys, value, {"upper_median": "n div 2"})


def without_each(counts: DataFrame, owner: str, value: str, weight: str) -> DataFrame:
    """Per owner the median and the extremes of what all the others hold.

    `counts`: one row per owner and value (not null) with the times it occurs.
    Rank r among the others is rank r + c among all, where c counts the owner's
    own values up to the last of them that has at most r values of others below
    it. So each owner asks for four ranks of one ordered table. The order is cut
    in ranges of values: counts run on inside a range, and what lies before it
    is one figure per range, or per range and owner. No owner and no whole is
    one task's work, and no value is repeated.

    Returns the owner, `n`, `lowest`, `highest` and `median` of the others; an
    owner without others gives no row, a null owner none of its own.
    """
    named = counts.select(F.col(owner).alias("__o"), F.col(value).alias("__v"), F.col(weight).cast("long").alias("__w"))
    ranged = settle(named.repartitionByRange("__v").withColumn("__part", F.spark_partition_id()), "ranges")
    # One row per range from here on.
    every = Window.partitionBy(F.lit(1))
    ahead = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").agg(F.sum("__w").alias("__w")).select("__part", F.coalesce(F.sum("__w").over(ahead), F.lit(0)).alias("__from"), F.sum("__w").over(every).alias("__all"))
    parts = settle(parts, "parts")
    inside = Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ranged.groupBy("__part", "__v").agg(F.sum("__w").alias("__w")).withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    ordered = settle(ordered.join(parts, "__part").select("__part", "__v", (F.col("__from") + F.col("__in")).alias("__below"), "__all"), "ordered")

    own = ranged.where("__o is not null")
    mine = Window.partitionBy("__o")
    carried = own.groupBy("__o", "__part").agg(F.sum("__w").alias("__w")).select(
        "__o", "__part", F.coalesce(F.sum("__w").over(mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"), F.sum("__w").over(mine).alias("__own")
    )
    run = Window.partitionBy("__o", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("__in", F.coalesce(F.sum("__w").over(run), F.lit(0))).join(carried, ["__o", "__part"]).join(ordered, ["__part", "__v"])
    own = own.select("__o", (F.col("__all") - F.col("__own")).alias("n"), (F.col("__from") + F.col("__in")).alias("__before"), "__w", "__below").where("n > 0")
    ranks = {"lowest": "cast(0 as bigint)", "__a": "(n - 1) div 2", "__b": "n div 2", "highest": "n - 1"}
    passed = {name: F.max(F.when(F.col("__below") - F.col("__before") <= F.expr(r), F.col("__before") + F.col("__w"))) for name, r in ranks.items()}
    asked = own.groupBy("__o", "n").agg(*[(F.coalesce(c, F.lit(0))).alias(name) for name, c in passed.items()])
    asked = asked.select("__o", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.col(name) + F.expr(r)).alias("at")) for name, r in ranks.items()])).alias("q"))
    asked = settle(asked.select("__o", "n", "q.name", F.col("q.at").alias("__at")), "asked")

    starts = parts.agg(F.array_sort(F.collect_list(F.struct("__from", "__part"))).alias("__starts"))
    located = _null_safe_join(asked.select("__at").distinct(), starts, []).select(F.element_at(F.filter("__starts", lambda s: s["__from"] <= F.col("__at")), -1)["__part"].alias("__part"), "__at")
    line = ordered.select("__part", F.col("__below").alias("__at"), F.lit(0).alias("__kind"), "__v").unionByName(located.select("__part", "__at", F.lit(1).alias("__kind"), F.lit(None).cast(ordered.schema["__v"].dataType).alias("__v")))
    upto = Window.partitionBy("__part").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("__v", F.last("__v", ignorenulls=True).over(upto)).where("__kind = 1").select("__at", "__v")
    out = asked.join(found, "__at").groupBy(F.col("__o").alias(owner), "n").agg(*[F.first(F.when(F.col("name") == name, F.col("__v")), ignorenulls=True).alias(name) for name in ranks])
    return _middle(out)


def verdict(median: Column, low: Column, high: Column, tolerance: float, floor: float) -> Column:
    """`ok`, or `disagree` when the spread is too wide for one value to describe."""
    spread = high - low
    accepted = (spread <= F.lit(float(floor))) | (median == 0)
    return F.when(median.isNull(), F.lit("no-data")).when(
        accepted | (F.try_divide(spread, F.abs(median)) <= F.lit(float(tolerance))), F.lit("ok")
    ).otherwise(F.lit("disagree"))


def consensus(
    df: DataFrame, keys: list[str], value: str, tolerance: float = DEFAULT_TOLERANCE, floor: float = 0.0
) -> DataFrame:
    """Median per group with a status; `disagree` where (max - min)/|median| is past tolerance.

    Returns keys, `n`, `lowest`, `highest`, `median`, `spread`, `status`.
    """
    out = medians(df, keys, value)
    return out.withColumn(
        "spread", F.try_divide(F.col("highest") - F.col("lowest"), F.abs("median"))
    ).withColumn("status", verdict(F.col("median"), F.col("lowest"), F.col("highest"), tolerance, floor))


def two_largest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count and the two largest values per group, by map-side combined maxima.

    The runner-up repeats the top when the top value occurs twice.
    """
    # A value's weight is enough: at weight two the top is its own runner-up.
    weights = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(
        F.count(F.lit(1)).alias("__w")
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("__v")) if keys else Window.partitionBy(F.lit(1)).orderBy(F.desc("__v"))
    top = weights.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= 2)
    best = top.groupBy(*keys).agg(
        F.max("__v").alias("top"),
        F.max(F.when(F.col("__rank") == 1, F.col("__w"))).alias("__top_w"),
        F.max(F.when(F.col("__rank") == 2, F.col("__v"))).alias("__second"),
    )
    counts = weights.groupBy(*keys).agg(F.sum("__w").alias("n"))
    return _null_safe_join(best, counts, keys).select(
        *keys, "n", "top", F.when(F.col("__top_w") > 1, F.col("top")).otherwise(F.col("__second")).alias("runner_up")
    )


def guarded_max(df: DataFrame, keys: list[str], value: str, ratio: float = OUTLIER_RATIO) -> DataFrame:
    """Maximum per group, refused where one value alone stands far above the rest."""
    out = two_largest(df, keys, value)
    alone = (
        (F.col("n") >= 3)
        & (F.col("runner_up") > 0)
        & (F.col("top") > 0)
        & (F.try_divide(F.col("top").cast("double"), F.col("runner_up").cast("double")) > F.lit(float(ratio)))
    )
    return out.withColumn("status", F.when(alone, F.lit("outlier")).otherwise(F.lit("ok")))


def half_even(value: Column) -> Column:
    """Whole number, ties to even."""
    return F.bround(value).cast("long")


def tenths_half_even(value: Column) -> Column:
    return F.bround(value * F.lit(10.0)).cast("long")


def worst_clamped(value: Column) -> Column:
    """Aggregate: the largest value, rounded half-even and never below zero."""
    return F.greatest(half_even(F.max(value)), F.lit(0).cast("long"))


def percent_error(value: Column, base: Column) -> Column:
    """Signed percent difference; null when the base is zero or a side is missing."""
    return F.when(base != 0, F.lit(100.0) * (value - base) / base)


def evidence(order: Column, text: Column, separator: str = ", ") -> Column:
    """Aggregate: per-key details joined in a fixed order.

    Meant for the rows left after a reduction (one per key), not for raw rows.
    """
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda e: e["t"]), separator)
