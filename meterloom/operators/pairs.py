"""Twin measurements: rows that differ in one factor, matched on all the others.

Both halves come out of one grouped aggregate, so a pair costs a single
map-side combined shuffle, null keys match null keys, and a group never emits
more than one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.reduce import medians
from meterloom.session import settle


def pair_twins(
    rows: DataFrame, keys: list[str], half: Column, a, b, value: Column, position: str, keep: str = "last"
) -> DataFrame:
    """Per key the value of the `a` half and of the `b` half, both present.

    `keep` says which row stands for a half that occurs several times: the
    `first` or the `last` read, or the `max` value.
    """
    tagged = rows.withColumn("__half", half).withColumn("__value", value)

    def side(level) -> Column:
        mine = F.when(F.col("__half").eqNullSafe(F.lit(level)), F.col("__value"))
        at = F.when(F.col("__half").eqNullSafe(F.lit(level)), F.col(position)) if keep != "max" else None
        if keep == "first":
            return F.min_by(mine, at)
        if keep == "last":
            return F.max_by(mine, at)
        return F.max(mine)

    paired = tagged.filter(F.col("__half").isin([a, b]) if not isinstance(a, bool) else F.col("__half").isNotNull())
    paired = paired.groupBy(*keys).agg(side(a).alias("a"), side(b).alias("b"))
    return paired.filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def pair_medians(rows: DataFrame, keys: list[str], half: str, a: str, b: str, value: str) -> DataFrame:
    """Per key the median of each half, both present."""
    narrow = settle(rows.filter(F.col(half).isin([a, b])).select(*keys, half, value), "pair-medians")
    mids = medians(narrow, [*keys, half], value)
    sides = mids.groupBy(*keys).agg(
        F.max(F.when(F.col(half) == a, F.col("median"))).alias("a"), F.max(F.when(F.col(half) == b, F.col("median"))).alias("b")
    )
    return sides.filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def same_sitting(pairs: DataFrame, a_at: str, b_at: str, within_ms: int = 3_600_000) -> DataFrame:
    return pairs.filter(F.abs(F.col(a_at) - F.col(b_at)) <= within_ms)


def rate_lookup(rows: DataFrame, key: Column, rates: DataFrame, default: Column | float, name: str = "rate") -> DataFrame:
    """Rate by key with a default for keys nobody listed.

    `rates`: key, value.
    """
    listed = rates.select(F.col("key").alias("__key"), F.col("value").alias("__rate"))
    default = default if isinstance(default, Column) else F.lit(default)
    joined = rows.withColumn("__want", key).join(listed, F.col("__want") == F.col("__key"), "left")
    return joined.select(*rows.columns, F.coalesce("__rate", default).alias(name))


def worst_rate(rates: DataFrame):
    """The largest listed rate (one row), the usual default."""
    found = rates.agg(F.max("value")).first()[0]
    return 0 if found is None else found


def coefficient_lookup(rows: DataFrame, entries: DataFrame, default: dict[str, float]) -> DataFrame:
    """Coefficients in three tiers: for this runtime, for any runtime, the pooled default.

    `rows`: runtime, split, arch, variant. Row and tensor splits share an entry.
    `entries`: runtime (null = any), split, arch, variant, coefficients (struct).
    """
    split = F.when(F.col("split").isin("tensor", "row"), F.lit("tensor")).otherwise(F.lit("layer"))
    special = F.when(F.col("runtime") == "ik", F.lit("ik"))
    wide = rows.withColumn("__split", split).withColumn("__runtime", special)
    e = entries.select(*[F.col(c).alias(f"__e_{c}") for c in ("runtime", "split", "arch", "variant", "coefficients")])
    match = (F.col("arch") == F.col("__e_arch")) & (F.col("__split") == F.col("__e_split")) & F.col("variant").eqNullSafe(F.col("__e_variant"))
    own = e.filter(F.col("__e_runtime").isNotNull())
    first = wide.join(own, match & (F.col("__runtime") == F.col("__e_runtime")), "left").withColumn("__own", F.col("__e_coefficients"))
    first = first.drop("__e_runtime", "__e_split", "__e_arch", "__e_variant", "__e_coefficients")
    shared = e.filter(F.col("__e_runtime").isNull())
    second = first.join(shared, match, "left")
    fallback = F.struct(*[F.lit(float(v)).alias(k) for k, v in default.items()])
    found = F.coalesce("__own", "__e_coefficients", fallback)
    tier = F.when(F.col("__own").isNotNull(), "runtime").when(F.col("__e_coefficients").isNotNull(), "shared").otherwise("default")
    return second.select(*rows.columns, found.alias("coefficients"), tier.alias("tier"))


__all__ = ["pair_twins", "pair_medians", "same_sitting", "rate_lookup", "worst_rate", "coefficient_lookup"]
