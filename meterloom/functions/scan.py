"""Ordered per-key calculations that stay parallel inside one key.

A plain `Window.partitionBy(key)` sends a key's whole history to one task, so a
key that holds a third of the table becomes the job. Everything here works in
two levels instead: rows are spread by (key, time chunk), each chunk is scanned
on its own, chunk totals are combined into a carry per chunk, and the carry is
joined back on the columns the rows are already partitioned by.

The result does not depend on the chunk width; the width only sets how far a
busy key is spread.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_MS = 60_000
CHUNK = "__chunk"


@dataclass(frozen=True)
class Running:
    """One running value: what to carry along the order, and how."""

    kind: str
    value: Column | None = None


def count() -> Running:
    return Running("count")


def total(value: Column) -> Running:
    return Running("sum", value)


def highest(value: Column) -> Running:
    return Running("max", value)


def lowest(value: Column) -> Running:
    return Running("min", value)


def last_seen(value: Column) -> Running:
    """The latest non-null value so far, this row included."""
    return Running("last", value)


def seen_before(value: Column) -> Running:
    """The latest non-null value on an earlier row."""
    return Running("before", value)


def previous(value: Column) -> Running:
    """The value on the row before, null on a key's first row."""
    return Running("previous", value)


def chunked(df: DataFrame, order: list[str], width: int = CHUNK_MS) -> DataFrame:
    """Tag rows with the chunk of their leading order column (a whole number)."""
    return df.withColumn(CHUNK, F.expr(f"`{order[0]}` div {int(width)}"))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Running],
    width: int = CHUNK_MS,
) -> DataFrame:
    """Add running values per key; `order` must be total within a key.

    `order[0]` has to be a whole-number column. Keys must not be null.
    """
    named = {f"__in_{name}": spec for name, spec in values.items()}
    rows = chunked(df, order, width).select(
        "*", *[spec.value.alias(column) for column, spec in named.items() if spec.value is not None]
    )
    part = [*keys, CHUNK]
    at = F.struct(*order)

    totals = rows.groupBy(*part).agg(
        *[_chunk_total(spec.kind, column, at).alias(f"t{column}") for column, spec in named.items()]
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *part, *[_carry(spec.kind, f"t{column}").over(before).alias(f"c{column}") for column, spec in named.items()]
    )

    ordered = Window.partitionBy(*part).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select(
        "*",
        F.row_number().over(ordered).alias("__local_row"),
        *[_local(spec.kind, column, ordered, upto).alias(f"l{column}") for column, spec in named.items()],
    )
    joined = local.join(carry, part)
    return joined.select(
        *df.columns,
        *[_combine(spec.kind, f"c{column}", f"l{column}").alias(column[len("__in_"):]) for column, spec in named.items()],
    )


def _chunk_total(kind: str, column: str, at: Column) -> Column:
    match kind:
        case "count":
            return F.count(F.lit(1))
        case "sum":
            return F.sum(column)
        case "max":
            return F.max(column)
        case "min":
            return F.min(column)
        case "last" | "before":
            return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), at))
        case "previous":
            return F.max_by(F.struct(F.col(column).alias("v")), at)
    raise ValueError(f"unknown running value {kind}")


def _carry(kind: str, column: str) -> Column:
    match kind:
        case "count" | "sum":
            return F.sum(column)
        case "max":
            return F.max(column)
        case "min":
            return F.min(column)
    return F.last(column, ignorenulls=True)


def _local(kind: str, column: str, ordered: Window, upto: Window) -> Column:
    match kind:
        case "count":
            return F.row_number().over(ordered).cast("long")
        case "sum":
            return F.sum(column).over(upto)
        case "max":
            return F.max(column).over(upto)
        case "min":
            return F.min(column).over(upto)
        case "last":
            return F.last(column, ignorenulls=True).over(upto)
        case "before":
            return F.last(column, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return F.lag(column).over(ordered)


def _combine(kind: str, carry: str, local: str) -> Column:
    carried, here = F.col(carry), F.col(local)
    match kind:
        case "count":
            return F.coalesce(carried, F.lit(0)) + here
        case "sum":
            return F.coalesce(carried + here, carried, here)
        case "max":
            return F.greatest(carried, here)
        case "min":
            return F.least(carried, here)
        case "last" | "before":
            return F.coalesce(here, carried)
    return F.when(F.col("__local_row") == 1, carried["v"]).otherwise(here)


def trailing(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    name: str,
    size: int,
    width: int = CHUNK_MS,
) -> DataFrame:
    """Add the array of a key's last `size` values, oldest first, this row's last."""
    rows = chunked(df, order, width).withColumn("__v", F.struct(value.alias("v")))
    part = [*keys, CHUNK]
    newest = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
    tails = (
        rows.withColumn("__back", F.row_number().over(newest))
        .filter(F.col("__back") <= size - 1)
        .groupBy(*part)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("__back")).alias("p"), F.col("__v").alias("v")))).alias("__tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-(size - 1), -1)
    carry = tails.select(*part, F.flatten(F.collect_list("__tail").over(earlier)).alias("__carry"))
    here = Window.partitionBy(*part).orderBy(*order).rowsBetween(-(size - 1), 0)
    local = rows.withColumn("__here", F.collect_list("__v").over(here))
    joined = local.join(carry, part, "left")
    both = F.coalesce(
        F.concat(F.transform("__carry", lambda e: e["v"]), F.col("__here")),
        F.col("__here"),
    )
    last = F.slice(both, F.greatest(F.size(both) - size + 1, F.lit(1)), F.lit(size))
    return joined.select(*df.columns, F.transform(last, lambda e: e["v"]).alias(name))


def within(df: DataFrame, keys: list[str], at: str, value: Column, name: str, span: int, width: int = CHUNK_MS) -> DataFrame:
    """Add the array of a key's values with `at` in (at - span, at], oldest first.

    `at` is a whole number, unique within a key. A row also rides along in the
    next chunk, so chunks are at least as wide as the span; the span bounds the
    arrays.
    """
    wide = max(int(width), int(span))
    rows = df.withColumns({CHUNK: F.expr(f"cast(floor(`{at}` / {wide}) as bigint)"), "__v": value})
    held = rows.withColumn("__ride", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(CHUNK, F.col(CHUNK) + F.col("__ride"))
    seen = Window.partitionBy(*keys, CHUNK).orderBy(at).rangeBetween(-(span - 1), Window.currentRow)
    return held.withColumn(name, F.collect_list("__v").over(seen)).where("__ride = 0").select(*df.columns, name)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """A key's first `k` rows in the order given.

    For k below the optimiser's group-limit threshold Spark keeps only k rows
    per key and map task before the shuffle, so a busy key costs k rows a task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= k).drop("__rank")


def pick_per_key(df: DataFrame, keys: list[str], order: Column, latest: bool = True) -> DataFrame:
    """One whole row per key, by map-side combined `max_by` / `min_by`."""
    chooser = F.max_by if latest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), order).alias("__picked"))
    return picked.select(*keys, "__picked.*").select(*df.columns)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
