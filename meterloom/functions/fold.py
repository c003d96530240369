"""Ordered folds whose state is one whole number that a row keeps or replaces.

Hysteresis and grace periods are of this kind: a row keeps a state that lies
between two bounds, and replaces a smaller or a larger one by a value of its own.
Such steps are piecewise functions, and one after another they are a piecewise
function again. So a history is folded in blocks, blocks in blocks of blocks, and
the state that each block starts from comes back down. The number of rounds
depends on the length of the history alone, never on what the rows do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: No bound on this side, and a state that no row's value can equal.
WIDEST = (1 << 62) - 1
NOTHING = 1 << 61
#: Rows of a block, blocks of the next block, and levels of blocks of blocks.
FAN, WIDE_FAN, LEVELS = 4096, 256, 2


@dataclass(frozen=True)
class Pieces:
    """A function of a whole number: between cuts it keeps its argument or has one value."""

    cuts: np.ndarray
    keep: np.ndarray
    value: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cuts, x, "right")
        return np.where(self.keep[at], x, self.value[at])

    def then(self, after: Pieces) -> Pieces:
        inside = self.keep[np.searchsorted(self.cuts, after.cuts, "right")]
        cuts = np.union1d(self.cuts, after.cuts[inside])
        lowest = _lowest(cuts)
        mine = np.searchsorted(self.cuts, lowest, "right")
        there = np.searchsorted(after.cuts, lowest, "right")
        kept = self.keep[mine]
        return _merged(cuts, kept & after.keep[there], np.where(kept, after.value[there], after.of(self.value[mine])))


def _lowest(cuts: np.ndarray) -> np.ndarray:
    """An argument inside each piece."""
    return np.concatenate([[cuts[0] - 1 if len(cuts) else 0], cuts]).astype(np.int64)


def _merged(cuts: np.ndarray, keep: np.ndarray, value: np.ndarray) -> Pieces:
    """Neighbouring pieces that do the same are one."""
    value = np.where(keep, 0, value)
    fresh = (keep[1:] != keep[:-1]) | (value[1:] != value[:-1])
    first = np.concatenate([[True], fresh])
    return Pieces(cuts[fresh].astype(np.int64), keep[first], value[first].astype(np.int64))


class Block:
    """Rows in order: each keeps a state in [low, high], else makes it `below` or `above`."""

    def __init__(self, low: np.ndarray, high: np.ndarray, below: np.ndarray, above: np.ndarray):
        self.n, self.low, self.high = len(low), low, high
        self.most, self.least = [low], [high]
        while 2 ** len(self.most) <= self.n:
            half = 2 ** (len(self.most) - 1)
            self.most.append(np.maximum(self.most[-1][:-half], self.most[-1][half:]))
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
        # A node is a row that has replaced the state, from below (its number) or from above (n more).
        self.value = np.concatenate([below, above])
        self.after = self.replacing(np.tile(np.arange(1, self.n + 1), 2), self.value)

    def replacing(self, start: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The node that replaces each state first, from the given row on; 2n if none does."""
        at = start.copy()
        for k in reversed(range(len(self.most))):
            fits = at + 2**k <= self.n
            here = np.where(fits, at, 0)
            fits &= (self.most[k][here] <= state) & (self.least[k][here] >= state)
            at = np.where(fits, at + 2**k, at)
        row = np.minimum(at, self.n - 1)
        return np.where(at == self.n, 2 * self.n, np.where(self.low[row] > state, row, row + self.n))

    def function(self) -> Pieces:
        end = 2 * self.n
        last = np.where(self.after == end, np.arange(end), self.after)
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        least = np.minimum.accumulate(self.high)
        cuts = np.unique(np.concatenate([np.maximum.accumulate(self.low), least + 1]))
        lowest = _lowest(cuts)
        node = self.replacing(np.zeros(len(lowest), np.int64), lowest)
        keep = node == end
        return _merged(cuts, keep, np.where(keep, 0, self.value[last[np.minimum(node, end - 1)]]))

    def states(self, entry: int) -> np.ndarray:
        """The state before each row."""
        first = int(self.replacing(np.zeros(1, np.int64), np.array([entry]))[0])
        hit = np.zeros(2 * self.n + 1, bool)
        hit[first] = True
        jump = np.append(self.after, 2 * self.n)
        while True:  # what is reached in 1, 2, 4, … replacements
            reached = hit.copy()
            reached[jump[hit]] = True
            if (reached == hit).all():
                break
            hit, jump = reached, jump[jump]
        rows = np.flatnonzero(hit[: 2 * self.n])
        node = np.full(self.n + 1, -1)
        node[rows % self.n + 1] = rows
        seen = np.maximum.accumulate(np.where(node >= 0, np.arange(self.n + 1), -1))[: self.n]
        return np.where(seen >= 0, self.value[node[np.maximum(seen, 0)]], entry)


def _columns(table: pa.Table, names: tuple) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _functions(table: pa.Table) -> tuple[pa.Table, list[Pieces]]:
    """The blocks of a table in order, and their functions."""
    table = table.sort_by("__block")
    lists = [[np.asarray(x) for x in table.column(n).to_pylist()] for n in ("__cuts", "__keep", "__value")]
    return table, [Pieces(c.astype(np.int64), k.astype(bool), v.astype(np.int64)) for c, k, v in zip(*lists)]


def _written(head: pa.Table, block: str, f: Pieces, keys: list[str]) -> pa.Table:
    out = {k: head.column(k).slice(0, 1) for k in keys} | {"__block": head.column(block).slice(0, 1)}
    out |= {"__cuts": pa.array([f.cuts], pa.list_(pa.int64())), "__keep": pa.array([f.keep], pa.list_(pa.bool_())), "__value": pa.array([f.value], pa.list_(pa.int64()))}
    return pa.table(out)


def held_fold(df: DataFrame, keys: list[str], at: str, low: Column, high: Column, below: Column, above: Column, start: Column, name: str, fan: int = FAN, wide: int = WIDE_FAN, levels: int = LEVELS) -> DataFrame:
    """Add the state before each row.

    `at` numbers a key's rows from zero. A row keeps a state in [low, high],
    makes a smaller one `below` and a larger one `above`; with low above high
    every state is replaced. All are whole numbers no larger than `WIDEST` in
    size; `start` is constant within a key. Keys must not be null. No task sees
    more than a block of `fan` rows or the functions of `wide` blocks.
    """
    spark_keys = [df.schema[k] for k in keys]
    steps = ("__low", "__high", "__below", "__above")
    slim = df.select(*keys, F.col(at).cast("long").alias("__at"), *[c.cast("long").alias(n) for c, n in zip((low, high, below, above), steps)], start.cast("long").alias("__start"))
    rows = slim.withColumn("__block", F.expr(f"__at div {int(fan)}"))
    lists = [T.StructField("__cuts", T.ArrayType(T.LongType())), T.StructField("__keep", T.ArrayType(T.BooleanType())), T.StructField("__value", T.ArrayType(T.LongType()))]
    block = T.StructField("__block", T.LongType())
    kind = T.StructType([*spark_keys, block, *lists])

    def folded(table: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        return _written(table, "__block", Block(*_columns(table, steps)).function(), keys)

    functions = rows.select(*keys, "__block", "__at", *steps).groupBy(*keys, "__block").applyInArrow(folded, kind)
    starts = slim.groupBy(*keys).agg(F.first("__start").alias("__state"))
    entries = _entries(functions, starts, keys, kind, wide, levels)

    out = T.StructType([*spark_keys, T.StructField("__at", T.LongType()), T.StructField(name, T.LongType())])

    def unfolded(table: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        states = Block(*_columns(table, steps)).states(table.column("__state")[0].as_py())
        return pa.table({k: table.column(k) for k in [*keys, "__at"]} | {name: pa.array(states, pa.int64())})

    made = rows.drop("__start").join(entries, [*keys, "__block"]).groupBy(*keys, "__block").applyInArrow(unfolded, out)
    return df.join(made.withColumnRenamed("__at", at), [*keys, at])


def _entries(functions: DataFrame, starts: DataFrame, keys: list[str], kind: T.StructType, wide: int, levels: int) -> DataFrame:
    """The state (`__state`) that each block starts from."""
    grouped = functions.withColumn("__up", F.expr(f"__block div {int(wide)}") if levels else F.lit(0).cast("long"))
    if levels:

        def composed(table: pa.Table) -> pa.Table:
            table, parts = _functions(table)
            f = parts[0]
            for g in parts[1:]:
                f = f.then(g)
            return _written(table, "__up", f, keys)

        above = _entries(grouped.groupBy(*keys, "__up").applyInArrow(composed, kind), starts, keys, kind, wide, levels - 1)
        held = grouped.join(above.withColumnRenamed("__block", "__up"), [*keys, "__up"])
    else:
        held = grouped.join(starts, keys)

    def pushed(table: pa.Table) -> pa.Table:
        table, parts = _functions(table)
        state, out = table.column("__state")[0].as_py(), []
        for f in parts:
            out.append(state)
            state = int(f.of(np.array([state]))[0])
        return pa.table({k: table.column(k) for k in [*keys, "__block"]} | {"__state": pa.array(out, pa.int64())})

    schema = T.StructType([*[kind[k] for k in keys], T.StructField("__block", T.LongType()), T.StructField("__state", T.LongType())])
    return held.groupBy(*keys, "__up").applyInArrow(pushed, schema)
