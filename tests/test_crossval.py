"""Folds against medians of the others, worked out plainly."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from meterloom.functions.reduce import without_each
from meterloom.plans import crossval as X


def others(rows):
    out = {}
    for m in {m for m, _ in rows if m is not None}:
        rest = [v for o, v in rows if o != m and v is not None]
        if rest and any(o == m and v is not None for o, v in rows):
            out[m] = (len(rest), min(rest), max(rest), statistics.median(rest))
    return out


def found(spark, rows):
    counts = spark.createDataFrame(rows, "model string, v double").where("v is not null").groupBy("model", "v").agg(F.count(F.lit(1)).alias("w"))
    return {r.model: (r.n, r.lowest, r.highest, r["median"]) for r in without_each(counts, "model", "v", "w").collect()}


@pytest.mark.parametrize("seed", range(6))
def test_what_the_others_hold(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e", None][: 2 + seed]
    # Every second case has many ties; one owner holds most of the rows.
    rows = [(rng.choice(names + ["a"] * 5), float(rng.randrange(4 if seed % 2 else 10_000))) for _ in range(rng.choice([2, 7, 400]))]
    assert found(spark, rows) == others(rows)


def test_edges(spark):
    assert found(spark, []) == {}
    assert found(spark, [("a", 1.0), ("a", 2.0)]) == {}
    rows = [("a", 1.0), ("b", None), (None, 3.0), (None, 5.0)]
    assert found(spark, rows) == others(rows) == {"a": (2, 3.0, 5.0, 4.0)}


def test_folds_of_a_consensus(spark):
    rows = [("a", 10.0), ("a", 10.5), ("b", 10.0), ("c", 30.0), ("d", None), (None, 10.0)]
    folds = {r.model: (r.full, r.without, r.alone) for r in X.consensus_folds(spark.createDataFrame(rows, "model string, v double"), "k").collect()}
    assert folds == {"a": (None, None, 10), "b": (None, None, 10), "c": (None, 10, 30), "d": (None, None, None)}
    agreed = [r for r in rows if r[0] != "c"]
    folds = {r.model: (r.full, r.without, r.alone) for r in X.consensus_folds(spark.createDataFrame(agreed, "model string, v double"), "k").collect()}
    assert folds == {"a": (10, 10, 10), "b": (10, 10, 10), "d": (10, 10, None)}
