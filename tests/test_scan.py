import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterloom.functions import reduce as RD
from meterloom.functions import scan
from meterloom.operators import sequences as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # Key 0 holds about a third of all rows.
    data = [(0 if rng.random() < 0.33 else rng.randrange(1, 9), rng.randrange(400), i, rng.choice([None, *range(20)])) for i in range(900)]
    return spark.createDataFrame(data, "k bigint, t bigint, id bigint, v bigint").cache()


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_running_equals_plain_windows(rows, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    got = scan.running(rows, ["k"], ["t", "id"], {
        "n": scan.count(), "s": scan.total(F.col("v")), "hi": scan.highest(F.col("v")), "lo": scan.lowest(F.col("v")),
        "last": scan.last_seen(F.col("v")), "seen": scan.seen_before(F.col("v")), "prev": scan.previous(F.col("v")),
    }, width)
    want = rows.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("hi"), F.min("v").over(upto).alias("lo"),
        F.last("v", True).over(upto).alias("last"), F.last("v", True).over(before).alias("seen"), F.lag("v").over(w).alias("prev"),
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("width", [1, 50])
def test_trailing_equals_plain_window(rows, width):
    filled = rows.withColumn("v", F.coalesce("v", F.lit(-1)))
    got = scan.trailing(filled, ["k"], ["t", "id"], F.col("v"), "w", 6, width).select("id", "w")
    want = filled.select("id", F.collect_list("v").over(Window.partitionBy("k").orderBy("t", "id").rowsBetween(-5, 0)).alias("w"))
    assert dict(map(tuple, got.collect())) == dict(map(tuple, want.collect()))


def test_medians_are_exact_under_skew(spark):
    rng = np.random.default_rng(3)
    data = [("hot", float(x)) for x in rng.normal(size=4001)] + [("tied", 5.0)] * 700 + [("two", 1.0), ("two", 4.0), (None, 2.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(8)
    got = {r["k"]: r["median"] for r in RD.medians(df, ["k"], "v").collect()}
    for key in ("hot", "tied", "two", None):
        assert got[key] == np.median([v for k, v in data if k == key])
    assert RD.upper_medians(df.filter("k = 'two'"), [], "v").first()["upper_median"] == 4.0


@pytest.mark.parametrize("cuts, accuracy", [(8, 100), (64, 2_000)])
def test_large_groups_are_narrowed_to_the_same_ranks(spark, monkeypatch, cuts, accuracy):
    for name, v in (("SORTED", 40), ("CUTS", cuts), ("SKETCH_ACCURACY", accuracy)):
        monkeypatch.setattr(RD, name, v)
    rng = np.random.default_rng(cuts)
    data = [("even", int(x)) for x in rng.permutation(400)] + [("halves", 5)] * 100 + [("halves", 6)] * 100 + [("tied", 7)] * 150 + [("few", 1), ("few", 9)]
    data += [(None, int(x)) for x in rng.integers(0, 30, 401)] + [("big", (1 << 60) + int(x)) for x in rng.integers(0, 90, 200)]
    df = spark.createDataFrame(data, "k string, v bigint").repartition(6)
    got = {r["k"]: tuple(r)[1:] for r in RD.rank_values(df, ["k"], "v", {"a": "(n - 1) div 2", "b": "n div 2", "top": "n - 1"}).collect()}
    for key in {k for k, _ in data}:
        own = sorted(v for k, v in data if k == key)
        assert got[key] == (len(own), own[0], own[-1], own[(len(own) - 1) // 2], own[len(own) // 2], own[-1])
    one = RD.medians(df.where("k = 'even'"), [], "v").first()
    assert one["median"] == 199.5 and RD.medians(df.where("false"), [], "v").count() == 0


def test_consensus_refuses_and_accepts(spark):
    df = spark.createDataFrame([("t", 100.0), ("t", 101.0), ("t", 102.0), ("s", 28.0), ("s", 42.8), ("z", 0.1), ("z", 2.1)], "k string, v double")
    assert {r["k"]: r["status"] for r in RD.consensus(df, ["k"], "v").collect()} == {"t": "ok", "s": "disagree", "z": "disagree"}
    assert {r["k"]: r["status"] for r in RD.consensus(df, ["k"], "v", floor=4.0).collect()}["z"] == "ok"


def test_guarded_max(spark):
    rows = [("ok", 239), ("ok", 243), ("ok", 240), ("bad", 239), ("bad", 243), ("bad", 1632), ("few", 1), ("few", 90), ("twice", 90), ("twice", 90), ("twice", 1)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    assert {r["k"]: r["status"] for r in RD.guarded_max(df, ["k"], "v").collect()} == {"ok": "ok", "bad": "outlier", "few": "ok", "twice": "ok"}


def test_half_even(spark):
    got = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "v double").select(RD.half_even(F.col("v")).alias("v")).collect()
    assert [r["v"] for r in got] == [2, 4, -2]


@pytest.mark.parametrize("fan,levels", [(2, 3), (5, 2), (256, 2)])
def test_clamped_fold_levels(spark, fan, levels):
    rng = random.Random(fan)
    data = [(k, i, rng.uniform(0, 1), rng.uniform(-1, 1)) for k in range(3) for i in range([40, 1, 23][k])]
    df = spark.createDataFrame(data, "k bigint, at bigint, a double, b double")
    step = F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.lit(-0.4).alias("lo"), F.lit(0.6).alias("hi"))
    got = {(r["k"], r["at"]): r["x"] for r in S.clamped_fold(df, ["k"], "at", step, F.lit(0.25), "x", levels, fan).collect()}
    for k in range(3):
        x = 0.25
        for _, i, a, b in sorted(r for r in data if r[0] == k):
            x = min(max(a * x + b, -0.4), 0.6)
            assert got[k, i] == pytest.approx(x)


def test_trim_logs_ties_leave_together(spark):
    from meterloom.operators import telemetry as T

    day = 86_400_000
    logs = [(1, run, t, q, "stdout", "x") for run, t, q in [(1, 100, 0), (2, 100, 0), (1, 200, 1), (1, 300, 2), (2, 300, 2)]]
    logs += [(2, 9, t, t, "stdout", "y") for t in range(6)] + [(1, 1, -8 * day, 0, "stdout", "old")]
    df = spark.createDataFrame(logs, "service_id bigint, run_id bigint, timestamp_ms bigint, seq bigint, stream string, line string")
    live = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "service_id bigint, name string, deleted_at bigint")
    for width in (1, 60_000):
        kept = T.trim_logs(df, live, 0, cap=3, width=width)
        assert sorted((r["run_id"], r["timestamp_ms"]) for r in kept.filter("service_id = 1").collect()) == [(1, 200), (1, 300), (2, 300)]
        # A tombstoned service is not capped, only aged.
        assert kept.filter("service_id = 2").count() == 6
