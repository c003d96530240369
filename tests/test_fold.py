"""Folds of one whole number against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.functions import fold
from meterloom.operators import sequences as S

MIB = S.MIB


def plain(steps, state):
    seen = []
    for low, high, below, above in steps:
        seen.append(state)
        state = below if state < low else above if state > high else state
    return seen, state


def test_functions_of_blocks_compose():
    rng = np.random.default_rng(1)
    for n in [*range(1, 30), 64, 65]:
        low = rng.integers(-20, 20, n)
        high = low + rng.integers(-3, 15, n)
        below, above = rng.integers(-25, 25, (2, n))
        steps = list(zip(low.tolist(), high.tolist(), below.tolist(), above.tolist()))
        block, cut = fold.Block(low, high, below, above), n // 2
        whole = block.function()
        parts = fold.Block(low[:cut], high[:cut], below[:cut], above[:cut]).function().then(fold.Block(low[cut:], high[cut:], below[cut:], above[cut:]).function()) if cut else whole
        for state in range(-40, 41):
            seen, end = plain(steps, state)
            assert block.states(state).tolist() == seen
            assert whole.of(np.array([state]))[0] == parts.of(np.array([state]))[0] == end


@pytest.mark.parametrize("fan, wide, levels", [(1, 2, 3), (3, 2, 1), (4, 3, 0), (4096, 256, 2)])
def test_any_block_width_gives_the_same(spark, fan, wide, levels):
    rng = random.Random(fan)
    big = 1 << 60  # beyond what a double holds
    rows = [(k, i, big + rng.randrange(9), big + rng.randrange(5, 14), big + rng.randrange(14), big + rng.randrange(14)) for k in range(3) for i in range([50, 1, 17][k])]
    df = spark.createDataFrame(rows, "k bigint, at bigint, low bigint, high bigint, below bigint, above bigint").repartition(5)
    got = {(r["k"], r["at"]): r["state"] for r in fold.held_fold(df, ["k"], "at", *map(F.col, ("low", "high", "below", "above")), F.lit(-1), "state", fan, wide, levels).collect()}
    for k in range(3):
        seen, _ = plain([r[2:] for r in rows if r[0] == k], -1)
        assert [got[k, i] for i in range(len(seen))] == seen


def pledge(held, wanted, low):
    if held is None:
        return True
    far = max(S.PLEDGE_FLOOR_MIB, held * S.PLEDGE_PERMILLE // 1000)
    return min(held, wanted) <= low < max(held, wanted) or abs(wanted - held) >= far


def test_band_is_what_a_reading_leaves_alone(spark):
    rows = [(w, low) for w in (1, 255, 256, 257, 511, 512, 513, 5119, 5120, 5121, 5376, 9_999, 123_457) for low in (1, 512, 5200, 123_456)]
    made = spark.createDataFrame(rows, "w bigint, low bigint").select("w", "low", *[c.alias(n) for c, n in zip(S.pledge_band(F.col("w"), F.col("low")), "ab")]).collect()
    for w, low, a, b in made:
        near = {*range(max(0, w - 600), w + 600), *range(max(0, w * 19 // 20 - 300), w * 20 // 19 + 300)}
        assert {h for h in near if a <= h <= b} == {h for h in near if not pledge(h, w, low)}, (w, low)


@pytest.mark.parametrize("fan", [3, 4096])
def test_pledges_equal_one_pass(spark, fan):
    rng = random.Random(11)
    rows = [(k, i, rng.choice([600, 700, 1000, 1300, 512, 6000, 6250, 6320]), 512) for k in range(4) for i in range(31)]
    df = spark.createDataFrame(rows, "k bigint, step_no bigint, pledge_mib bigint, min_mib bigint").repartition(5)
    got = {(r["k"], r["step_no"]): (r["emitted"], r["held_mib"]) for r in S.pledge_updates(df, ["k"], fan).collect()}
    for k in range(4):
        held = None
        for _, i, w, low in (r for r in rows if r[0] == k):
            emit = pledge(held, w, low)
            held = w if emit else held
            assert got[k, i] == (emit, held)


@pytest.mark.parametrize("fan", [2, 4096])
def test_ceilings_equal_one_pass(spark, fan):
    rng = random.Random(5)
    rows = [(k, i, i * 7_000, rng.choice(["a", "a", "a", "a", "b", None]), rng.choice([5, 20, 20, 20, 20, 20]), 10, rng.choice([True] * 9 + [False, None])) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "k bigint, step_no bigint, at_ms bigint, slot string, observed bigint, ceiling bigint, enforceable boolean")
    got = {(r["k"], r["step_no"]): (r["action"], r["since_ms"]) for r in S.ceiling_actions(df, ["k"], fan).collect()}
    for k in range(3):
        since, last = None, None
        for _, i, at, slot, seen, top, on in (r for r in rows if r[0] == k):
            since = None if slot != last else since
            last = slot
            if not on or seen <= top:
                action, since = "disarm", None
            elif since is None:
                action, since = "arm", at
            elif at - since > S.CEILING_GRACE_MS:
                action, since = "kill", None
            else:
                action = "wait"
            assert got[k, i] == (action, since)
    assert {a for a, _ in got.values()} == {"disarm", "arm", "wait", "kill"}


@pytest.mark.parametrize("fan", [4, 64])
def test_budgets_equal_one_pass(spark, fan):
    rng = random.Random(8)
    times = {0: [60_000 * i for i in range(120)], 1: sorted(rng.randrange(20_000_000) for _ in range(60)), 2: [5]}  # the first without a quiet window
    df = spark.createDataFrame([(k, i, t) for k, ts in times.items() for i, t in enumerate(ts)], "k bigint, step_no bigint, at_ms bigint")
    got = {(r["k"], r["step_no"]): (r["outcome"], r["recent"]) for r in S.restart_budget(df, ["k"], fan).collect()}
    for k, ts in times.items():
        recent = []
        for i, t in enumerate(ts):
            recent = [x for x in recent if t - x < S.FLAP_WINDOW_MS]
            assert got[k, i] == ("restarted" if len(recent) < S.FLAP_MAX else "disabled", len(recent))
            recent += [t] if len(recent) < S.FLAP_MAX else []
