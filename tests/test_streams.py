"""Streams fed in several batches end where the batch operators end."""

import random

import pytest
from pyspark.sql import functions as F

from meterloom.catalog import streams
from meterloom.operators import sequences as S
from meterloom.streaming import steps
from meterloom.streaming import telemetry as ST
from meterloom.streaming.carried import run_carried, save_batch
from meterloom.streaming.keyed import run_to_table


def feed(spark, tmp_path, df, order, parts=3):
    """The rows as files in event order, one micro-batch each."""
    path = str(tmp_path / "in")
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_correction_stream_equals_batch_fold(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["sample"] * 8 + ["oom", "clean"]
    data = [(rng.randrange(2), "vram", i, rng.choice(kinds), rng.randrange(1, 200), rng.choice([0, 100, 100, 100])) for i in range(90)]
    df = spark.createDataFrame(data, "service bigint, pool string, seq bigint, kind string, observed bigint, base bigint")
    batch = {r["seq"]: r for r in S.rolling_correction(df, width=10, fan=4).collect()}
    got = run_carried(feed(spark, tmp_path, df, ["seq"]), ST.correction(width=10), "t8").collect()
    assert {r["seq"] for r in got} == set(batch)
    for r in got:
        b = batch[r["seq"]]
        assert r["mean"] == pytest.approx(b["mean"]) and (r["samples"], r["drift_samples"], r["drift_alert"], r["drift_event"]) == (b["samples"], b["drift_samples"], b["drift_alert"], b["drift_event"])


def test_stall_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    data = [(rng.randrange(3), i * 60_000, i, rng.choice([None, 1, 1, 1, 2]), rng.choice([0, 1, 1])) for i in range(80)]
    df = spark.createDataFrame(data, "service bigint, at_ms bigint, poll_id bigint, progress bigint, inflight bigint")
    want = {r["poll_id"]: (r["flat_ms"], r["stalled"]) for r in S.counter_stalls(df, ["service"], 240_000, width=300_000).collect()}
    got = run_carried(feed(spark, tmp_path, df, ["at_ms"]), ST.counter_stalls(240_000), "t5").collect()
    assert {r["poll_id"]: (r["flat_ms"], r["stalled"]) for r in got} == want


def test_log_numbers_go_on_across_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, i % 2, i, "stdout", str(i)) for i in range(20)], "service_id bigint, run_id bigint, timestamp_ms bigint, stream string, line string")
    got = run_carried(feed(spark, tmp_path, df, ["timestamp_ms"]), ST.log_numbers(), "t9").collect()
    assert sorted((r["run_id"], r["timestamp_ms"], r["seq"]) for r in got) == sorted((i % 2, i, i // 2) for i in range(20))


def run(step, rows, **kw):
    state, out = None, []
    for row in rows:
        state, found = step(state, row, **kw)
        out += found if isinstance(found, list) else [found] if found else []
    return out


def test_first_output_needs_a_silent_service():
    row = lambda kind, at, request=0: {"kind": kind, "at_ms": at, "request": request, "run_id": 7}
    # Request 2 waits behind request 1, whose frames keep coming.
    busy = [row("open", 0, 1), row("open", 1_000, 2), row("frame", 30_000, 1), row("frame", 55_000, 1), row("tick", 70_000)]
    assert run(steps.first_output_step, busy) == []
    silent = [row("frame", 0, 9), row("open", 1_000, 2), row("tick", 62_000)]
    assert run(steps.first_output_step, silent) == [{"request": "2", "run_id": 7, "at_ms": 61_000}]


def carried_rows(spark, how, df, batches, tmp_path):
    """The rows of a fold over batches (lists of values of the first order column), each run twice."""
    base = str(tmp_path / "carried")
    for n, values in enumerate(batches):
        for _ in range(2):
            save_batch(spark, how, base, df.where(F.col(how.order[0]).isin(values)), n)
    return spark.read.parquet(f"{base}/rows"), spark.read.parquet(f"{base}/carry/batch_id={len(batches) - 1}")


def test_collapse_needs_prior_acceptance(spark, tmp_path):
    never = [(1, 1, 0, 500, 0), (1, 1, 30_000, 500, 0)]
    fell = [(1, 2, 0, 500, 20), (1, 2, 30_000, 100, 0), (1, 2, 150_000, 150, 0), (1, 2, 180_000, 100, 0)]
    df = spark.createDataFrame(never + fell, "service_id bigint, run_id bigint, at_ms bigint, drafted bigint, accepted bigint")
    for n, batches in enumerate([[[0, 30_000, 150_000, 180_000]], [[0], [30_000], [150_000], [180_000]], [[0, 30_000, 150_000], [], [180_000]]]):
        rows, _ = carried_rows(spark, ST.draft_collapse(), df, batches, tmp_path / str(n))
        got = {(r["run_id"], r["at_ms"]): (r["window_drafted"], r["collapsed"]) for r in rows.collect()}
        assert got == {(1, 0): (500, False), (1, 30_000): (1000, False), (2, 0): (500, False), (2, 30_000): (600, False), (2, 150_000): (150, False), (2, 180_000): (250, True)}


def test_ended_runs_leave_the_carry(spark, tmp_path):
    day = 86_400_000
    df = spark.createDataFrame([(1, 1, 0, "a", "x"), (1, 2, 3 * day, "a", "x"), (1, 2, 9 * day, "a", "y")], "service_id bigint, run_id bigint, timestamp_ms bigint, stream string, line string")
    rows, carry = carried_rows(spark, ST.log_numbers(), df, [[0], [3 * day], [9 * day]], tmp_path)
    assert sorted((r["run_id"], r["seq"]) for r in rows.collect()) == [(1, 0), (2, 0), (2, 1)]
    assert [(r["run_id"], r["state"]["next"]) for r in carry.collect()] == [(2, 2)]


def test_whole_numbers_beyond_doubles_stay_exact(spark, tmp_path):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(1, big + i, i, big, 1) for i in range(4)], "service bigint, at_ms bigint, poll_id bigint, progress bigint, inflight bigint")
    rows, carry = carried_rows(spark, ST.counter_stalls(2), df, [[big, big + 1], [big + 2, big + 3]], tmp_path)
    assert sorted((r["at_ms"], r["flat_ms"], r["stalled"]) for r in rows.collect()) == [(big + i, i, i >= 2) for i in range(4)]
    assert carry.first()["state"]["value"] == big


def plain_memory(rows):
    """One service, sample by sample."""
    slot = held = since = None
    window, out = [], []
    for at, n, now, seen, on, low, high in rows:
        if now != slot:
            slot, window, since = now, [], None
        window = [*window, seen][-S.WINDOW :]
        pledge = min(max(max(window) // S.MIB, low), high)
        moves = held is None or min(held, pledge) <= low < max(held, pledge) or abs(pledge - held) >= max(S.PLEDGE_FLOOR_MIB, held * S.PLEDGE_PERMILLE // 1000)
        held = pledge if moves else held
        if not on or seen <= high * S.MIB * S.CEILING_PERMILLE // 1000:
            action, since = "disarm", None
        elif since is None:
            action, since = "arm", at
        elif at - since > S.CEILING_GRACE_MS:
            action, since, window = "kill", None, []
        else:
            action = "wait"
        out.append((n, pledge, held, moves, action))
    return out


def test_memory_over_batches_equals_one_pass(spark, tmp_path):
    rng = random.Random(3)
    rows = {k: [(i * 9_000, i, rng.choice(["g0"] * 12 + ["g1", None]), rng.choice([100, 900] + [1400] * 8) * S.MIB, rng.random() < 0.95, 128, 1000) for i in range(40)] for k in (1, 2)}
    df = spark.createDataFrame([(k, *r) for k, own in rows.items() for r in own], "service bigint, at_ms bigint, sample_id bigint, slot string, observed bigint, enforceable boolean, min_mib bigint, max_mib bigint")
    batches = [[i * 9_000 for i in part] for part in (range(1), range(1, 17), range(17, 40))]
    got, _ = carried_rows(spark, ST.memory(), df, batches, tmp_path)
    got = got.collect()
    for k in rows:
        mine = sorted((r["sample_id"], r["pledge_mib"], r["held_mib"], r["emitted"], r["action"]) for r in got if r["service"] == k)
        assert mine == plain_memory(rows[k])
    assert {r["action"] for r in got} == {"disarm", "arm", "wait", "kill"}


def test_periodic_restarts_stay_outside_the_budget():
    at = lambda t, kind, **kw: {"at_ms": t, "kind": kind, "trigger": "error_rate", "inflight": 1, **kw}
    rows = [at(0, "spawn"), *[at(60_000 * i, "firing") for i in range(1, 5)], at(200_000_000, "request")]
    got = [(d["trigger"], d["outcome"]) for d in run(steps.budget_step, rows)]
    assert got == [("error_rate", "restarted")] * 3 + [("error_rate", "disabled")]  # a firing ends the run, and its age limit with it
    calm = [at(0, "spawn"), at(50_000_000, "request"), at(90_000_000, "request")]
    assert [(d["at_ms"], d["trigger"]) for d in run(steps.budget_step, calm)] == [(86_400_000, "periodic")]
    idle = run(steps.budget_step, [at(0, "spawn"), at(90_000_000, "request"), at(90_000_001, "request", inflight=0)], mode="on_idle")
    assert [d["at_ms"] for d in idle] == [90_000_001]


def test_silence_fires_once_the_stream_has_moved_on(spark, tmp_path):
    rows = [("a", "open", 1, 7, 1_000), ("b", "frame", 2, 8, 50_000), ("b", "open", 3, 8, 61_000), ("b", "frame", 3, 8, 62_000), ("b", "tick", 3, 8, 900_000)]
    df = spark.createDataFrame(rows, "service string, kind string, request bigint, run_id bigint, at_ms bigint")
    got = run_to_table(ST.first_output_stalls(feed(spark, tmp_path, df, ["at_ms"], parts=5), delay="1 minute"), "silence").collect()
    assert [(r["service"], r["request"], r["at_ms"]) for r in got] == [("a", "1", 61_000)]


def test_streams_bring_their_own_state_store(spark, tmp_path):
    from meterloom.streaming.keyed import PROVIDER

    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    held = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, plain)
    try:
        df = spark.createDataFrame([("a", "spawn", "x", 1, 1_000), ("b", "request", "x", 1, 90_000_000)], "service string, kind string, trigger string, inflight bigint, at_ms bigint")
        got = run_to_table(ST.restart_decisions(feed(spark, tmp_path, df, ["at_ms"], parts=2)), "own-store").collect()
        assert [(r["service"], r["at_ms"], r["trigger"]) for r in got] == [("a", 86_401_000, "periodic")]
        assert spark.conf.get(PROVIDER) == plain
    finally:
        spark.conf.set(PROVIDER, held)


@pytest.mark.parametrize("folder", [False, True])
def test_table_streams_whether_a_file_or_a_folder(spark, tmp_path, folder):
    rows = [(i // 6, i % 6, "user", f"line {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    df.repartition(3).write.parquet(str(tmp_path / "parts"))
    if folder:
        (tmp_path / "parts").rename(tmp_path / "conversations.parquet")
    else:
        df.toPandas().to_parquet(tmp_path / "conversations.parquet")
    got = streams.QUERIES["t9_log_sequences"](spark, str(tmp_path)).collect()
    assert {(r["run_id"], r["seq"]) for r in got} == {(c, t) for c, t, _, _ in rows} and len(got) == 30


def test_stream_without_files_gives_no_rows(spark, tmp_path):
    schema = "service_id bigint, run_id bigint, timestamp_ms bigint, stream string, line string"
    (tmp_path / "none").mkdir()
    got = run_carried(spark.readStream.schema(schema).parquet(str(tmp_path / "none")), ST.log_numbers(), "none")
    assert got.columns == ["service_id", "run_id", "timestamp_ms", "seq", "stream", "line"] and got.count() == 0
