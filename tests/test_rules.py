"""Literal cases for thresholds, refusals and text formats."""

import json

import pytest
from pyspark.sql import functions as F

from meterloom.functions import columns as C
from meterloom.functions import records as R
from meterloom.operators import extract as E
from meterloom.operators import hygiene as H
from meterloom.operators import sequences as S
from meterloom.operators import telemetry as T
from meterloom.plans import derive as D
from meterloom.plans import fit as M
from meterloom.session import METHOD_CONF
from meterloom.sources import measurements as records
from meterloom.sources import stores

METRIC = stores.REQUEST_METRICS


def metric(**kw):
    base = {f: None for f in METRIC.fieldNames()} | {"metric_id": 1, "service_id": 1, "run_id": 1, "timestamp_ms": 1000, "endpoint": "/", "model": "m", "status_code": 200}
    return tuple({**base, **kw}[f] for f in METRIC.fieldNames())


def rollup(spark, rows):
    services = spark.createDataFrame([(1, "demo", 0, None)], "service_id bigint, name string, created_at bigint, deleted_at bigint")
    return T.request_rollup(spark.createDataFrame(rows, METRIC), services, 60_000).collect()


def test_rate_tiers_prefer_engine_figures(spark):
    row = rollup(spark, [metric(prompt_tokens=100, completion_tokens=50, prompt_eval_tokens=20, duration_ms=2000, ttft_ms=500, prompt_ms=250, predicted_ms=1000)])[0]
    assert (row["output_tps"], row["input_tps"], row["effective_tps"]) == (50.0, 80.0, 25.0)
    row = rollup(spark, [metric(prompt_tokens=100, completion_tokens=50, duration_ms=2000, ttft_ms=500)])[0]
    assert row["output_tps"] == pytest.approx(50 / 1.5) and row["input_tps"] == 200.0
    row = rollup(spark, [metric(prompt_tokens=100, completion_tokens=50, duration_ms=2000)])[0]
    assert (row["output_tps"], row["input_tps"], row["effective_tps"]) == (None, None, 25.0)


def test_no_tokens_is_null_not_zero(spark):
    row = rollup(spark, [metric(prompt_tokens=0, completion_tokens=0, duration_ms=900, ttft_ms=100, status_code=500)])[0]
    assert (row["output_tps"], row["input_tps"], row["effective_tps"], row["error_count"]) == (None, None, None, 1)


def test_orphans_keep_a_null_name(spark):
    assert rollup(spark, [metric(service_id=9)])[0]["service"] is None


def test_error_rate_is_scoped_to_run_and_window(spark):
    rows = [metric(run_id=1, status_code=500, timestamp_ms=5), metric(run_id=1, status_code=404, timestamp_ms=50), metric(run_id=1, status_code=500, timestamp_ms=60), metric(run_id=2, status_code=500, timestamp_ms=70)]
    got = {r["run_id"]: (r["total"], r["errors"]) for r in T.run_error_rate(spark.createDataFrame(rows, METRIC), 10).collect()}
    assert got == {1: (2, 1), 2: (1, 1)}


def test_draft_window_uses_completion_time(spark):
    rows = [metric(draft_tokens=300, draft_tokens_accepted=0, timestamp_ms=100, duration_ms=900), metric(draft_tokens=10, draft_tokens_accepted=4, timestamp_ms=100, duration_ms=100), metric(timestamp_ms=990)]
    r = T.draft_acceptance(spark.createDataFrame(rows, METRIC), 900).first()
    assert (r["window_drafting"], r["window_drafted"], r["window_accepted"], r["run_accepted"]) == (1, 300, 0, 4)


def test_tally_survives_the_history_cap(spark):
    schema = "restart_id bigint, service_id bigint, run_id bigint, at_ms bigint, trigger_name string, detail string"
    firings = spark.createDataFrame([(i, 1, 1, i, "periodic" if i % 2 else "error_rate", "") for i in range(70)], schema)
    assert T.cap_restart_history(firings).count() == 50
    tally = T.merge_tally(T.restart_tally(firings.filter("at_ms < 30")), firings.filter("at_ms >= 30"))
    assert {r["trigger_name"]: r["count"] for r in tally.collect()} == {"periodic": 35, "error_rate": 35}


def test_gap_fill_edges(spark):
    one = spark.createDataFrame([("a", 1000, 5.0)], "k string, ts bigint, value double")
    got = sorted((r["ts"], r["value"]) for r in T.zero_fill_gaps(one, "k", "ts", "value", 0, 2000).collect())
    assert got == [(0, 0.0), (999, 0.0), (1000, 5.0), (1001, 0.0), (2000, 0.0)]


def test_durations_and_buckets():
    assert C.duration_ms("5m") == 300_000 and C.duration_ms("200ms") == 200 and C.bucket_for_span(C.duration_ms("1h")) == "1m"


# --- rolling correction ----------------------------------------------------

EVENTS = "service bigint, pool string, seq bigint, kind string, observed bigint, base bigint"


def correct(spark, rows, **kw):
    df = spark.createDataFrame([(1, pool, i, kind, o, b) for i, (pool, kind, o, b) in enumerate(rows)], EVENTS)
    return {r["seq"]: r for r in S.rolling_correction(df, **kw).collect()}


def test_mean_is_clamped_after_every_step(spark):
    got = correct(spark, [("vram", "sample", 200, 100), ("vram", "sample", 10, 100), ("vram", "sample", 120, 100)], width=1, fan=2)
    assert got[0]["mean"] == pytest.approx(1.5) and got[1]["mean"] == pytest.approx(0.8) and got[2]["mean"] == pytest.approx(0.9333333)
    assert [got[i]["factor"] for i in (0, 1)] == [1.0, 1.0] and got[2]["factor"] == pytest.approx(0.9333333)


def test_pools_are_independent_and_zero_bases_skip(spark):
    got = correct(spark, [("vram", "sample", 120, 100)] * 5 + [("host", "sample", 90, 100), ("host", "sample", 5, 0)])
    assert got[4]["mean"] == pytest.approx(1.2) and got[5]["mean"] == pytest.approx(0.9) and 6 not in got


def test_oom_episode_is_undone_by_a_clean_run(spark):
    rows = [("vram", "sample", 110, 100), ("vram", "oom", None, None), ("vram", "sample", 130, 100), ("vram", "oom", None, None), ("vram", "clean", None, None), ("vram", "sample", 130, 100)]
    got = correct(spark, rows)
    assert (got[1]["mean"], got[1]["samples"], got[1]["factor"]) == (pytest.approx(1.4), 3, pytest.approx(1.4))
    assert got[2]["mean"] == pytest.approx((1.4 * 3 + 1.3) / 4)
    assert (got[4]["mean"], got[4]["samples"]) == (pytest.approx(1.1), 1)
    assert got[5]["mean"] == pytest.approx(1.2)


# --- memory windows --------------------------------------------------------


def test_window_resets_when_the_slot_changes(spark):
    slots = ["g0", "g0", None, "g0", "g0", "g1"]
    df = spark.createDataFrame([(1, i, s, i) for i, s in enumerate(slots)], "k bigint, t bigint, slot string, v bigint")
    got = {r["t"]: r["window"] for r in S.sample_windows(df, ["k"], ["t"], "v", width=2).collect()}
    assert got == {0: [0], 1: [0, 1], 2: [2], 3: [3], 4: [3, 4], 5: [5]}


@pytest.mark.parametrize("window,grows", [([1, 2, 3], False), ([10, 20, 30, 40], True), ([40, 30, 20, 10], False), ([10, 10, 10, 11], False), ([10, 90, 20, 95], True), ([10, 20, 30, 40, 5, 6], False)])
def test_growth(spark, window, grows):
    df = spark.createDataFrame([(window,)], "w array<bigint>")
    assert df.select(S.growth(F.col("w"), F.lit(12)).alias("g")).first()["g"] is grows


def test_ceiling_needs_a_sustained_breach(spark):
    rows = [(0, 5), (10_000, 20), (20_000, 20), (41_000, 20), (43_000, 20), (44_000, 5), (50_000, 20)]
    df = spark.createDataFrame([(1, n, at, "g0", v, 10, True) for n, (at, v) in enumerate(rows)], "k bigint, step_no bigint, at_ms bigint, slot string, observed bigint, ceiling bigint, enforceable boolean")
    assert [r["action"] for r in S.ceiling_actions(df, ["k"]).orderBy("step_no").collect()] == ["disarm", "arm", "wait", "kill", "arm", "disarm", "arm"]


def test_flap_budget_ignores_disabled_firings(spark):
    df = spark.createDataFrame([(1, n, at) for n, at in enumerate((0, 60_000, 120_000, 180_000, 1_800_001, 1_800_002))], "k bigint, step_no bigint, at_ms bigint")
    assert [r["outcome"] for r in S.restart_budget(df, ["k"]).orderBy("step_no").collect()] == ["restarted"] * 3 + ["disabled", "restarted", "disabled"]


def test_counter_stall_cases(spark):
    rows = [(0, 100, 1), (300_000, 100, 1), (310_000, 3, 1), (600_000, 3, 0), (800_000, None, 1), (950_000, 3, 1)]
    df = spark.createDataFrame([(1, t, i, p, n) for i, (t, p, n) in enumerate(rows)], "service bigint, at_ms bigint, poll_id bigint, progress bigint, inflight bigint")
    assert [r["stalled"] for r in S.counter_stalls(df, ["service"]).orderBy("at_ms").collect()] == [False, True, False, False, False, True]


# --- hygiene ---------------------------------------------------------------


def test_latest_keeps_the_first_of_equal_stamps(spark):
    df = spark.createDataFrame([("a", 5, 1, "x"), ("a", 5, 2, "y"), ("a", 4, 3, "z"), ("b", 0, 4, "w")], "cell string, t bigint, pos bigint, v string").repartition(4)
    assert {r["cell"]: r["v"] for r in H.latest_per_cell(df, "cell", F.col("t"), F.col("pos")).collect()} == {"a": "x", "b": "w"}


def test_unreadable_stamps_are_the_epoch(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("soon",), (None,)], "s string")
    assert [r["m"] for r in df.select(R.instant_ms(F.col("s")).alias("m")).collect()] == [1767225600000, 0, 0]


def test_plan_merge_keeps_the_first_position(spark):
    df = spark.createDataFrame([("m", None, "q2", 1), ("m", None, "q1", 0), ("m", None, "q1", 5), ("n", 4, "q2", 2)], "model string, moe bigint, question string, pos bigint")
    got = {r["model"]: (r["pos"], r["purpose"]) for r in H.merge_plans(df, ["model", "moe"]).collect()}
    assert got == {"m": (0, ["q1", "q2"]), "n": (2, ["q2"])}


# --- models ----------------------------------------------------------------


def test_design_columns(spark):
    lit = F.lit
    c = R.design_columns(lit(512), lit(32768), lit(32768), lit(False), lit(1.0), lit(151936), lit(2048), lit(False), lit(1))
    row = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first().asDict()
    assert row == {"flat": 1.0, "head_flat": 1.0, "hidden": 1.0, "doubling": 0.0, "mask": 16.0, "quant": 0.0, "logits": 74.1875, "offload_head": 0.0}


def test_fit_recovers_coefficients_and_drops_negative_columns(spark):
    rows = [("a", 1.0, float(m), float(m % 3), 100.0 + 5 * m - 0.5 * (m % 3)) for m in range(1, 30)]
    df = spark.createDataFrame(rows, "g string, flat double, mask double, quant double, target double")
    sums = M.normal_sums(df, ["g"], ["flat", "mask", "quant"])
    got = {r["column"]: r["coef"] for r in M.fit_groups(sums, ["g"], ["flat", "mask", "quant"]).collect()}
    assert set(got) == {"flat", "mask"} and got["mask"] == pytest.approx(5, abs=0.05)
    few = M.normal_sums(df.limit(3), ["g"], ["flat", "mask", "quant"])
    assert M.fit_groups(few, ["g"], ["flat", "mask", "quant"]).count() == 0


def test_committed_values_are_compared(spark):
    c = spark.createDataFrame([("slot_bytes", "a", 5), ("slot_bytes", "b", 6), ("slot_bytes", "gone", 1)], "name string, key string, value bigint")
    d = spark.createDataFrame([("slot_bytes", "a", 5, "ok"), ("slot_bytes", "b", 7, "ok"), ("slot_bytes", "n", -2, "ok")], "name string, key string, value bigint, status string")
    assert {r["key"]: r["state"] for r in D.check_committed(c, d).collect()} == {"a": "same", "b": "changed", "gone": "missing", "n": "negative"}


# --- text ------------------------------------------------------------------

LOG = """llama_model_loader: - kv   3: demo.block_count u32 = 48
load_tensors: CUDA0 model buffer size = 10.00 MiB
llama_kv_cache: size = 4.00 MiB ( 256 cells, 2 layers, 1/1 seqs), K (f16): 2.00 MiB, V (f16): 2.00 MiB
sched_reserve: graph nodes = 10
sched_reserve: graph splits = 1
llama_context: CUDA0 compute buffer size = 7.00 MiB
sched_reserve: graph nodes = 99
"""


def test_two_contexts(spark):
    got = E.parse_logs(spark.createDataFrame([(1, LOG)], "id bigint, text string")).first()
    first, second = got["contexts"]
    assert first["buffers"]["CUDA0"] == {"model": 10.0} and first["kv_pools"][0]["cells"] == 256 and first["graph_splits"] == 1
    assert second["buffers"]["CUDA0"] == {"compute": 7.0} and second["graph_nodes"] == 99 and second["kv_pools"] == []
    assert got["gguf_kv"] == {"demo.block_count": 48} and got["arch"] == "?" and got["devices"] == [] and got["vision"] is None


def test_progress_counters(spark):
    bodies = [
        "llamacpp:prompt_tokens_total 11050\nllamacpp:tokens_predicted_total 465\n", "llamacpp:tokens_predicted_total 1.2e3\n", "other 1\n", "# HELP llamacpp:prompt_tokens_total x\n",
        "llamacpp:tokens_predicted_total 50\nllamacpp:n_tokens_predicted_total 50\n", "llamacpp:prompt_tokens_total_bytes 999\n",
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id bigint, body string")
    assert [r["progress"] for r in E.progress_counters(df, ["id"]).orderBy("id").collect()] == [11515, 1200, None, None, 50, None]


def test_response_frames(spark):
    usage = json.dumps({"choices": [], "usage": {"prompt_tokens": 42, "completion_tokens": 7}, "timings": {"prompt_ms": 123.4, "predicted_ms": 456.6, "prompt_n": 8}})
    frames = [
        (1, 0, 10, 'data: {"choices":[{"delta":{"role":"assistant"}}]}\n\ndata: {"choices":[{"delta":{"co'), (1, 1, 25, 'ntent":"hi"}}]}\n\n'), (1, 2, 40, f"data: {usage}\n\ndata: [DO"), (1, 3, 41, "NE]\n\n"), (1, 4, 42, 'data: {"usage":'),
        (2, 0, 5, '{"usage":{"prompt_tokens":10,'), (2, 1, 6, '"completion_tokens":3}}'), (3, 0, 7, "not json"),
    ]
    f = spark.createDataFrame(frames, "request bigint, frame_seq bigint, at_ms bigint, body string").repartition(3)
    q = spark.createDataFrame([(1, 0, 50, True), (2, 0, 9, False), (3, 0, 9, False)], "request bigint, start_ms bigint, end_ms bigint, streaming boolean")
    for width in (1, 256):
        got = {r["request"]: r for r in E.response_metrics(q, f, width).collect()}
        one = got[1]
        assert (one["prompt_tokens"], one["completion_tokens"], one["prompt_ms"], one["predicted_ms"], one["prompt_eval_tokens"], one["ttft_ms"], one["duration_ms"]) == (42, 7, 123, 457, 8, 25, 50)
        assert (got[2]["prompt_tokens"], got[2]["completion_tokens"], got[2]["ttft_ms"]) == (10, 3, None)
        assert got[3]["prompt_tokens"] is None


# --- documents -------------------------------------------------------------


def write(tmp_path, text):
    path = tmp_path / "rows.ndjson"
    path.write_text(text)
    return str(path)


SCHEMA = "cell string, status string, factors struct<ctx: bigint>"


@pytest.mark.parametrize("line,why", [('{"cell":"a","status":"ok","extra":1}', "unknown field extra"), ('{"cell":"a","factors":{"ctx":1,"odd":2}}', "factors.odd"), ('{"cell":" ","status":"ok"}', "blank cell"), ('{"cell":', "not a record")])
def test_strict_read_names_the_bad_line(spark, tmp_path, line, why):
    schema = stores.T.StructType.fromDDL(SCHEMA)
    path = write(tmp_path, '{"cell":"a","status":"ok","factors":{"ctx":1}}\n\n' + line + "\n")
    with pytest.raises(stores.BadRecord, match=why):
        stores.read_ndjson_strict(spark, path, schema)


def test_strict_read_skips_blank_lines(spark, tmp_path):
    schema = stores.T.StructType.fromDDL(SCHEMA)
    path = write(tmp_path, '\n{"cell":"a","status":"ok","factors":{"ctx":1}}\n   \n')
    assert stores.read_ndjson_strict(spark, path, schema).count() == 1


def test_cell_id_ignores_defaults_and_labels(spark):
    df = spark.createDataFrame([(("x", 4, None),), (("y", 4, None),), (("x", 5, None),), (("x", 4, 0),)], "factors struct<label: string, ctx: bigint, moe: bigint>")
    ids = [r["i"] for r in df.select(R.cell_id("factors", {"label": "", "ctx": 4, "moe": None}).alias("i")).collect()]
    assert ids[0] == ids[1] and len({ids[0], ids[2], ids[3]}) == 3 and len(ids[0]) == 12


def lines(spark, tmp_path, n=400):
    """A folder with `n` line items, some of them twice and some with nulls."""
    rows = spark.range(n).selectExpr(
        "id div 3 as l_orderkey", "cast(id % 7 + 1 as int) as l_linenumber", "id * 7 % 90 as l_suppkey", "if(id % 31 = 0, null, id * 11 % 60) as l_partkey",
        "100 + id * 3.25D as l_extendedprice", "1D + id % 50 as l_quantity", "id % 11 / 100D as l_discount", "id % 9 / 100D as l_tax",
        "element_at(array('N', 'R', 'A'), cast(id % 3 + 1 as int)) as l_returnflag", "if(id % 2 = 0, 'F', 'O') as l_linestatus",
        "cast(timestamp'1995-01-01' + make_dt_interval(cast(id % 40 as int)) as timestamp_ntz) as l_shipdate",
    )
    rows.unionByName(rows.where("l_orderkey % 5 = 0")).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_records_are_written_without_their_flat_columns(spark, tmp_path):
    before = spark.conf.get(METHOD_CONF)
    folder = lines(spark, tmp_path)
    assert records.measurements(spark, folder).count() > 400
    assert [label for _, d, label in records._written if d == folder] == ["measurements"]
    assert spark.conf.get(METHOD_CONF) == before


def test_records_read_once_are_the_written_ones(spark, tmp_path):
    folder = lines(spark, tmp_path)
    texts = lambda df: sorted(map(repr, df.collect()))
    once = texts(records.passing(spark, folder))
    assert not any(d == folder for _, d, _ in records._written)
    assert once == texts(records.measurements(spark, folder)) and len(once) > 400
    assert records.passing(spark, folder) is records.measurements(spark, folder)


def test_records_are_only_spread_where_files_leave_cores_idle(spark, tmp_path):
    folder = lines(spark, tmp_path)
    spark.read.parquet(f"{folder}/lineitem.parquet").coalesce(1).write.parquet(str(tmp_path / "one/lineitem.parquet"))
    plan = lambda d: records.passing(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE" in plan(str(tmp_path / "one")) and "REBALANCE" not in plan(folder)


def test_records_are_written_once_as_compressed_text_of_bounded_files(spark, tmp_path, monkeypatch):
    from meterloom.catalog import extract as X

    folder, made = str(tmp_path / "named"), []
    spark.read.parquet(f"{lines(spark, tmp_path, 3_000)}/lineitem.parquet").where("l_partkey is not null").write.parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(X, "RECORDS_PER_FILE", 500)
    monkeypatch.setattr("meterloom.session.scratch_path", lambda s, label: made.append(str(tmp_path / f"{label}-{len(made)}")) or made[-1])
    got = {r["status"]: r["n"] for r in X.QUERIES["s4_s7_ndjson"](spark, folder).collect()}
    total = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert sum(got.values()) == total and len(made) == 1
    files = [p for p in (tmp_path / "ndjson-0").iterdir() if p.name.startswith("part-")]
    counts = [spark.read.text(str(p)).count() for p in files]
    text = spark.read.text(made[0]).agg(F.sum(F.length("value") + 1)).first()[0]
    assert sum(counts) == total and max(counts) <= 500 and sum(p.stat().st_size for p in files) * 5 < text


def test_a_bad_line_of_a_compressed_file_is_named(spark, tmp_path):
    schema = stores.T.StructType.fromDDL(SCHEMA)
    df = spark.range(25).selectExpr("if(id = 23, ' ', concat('c', id)) as cell", "'ok' as status", "named_struct('ctx', id) as factors").coalesce(1)
    with pytest.raises(ValueError):
        stores.write_ndjson(df, str(tmp_path / "none"), "gzip")
    stores.write_ndjson(df, str(tmp_path / "rows"), "gzip", 10)
    stores.write_ndjson(df, str(tmp_path / "plain"))
    parts = lambda name: sorted(p.name for p in (tmp_path / name).iterdir() if p.name.startswith("part-"))
    assert len(parts("rows")) == 3 and all(p.endswith(".txt.gz") for p in parts("rows")) and len(parts("plain")) == 1
    with pytest.raises(stores.BadRecord, match="c002.txt.gz:4: blank cell id"):
        stores.read_ndjson_strict(spark, str(tmp_path / "rows"), schema)
    with pytest.raises(stores.BadRecord, match="c000.txt:24: blank cell id"):
        stores.read_ndjson_strict(spark, str(tmp_path / "plain"), schema)


def test_records_chosen_by_narrow_rows_are_the_whole_ones(spark, tmp_path):
    from meterloom.catalog import derive

    folder = lines(spark, tmp_path)
    m = records.measurements(spark, folder)
    texts = lambda df: sorted(map(repr, df.select(*m.columns).collect()))
    assert texts(records.at_positions(m.select("pos"))) == texts(m)
    got = texts(derive._clean(spark, folder))
    assert got == texts(H.latest_measurement(H.usable(m))) and len(got) > 10


def test_a_plan_is_not_dealt_out_by_its_few_models(spark):
    plan = spark.range(1000).selectExpr(
        "concat('m', id % 4) as model", "'ik' as runtime", "false as no_mmap", "false as rtr", "'0' as gpus", "'layer' as split", "99L as ngl", "'' as spec_type", "'' as draft",
        "'' as mmproj", "4096L as ctx", "512L as ubatch", "1L as parallel", "'f16' as kv_type", "'on' as flash_attn", "true as served", "false as bench", "999 - id as pos",
    )
    sizes = spark.range(100_000).selectExpr("concat('m', id % 3) as model", "10 - id % 3 as bytes").groupBy("model").agg(F.max("bytes").alias("bytes"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        ordered = H.plan_order(plan, sizes)
        assert "SortMergeJoin" not in ordered._jdf.queryExecution().sparkPlan().toString()
        got = [(r["model"], r["pos"]) for r in ordered.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(f"m{k}", p) for k in (2, 1, 0, 3) for p in range(1000) if (999 - p) % 4 == k]
