"""Registered extraction and source queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators import extract as E
from meterloom.operators import telemetry as T
from meterloom.session import compiled, settle
from meterloom.sources import bindings as B
from meterloom.sources import measurements as M
from meterloom.sources import stores as S


#: Logs printed by one task, and logs of one archive of the corpus (about 2 KB each).
LOGS_PER_TASK, LOGS_PER_ARCHIVE = 10_000, 1_000
#: Records of one compressed NDJSON file (about half a KB of text each).
RECORDS_PER_FILE = 100_000


def load_logs(s, d) -> DataFrame:
    """The corpus of load logs, written once per session."""
    return M._once(s, d, "load-logs", lambda: _print_logs(s, d))


def _print_logs(s, d) -> DataFrame:
    """A load log per part: the lines a runtime would print for figures taken from the row."""
    p = F.col("p_partkey")
    two, vis = p % 3 == 0, p % 5 == 0
    i = lambda c: c.cast("long")
    fmt = F.format_string
    draft = F.concat(
        fmt("llama_kv_cache: size = %d.50 MiB ( %d cells, 2 layers, 1/1 seqs), K (f16): %d.25 MiB, V (f16): %d.25 MiB\n", i(p % 40), i(p % 9) * 256, i(p % 20), i(p % 20)),
        fmt("sched_reserve: CUDA0 compute buffer size = %d.25 MiB\n", i(p % 70)),
        F.lit("sched_reserve: graph nodes = 77\nsched_reserve: graph splits = 2\n"),
    )
    text = F.concat(
        fmt("print_info: arch = arch%d\n", i(p % 8)),
        fmt("print_info: n_layer = %d\nprint_info: n_embd = %d\nprint_info: n_head = %d\n", i(F.col("p_size")), i(p % 16) * 256, i(p % 7)),
        F.when(two, fmt("print_info: n_layer = %d\n", i(F.col("p_size")) + 1)).otherwise(F.lit("")),
        fmt("llama_model_loader: - kv  12: arch%d.context_length u32 = %d\n", i(p % 8), i(p % 1000)),
        fmt("llama_model_loader: - kv  13: arch%d.context_length u32 = 5\nllama_model_loader: - kv 14: general.name str = x\n", i(p % 8)),
        fmt("load_tensors: CPU_Mapped model buffer size = %d.00 MiB\nload_tensors: CUDA0 model buffer size = %d.50 MiB\n", i(p % 90), i(p % 900)),
        F.when(two, draft).otherwise(F.lit("")),
        fmt("llama_kv_cache: size = %d.00 MiB ( %d cells, 16 layers, 4/4 seqs), K (q8_0): %d.00 MiB, V (q8_0): %d.00 MiB\n", i(p % 64), i(p % 8) * 1024, i(p % 32), i(p % 32)),
        fmt("llama_memory_recurrent: size = 9.00 MiB ( 4 cells, 24 layers, 4 seqs %d rs_seq), R (f32): %d.12 MiB, S (f32): 1.00 MiB\n", i(p % 4), i(p % 11)),
        fmt("sched_reserve: CUDA0 compute buffer size = %d.75 MiB\nsched_reserve: CUDA_Host compute buffer size = %d.50 MiB\n", i(p % 300), i(p % 50)),
        F.when(p % 4 == 0, fmt("sched_reserve: CUDA_Host compute buffer size = %d.25 MiB\n", i(p % 60))).otherwise(F.lit("")),
        fmt("sched_reserve: graph nodes = %d\nsched_reserve: graph splits = %d\n", i(p % 2000), i(p % 5)),
        F.when(vis, fmt("clip_model_loader: tensor[0]: name=a tensor_size=%d\nclip_model_loader: tensor[1]: name=b tensor_size=100\nimage size = 768 x 768\nn_merge: 2\nadding %d.50 MiB to fit_params_target for device CUDA0\n", i(p), i(p % 500))).otherwise(F.lit("")),
        F.lit("memory breakdown [MiB] | total free\n  - CUDA0 (old) | 1 = 1 + ( 1 = 1 + 1 + 1) + 1\n"),
        fmt("memory breakdown [MiB] | total free self\n  - CUDA0 (card) | 24576 = %d + ( %d = %d + 2 + 3) + %d\n  - CUDA1 (card) | 24576 = 7 + ( 8 = 9 + 10 + 11) + 12\n  - Host | %d = 5 + 6 + 7\n", i(p % 24000), i(p % 700), i(p % 600), i(p % 50), i(p % 3000)),
    )
    # A part is a few bytes and its log is 2 KB of text to parse: the tasks follow the number of logs, not the size of the table.
    parts = B.table(s, d, "part").select("p_partkey", "p_size")
    tasks = parts.count() // LOGS_PER_TASK + 1
    return (parts.repartition(tasks) if tasks > 1 else parts).select(p.alias("log_id"), text.alias("text"))


def _parsed(s, d):
    return E.parse_logs(load_logs(s, d))


def _buffers(s, d):
    return _parsed(s, d).select("log_id", "arena_mib", "arena_mib_all", "cpu_model_mib", "cpu_model_mapped", "arch")


def _meta(s, d):
    m = F.col("meta")
    return _parsed(s, d).select("log_id", E.hyperparameter(m, "n_layer").alias("n_layer"), F.try_element_at(m, F.lit("n_layer"))["all"].alias("n_layer_all"), *[E.hyperparameter(m, k).alias(k) for k in ("n_embd", "n_head", "n_vocab")])


def _contexts(s, d):
    rows = _parsed(s, d).select("log_id", F.posexplode("contexts").alias("i", "c"))
    dev = lambda r: F.try_element_at(F.try_element_at(F.col("c.buffers"), F.lit("CUDA0")), F.lit(r))
    return rows.select(
        "log_id", "i", dev("model").alias("model"), dev("compute").alias("compute"), F.size("c.kv_pools").alias("pools"), F.col("c.kv_pools")[0]["total_mib"].alias("kv_mib"),
        F.col("c.kv_pools")[0]["cells"].alias("cells"), F.col("c.rs_pool.rs_seq").alias("rs_seq"), F.col("c.rs_pool.r_mib").alias("r_mib"), F.col("c.graph_nodes").alias("nodes"),
    )


def _reparse(s, d):
    parsed = settle(_parsed(s, d).select(F.col("log_id").alias("log"), F.col("arena_mib").alias("arena")), "parsed")
    records = B.table(s, d, "part").select(
        (F.col("p_partkey") + 100).cast("string").alias("log"), F.when(F.col("p_partkey") % 6 == 0, "timeout").otherwise("ok").alias("status"), ((F.col("p_partkey") + 100) % 50 + F.lit(0.5)).alias("arena_mib")
    )
    out = E.reparse(records, parsed.withColumn("log", F.col("log").cast("string")), "arena_mib", "arena")
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("arena_mib"), 4).alias("arena_sum"))


def frames(s, d):
    c, t = F.col("conv_id"), F.col("turn")

    def line(turn):
        return F.format_string('data: {"choices":[{"delta":{"content":"%s"}}],"usage":{"prompt_tokens":%d,"completion_tokens":%d},"timings":{"prompt_ms":%d.5,"prompt_n":%d}}',
                               F.when(turn % 2 == 0, F.lit("")).otherwise(F.lit("w")), turn * 3 + c % 7, turn, turn * 10 + c, turn + 1)

    streamed = F.concat(F.when(t > 0, F.concat(F.expr("substring(__prev, 21)"), F.lit("\n\n"))).otherwise(F.lit("")), F.substring(F.col("__line"), 1, 20))
    plain = F.when(t == 0, F.format_string('{"usage":{"prompt_tokens":%d,', c)).otherwise(F.when(t == 1, F.lit('"completion_tokens":4}}')).otherwise(F.lit(" ")))
    rows = B.table(s, d, "conversations").withColumn("__line", line(t)).withColumn("__prev", line(t - 1))
    return rows.select(c.alias("request"), t.alias("frame_seq"), (c * 1000 + t * 40).alias("at_ms"), F.when(c % 4 == 3, plain).otherwise(streamed).alias("body"))


def _responses(s, d):
    conv = B.table(s, d, "conversations").groupBy(F.col("conv_id").alias("request")).agg((F.max("turn") * 50).alias("__d"))
    requests = conv.select("request", (F.col("request") * 1000).alias("start_ms"), (F.col("request") * 1000 + F.col("__d")).alias("end_ms"), (F.col("request") % 4 != 3).alias("streaming"))
    return E.response_metrics(requests, frames(s, d))


def _counters(s, d):
    k, v = F.expr(B.SPARK_K), F.floor("value").cast("long")
    body = F.concat(
        F.lit("# HELP llamacpp:prompt_tokens_total x\n"), F.when(k % 3 == 0, F.format_string("llamacpp:n_prompt_tokens_processed_total 999\nllamacpp:prompt_tokens_total %d\n", k)).otherwise(F.lit("")),
        F.when(k % 4 == 0, F.format_string("  llamacpp:tokens_predicted_total %d.0e1\n", v)).otherwise(F.lit("llamacpp:tokens_predicted_total_bytes 5\n")), F.when(k % 5 == 0, F.lit("llamacpp:n_tokens_predicted_total 7")).otherwise(F.lit("")),
    )
    pages = B.table(s, d, "events").select("event_id", body.alias("body"))
    return E.progress_counters(pages, ["event_id"])


def _exposition(s, d):
    m = B.request_metrics(s, d)
    now = m.agg(F.max("timestamp_ms")).first()[0]
    counters = T.lifetime_counters(m, B.services(s, d), now)
    label = lambda n, c: F.struct(F.lit(n).alias("name"), c.alias("value"))
    samples = counters.select(
        F.when(F.col("counter") == "requests", "serving_requests_total").otherwise("serving_tokens_total").alias("family"),
        F.when(F.col("counter") == "requests", "Total number of requests.").otherwise("Total tokens processed.").alias("help"), F.lit("counter").alias("kind"),
        F.when(F.col("counter") == "requests", F.array(label("service", F.col("service")))).otherwise(F.array(label("service", F.col("service")), label("type", F.col("counter")))).alias("labels"), F.col("value").cast("double").alias("value"),
    )
    return E.exposition_lines(samples)


def _sequenced(s, d):
    logs = B.service_logs(s, d).drop("seq")
    first = logs.filter("timestamp_ms < 1200000")
    known = S.sequence_logs(first, None, order=["timestamp_ms", "stream", "line"])
    later = S.sequence_logs(logs.filter("timestamp_ms >= 1200000"), known, order=["timestamp_ms", "stream", "line"])
    return known.unionByName(later).select("service_id", "run_id", "timestamp_ms", "seq", F.md5("line").alias("line_md5"))


def _append_metrics(s, d):
    from meterloom.session import scratch_path

    path = scratch_path(s, "metrics")
    m = B.request_metrics(s, d)
    S.append_metrics(m.filter("service_id < 10"), path)
    S.append_metrics(m.filter("service_id >= 10"), path)
    return S.read_metrics(s, path).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration"))


def _ndjson(s, d):
    from meterloom.session import scratch_path

    path = scratch_path(s, "ndjson")
    m = M.passing(s, d).select("cell", "status", "factors", "provenance")
    # The text is some thirty times the line items.
    with compiled(s):
        S.write_ndjson(m, path, "gzip", RECORDS_PER_FILE)
    return S.read_ndjson_strict(s, path, m.schema).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("factors.ctx").alias("ctx"))


def _tolerant(s, d):
    from meterloom.session import scratch_path

    path = scratch_path(s, "torn")
    m = M.measurements(s, d).select("cell", "status")
    torn = m.select(F.when(F.substring(F.md5("cell"), 1, 1) < "8", F.to_json(F.struct("cell", "status"))).otherwise(F.lit('{"cell": "x", "sta')).alias("value"))
    torn.write.text(path)
    return S.read_ndjson_tolerant(s, path, m.schema).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("status").alias("status"))


def _corpus(s, d):
    from meterloom.session import scratch_path

    path = scratch_path(s, "corpus")
    # An archive is read as one text, so a task's logs go to archives of bounded size.
    load_logs(s, d).select("text").write.option("compression", "gzip").option("maxRecordsPerFile", LOGS_PER_ARCHIVE).text(path)
    return S.read_log_corpus(s, path).agg(F.sum(F.size(E.every(F.col("text"), E.ARENA))).alias("arena_lines"))


def _drift(s, d):
    from meterloom.operators.hygiene import headroom_line
    from meterloom.session import scratch_path

    path = scratch_path(s, "drift")
    rows = B.table(s, d, "part").select(
        F.col("p_name").alias("service"), F.col("p_type").alias("architecture"), (4096 * (F.col("p_size") % 4 + 1)).cast("string").alias("context"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit("n/a")).otherwise((F.col("p_partkey") % 700).cast("string")).alias("predicted_total_mib"), (F.col("p_partkey") % 900).cast("string").alias("actual_post_chat_total_mib"),
    )
    rows.write.option("header", True).csv(path)
    return headroom_line(S.read_drift_csv(s, path)).withColumn("worst_pct", F.round("worst_pct", 6))


def _rates(s, d):
    from meterloom.session import scratch_path

    path = scratch_path(s, "rates")
    table = B.table(s, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.max("p_size").cast("long").alias("value"))
    S.write_rates(table, 9, path)
    return S.read_rates(s, path)


QUERIES = {
    "x10_buffers": _buffers,
    "x11_hyperparameters": _meta,
    "x12_metadata": lambda s, d: _parsed(s, d).select("log_id", F.map_values("gguf_kv").alias("values"), F.map_keys("gguf_kv").alias("keys")),
    "x13_breakdown": lambda s, d: _parsed(s, d).select("log_id", F.explode("devices").alias("v"), F.col("host_breakdown.self_mib").alias("host_mib")).select("log_id", "host_mib", "v.device", "v.free_mib", "v.self_mib", "v.model_mib", "v.unaccounted_mib"),
    "x14_contexts": _contexts,
    "x15_vision": lambda s, d: _parsed(s, d).filter("vision is not null").select("log_id", F.map_values("vision.reserved_mib")[0].alias("reserved"), "vision.tensor_bytes", "vision.image_size", "vision.n_merge"),
    "x16_reparse": _reparse,
    "x17_response_metrics": _responses,
    "s1_append_metrics": _append_metrics,
    "s3_sequenced_logs": _sequenced,
    "s4_s7_ndjson": _ndjson,
    "s5_tolerant_ndjson": _tolerant,
    "s8_log_corpus": _corpus,
    "s9_a25_drift_csv": _drift,
    "s11_exposition": _exposition,
    "s12_progress_counters": _counters,
    "s13_rate_document": _rates,
}

P = "p_partkey"
ORACLE = {
    "x10_buffers": f"select {P} as log_id, case when {P} % 4 = 0 then {P} % 60 + 0.25::double else {P} % 50 + 0.5::double end as arena_mib, case when {P} % 4 = 0 then [{P} % 50 + 0.5::double, {P} % 60 + 0.25::double] end as arena_mib_all, ({P} % 90)::double as cpu_model_mib, true as cpu_model_mapped, 'arch' || cast({P} % 8 as varchar) as arch from part",
    "x11_hyperparameters": f"select {P} as log_id, p_size as n_layer, case when {P} % 3 = 0 then [p_size, p_size + 1] end as n_layer_all, {P} % 16 * 256 as n_embd, {P} % 7 as n_head, 0 as n_vocab from part",
    "x12_metadata": f"select {P} as log_id, ['arch' || cast({P} % 8 as varchar) || '.context_length'] as keys, [{P} % 1000] as values from part",
    "x13_breakdown": f"select {P} as log_id, {P} % 3000 as host_mib, 'CUDA0 (card)' as device, {P} % 24000 as free_mib, {P} % 700 as self_mib, {P} % 600 as model_mib, {P} % 50 as unaccounted_mib from part union all select {P}, {P} % 3000, 'CUDA1 (card)', 7, 8, 9, 12 from part",
    "x14_contexts": f"""select {P} as log_id, case when {P} % 3 = 0 then 1 else 0 end as i, case when {P} % 3 <> 0 then {P} % 900 + 0.5::double end as model, {P} % 300 + 0.75::double as compute, 1 as pools, ({P} % 64)::double as kv_mib, {P} % 8 * 1024 as cells, {P} % 4 as rs_seq, {P} % 11 + 0.12::double as r_mib, {P} % 2000 as nodes from part
      union all select {P}, 0, {P} % 900 + 0.5::double, {P} % 70 + 0.25::double, 1, {P} % 40 + 0.5::double, {P} % 9 * 256, null, null, 77 from part where {P} % 3 = 0""",
    "x15_vision": f"select {P} as log_id, {P} % 500 + 0.5::double as reserved, {P} + 100 as tensor_bytes, 768 as image_size, 2 as n_merge from part where {P} % 5 = 0",
    "x16_reparse": f"""with n as (select count(*) as n from part), r as (select {P} + 100 as log, {P} % 6 = 0 as bad, ({P} + 100) % 50 + 0.5::double as old from part),
      o as (select case when bad or log >= n then 'skipped' when log % 4 <> 0 then 'unchanged' when log % 60 + 0.25 = old then 'unchanged' else 'rewritten' end as outcome, log, old from r, n)
      select outcome, count(*) as n, round(sum(case when outcome = 'rewritten' then log % 60 + 0.25::double else old end), 4) as arena_sum from o group by 1""",
    "x17_response_metrics": """with c as (select conv_id as r, max(turn) as t from conversations group by 1)
      select r as request, case when r % 4 = 3 then (case when t >= 1 then r end) when t >= 1 then (t - 1) * 3 + r % 7 end as prompt_tokens, case when r % 4 = 3 then (case when t >= 1 then 4 end) when t >= 1 then t - 1 end as completion_tokens,
        case when r % 4 <> 3 and t >= 1 then t end as prompt_eval_tokens, t * 50 as duration_ms, case when r % 4 <> 3 and t >= 2 then 80 end as ttft_ms, case when r % 4 <> 3 and t >= 1 then (t - 1) * 10 + r + 1 end as prompt_ms,
        null::bigint as predicted_ms, null::bigint as draft_tokens, null::bigint as draft_tokens_accepted from c""",
    "s1_append_metrics": B.with_ctes(["rm"], "select cast(cast(make_timestamp(timestamp_ms * 1000) as date) as varchar) as dt, count(*) as n, sum(duration_ms) as duration from rm group by 1"),
    "s3_sequenced_logs": B.with_ctes(["logs"], "select service_id, run_id, timestamp_ms, row_number() over (partition by service_id, run_id order by timestamp_ms, stream, line) - 1 as seq, md5(line) as line_md5 from logs"),
    "s4_s7_ndjson": f"with m as ({M.flat_sql()}) select status, count(*) as n, sum(ctx) as ctx from m group by 1",
    "s5_tolerant_ndjson": f"with m as ({M.flat_sql()}) select cell, count(*) as n, max(status) as status from m where substr(md5(cell), 1, 1) < '8' group by 1",
    "s8_log_corpus": f"select sum(case when {P} % 4 = 0 then 2 else 1 end) as arena_lines from part",
    "s9_a25_drift_csv": f"""with e as (select p_type as arch, 4096 * (p_size % 4 + 1) as context, {P} % 900 as actual, {P} % 900 - case when {P} % 9 = 0 then 0 else {P} % 700 end as delta from part where {P} % 900 <> 0),
      p as (select arch, context, max(delta) as worst, max(100.0::double * delta / actual) as pct from e group by 1, 2),
      g as (select arch, count(*) as contexts, max(worst) as worst_mib, round(max(pct), 6) as worst_pct, min(context) as x0, max(context) as x1, arg_min(worst, context) as y0, arg_max(worst, context) as y1 from p group by 1),
      s as (select *, (y1 - y0)::double / nullif((x1 - x0) / 1024.0::double, 0) as sl from g)
      select arch, contexts, worst_mib, worst_pct, trunc(y0 - sl * (x0 / 1024.0::double) + 64)::bigint as base_mib, trunc(sl + 0.5)::bigint as slope_mib_per_1k from s""",
    "s11_exposition": B.with_ctes(
        ["rm", "services"],
        """, n as (select max(timestamp_ms) as n from rm), c as (select service_id, count(*) r, sum(prompt_tokens) p, sum(completion_tokens) c from rm, n where timestamp_ms between n - 604800000 and n group by 1),
        f as (select name, coalesce(r, 0) as r, coalesce(p, 0) as p, coalesce(c, 0) as c from services left join c using (service_id) where deleted_at is null)
        select 'serving_requests_total' as family, unnest([0, 1]) as rank, unnest(['# HELP serving_requests_total Total number of requests.', '# TYPE serving_requests_total counter']) as line
        union all select 'serving_tokens_total', unnest([0, 1]), unnest(['# HELP serving_tokens_total Total tokens processed.', '# TYPE serving_tokens_total counter'])
        union all select 'serving_requests_total', 2, 'serving_requests_total{service="' || name || '"} ' || cast(r as varchar) from f
        union all select 'serving_tokens_total', 2, 'serving_tokens_total{service="' || name || '",type="prompt"} ' || cast(p as varchar) from f
        union all select 'serving_tokens_total', 2, 'serving_tokens_total{service="' || name || '",type="completion"} ' || cast(c as varchar) from f""",
    ),
    "s12_progress_counters": f"""with e as (select event_id, {B.ANSI_K} as k, cast(floor(value) as bigint) as v from events), p as (select event_id, case when k % 3 = 0 then k end as a, case when k % 4 = 0 then v * 10 when k % 5 = 0 then 7 end as b from e)
      select event_id, case when a is not null or b is not null then coalesce(a, 0) + coalesce(b, 0) end as progress from p""",
    "s13_rate_document": """with t as (select p_brand as key, max(p_size) as value from part group by 1) select key, value, false as is_default from t union all select null, 9, true""",
}
