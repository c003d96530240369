"""Load logs, counter pages and response bodies turned into rows.

Everything is regular expressions and JSON on the JVM side, over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions import scan

# Line formats of the runtimes' logs (fixed values).
ARENA = r"(?:sched_reserve|llama_init_from_model): *(?:CUDA_Host|CPU) compute buffer size *= *([0-9.]+)"
OUT_BUF = r"(?:CUDA_Host|CPU) +output buffer size *= *([0-9.]+)"
CPU_KV = r"CPU KV buffer size *= *([0-9.]+)"
CPU_MODEL = r"CPU(?:_Mapped)? model buffer size *= *([0-9.]+)"
META_KEYS = [
    "n_layer", "n_embd", "n_expert", "n_expert_used", "n_swa", "n_vocab", "n_head_kv", "n_head", "n_embd_head_k", "n_embd_head_v", "n_ctx_train",
    "n_ff", "ssm_d_conv", "ssm_d_inner", "ssm_d_state", "ssm_n_group", "ssm_dt_rank", "n_group_used",
]
META = "(" + "|".join(META_KEYS) + r") *= *(\d+)"
METADATA = r"(?md)llama_model_loader: - kv +\d+: +([A-Za-z0-9_.]+) +[a-z0-9]+ += +(-?\d+)\s*$"
NEXTN = r"\.nextn_predict_layers[^=]*= *(\d+)"
PER_LAYER = r"per_layer_token_embd\.weight"
DRAFT_TOTAL = r"estimated memory usage of MTP context is *([0-9.]+)"
BREAKDOWN_HEADING = "memory breakdown [MiB]"
BREAKDOWN = r"- (.+?) +\| *(\d+) *= *(\d+) *\+ *\( *(\d+) *= *(\d+) *\+ *(\d+) *\+ *(\d+)\) *\+ *(\d+)"
BREAKDOWN_HOST = r"- Host +\| *(\d+) = *(\d+) \+ *(\d+) \+ *(\d+)"
ARCH = r"arch *= *([A-Za-z0-9_.-]+)"
CONTEXT_END = r"(?m)^.*(?:sched_reserve|llama_init_from_model): graph nodes.*$(?:\n^.*: graph splits.*$)?"
KV_POOL = r"llama_kv_cache: size = *([0-9.]+) MiB *\( *(\d+) cells, *(\d+) layers, *(\d+)/(\d+) seqs\), K \(([a-z0-9_]+)\): *([0-9.]+) MiB, V \(([a-z0-9_]+)\): *([0-9.]+) MiB"
RS_POOL = r"llama_memory_recurrent: size = *([0-9.]+) MiB *\( *(\d+) cells, *(\d+) layers, *(\d+) seqs *(\d+) rs_seq\), R \([a-z0-9_]+\): *([0-9.]+) MiB, S \([a-z0-9_]+\): *([0-9.]+) MiB"
DEV_BUFFER = r"(load_tensors|llm_load_tensors|llama_kv_cache(?:_init)?|llama_memory_recurrent|sched_reserve|llama_init_from_model|llama_context): +([A-Za-z0-9_()]+) +(?:(model|KV|RS|compute|output) +)?buffer size *= *([0-9.]+)"
GRAPH_SHAPE = r"graph (nodes|splits) += *(\d+)"
VISION_RESERVED = r"adding ([0-9.]+) MiB to fit_params_target for device ([A-Za-z0-9_()]+)"
CLIP_TENSOR = r"(?d)clip_model_loader: tensor\[\d+\]:.*tensor_size=(\d+)"
CLIP_IMAGE = r"image size = (\d+) x (\d+)"
CLIP_MERGE = r"n_merge: *(\d+)"


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def once(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, null when there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _num(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def _let(value: Column, use) -> Column:
    """Bind a costly expression so a lambda body reads it without evaluating it again."""
    return F.transform(F.array(value), use)[0]


def _pairs(text: Column, pattern: str, key: int, value: int, kind) -> Column:
    return F.arrays_zip(every(text, pattern, key).alias("k"), F.transform(every(text, pattern, value), kind).alias("v"))


def _entries(pairs: Column, last: bool) -> Column:
    """Map of key/value pairs; the first or the last value of a repeated key stays."""
    def build(p: Column) -> Column:
        names = F.array_distinct(F.transform(p, lambda e: e["k"]))
        pick = lambda k: F.element_at(F.filter(p, lambda e: e["k"] == k), -1 if last else 1)["v"]
        return F.when(F.size(p) > 0, F.map_from_arrays(names, F.transform(names, pick)))

    return _let(pairs, build)


def buffer_series(text: Column, pattern: str) -> tuple[Column, Column]:
    """The last figure (zero when absent) and, if several, all of them."""
    found = F.filter(F.transform(every(text, pattern), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0.0)), F.when(F.size(found) > 1, found)


def hyperparameters(text: Column) -> Column:
    """Map per key to its first value and, where values differ, all of them."""
    def build(p: Column) -> Column:
        names = F.array_distinct(F.transform(p, lambda e: e["k"]))

        def of(k: Column) -> Column:
            return _let(
                F.transform(F.filter(p, lambda e: e["k"] == k), lambda e: e["v"]),
                lambda seen: F.struct(seen[0].alias("value"), F.when(F.size(F.array_distinct(seen)) > 1, seen).alias("all")),
            )

        return F.map_from_arrays(names, F.transform(names, of))

    pairs = F.filter(_pairs(text, META, 1, 2, lambda x: x.try_cast("long")), lambda e: e["v"].isNotNull())
    return _let(pairs, build)


def hyperparameter(meta: Column, key: str) -> Column:
    """First value, zero where the log never prints the key."""
    return F.coalesce(F.try_element_at(meta, F.lit(key))["value"], F.lit(0).cast("long"))


def metadata(text: Column) -> Column:
    """Whole-number metadata; the first value of a repeated key stays."""
    return _entries(_pairs(text, METADATA, 1, 2, lambda x: x.try_cast("long")), last=False)


def breakdown(text: Column) -> tuple[Column, Column]:
    """Device rows of the last breakdown table, and its host row."""
    table = F.substring_index(text, BREAKDOWN_HEADING, -1)
    names = ["total_mib", "free_mib", "self_mib", "model_mib", "kv_mib", "compute_mib", "unaccounted_mib"]
    zipped = F.arrays_zip(every(table, BREAKDOWN, 1).alias("device"), *[every(table, BREAKDOWN, i + 2).alias(n) for i, n in enumerate(names)])
    devices = F.transform(zipped, lambda e: F.struct(F.trim(e["device"]).alias("device"), *[_whole(e[n]).alias(n) for n in names]))
    host_names = ["self_mib", "model_mib", "kv_mib", "compute_mib"]
    host = F.when(table.rlike(BREAKDOWN_HOST), F.struct(*[_whole(F.regexp_extract(table, BREAKDOWN_HOST, i + 1)).alias(n) for i, n in enumerate(host_names)]))
    return devices, host


# A context reaches from the end of the one before it (`\G`) to its graph-shape lines.
CONTEXT = r"\G(?s:.*?)(?d:" + CONTEXT_END + ")"
_POOL = {"total_mib": _num, "cells": _whole, "layers": _whole, "seqs": _whole, "seqs_max": _whole, "k_type": F.trim, "k_mib": _num, "v_type": F.trim, "v_mib": _num}
_STATE = {"total_mib": _num, "cells": _whole, "layers": _whole, "seqs": _whole, "rs_seq": _whole, "r_mib": _num, "s_mib": _num}


def _groups(found: Column, pattern: str, kinds: dict) -> Column:
    """The groups of one match, read from the match alone, as a struct."""
    return F.struct(*[kind(F.regexp_extract(found, pattern, i)).alias(name) for i, (name, kind) in enumerate(kinds.items(), 1)])


def _buffers(part: Column) -> Column:
    """Map per device of its buffers by role; the last figure of a repeated role stays."""
    def read(line: Column) -> Column:
        stage, kind = F.regexp_extract(line, DEV_BUFFER, 1), F.lower(F.regexp_extract(line, DEV_BUFFER, 3))
        role = F.when(kind != "", kind).when(stage.endswith("load_tensors"), "model").otherwise("compute")
        return F.struct(F.regexp_extract(line, DEV_BUFFER, 2).alias("device"), role.alias("k"), _num(F.regexp_extract(line, DEV_BUFFER, 4)).alias("v"))

    def build(rows: Column) -> Column:
        devices = F.array_distinct(F.transform(rows, lambda e: e["device"]))
        return F.map_from_arrays(devices, F.transform(devices, lambda d: _entries(F.filter(rows, lambda e: e["device"] == d), last=True)))

    return _let(F.transform(every(part, DEV_BUFFER, 0), read), build)


def _context(part: Column) -> Column:
    """Buffers, pools and graph shape of one context's part of a log."""
    shape = F.transform(every(part, GRAPH_SHAPE, 0), lambda m: F.struct(F.regexp_extract(m, GRAPH_SHAPE, 1).alias("k"), _whole(F.regexp_extract(m, GRAPH_SHAPE, 2)).alias("v")))
    last = lambda name: F.try_element_at(F.filter(shape, lambda e: e["k"] == name), F.lit(-1))["v"]
    state = _let(F.regexp_extract(part, RS_POOL, 0), lambda m: F.when(m != "", _groups(m, RS_POOL, _STATE)))
    pools = F.transform(every(part, KV_POOL, 0), lambda m: _groups(m, KV_POOL, _POOL))
    return F.struct(_buffers(part).alias("buffers"), pools.alias("kv_pools"), state.alias("rs_pool"), last("nodes").alias("graph_nodes"), last("splits").alias("graph_splits"))


def contexts(text: Column) -> Column:
    """One entry per context; a context ends with its graph-shape lines.

    What follows the last of them belongs to none. A log without any has no
    contexts, a null one null. A figure that is no number is zero.
    """
    return F.transform(every(text, CONTEXT, 0), _context)


def vision(text: Column) -> Column:
    """Projector reservation: every field, or nothing when no device reserved any."""
    reserved = _entries(_pairs(text, VISION_RESERVED, 2, 1, _num), last=True)
    tensors = F.aggregate(F.transform(every(text, CLIP_TENSOR), _whole), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(reserved.isNotNull(), F.struct(
        reserved.alias("reserved_mib"), tensors.alias("tensor_bytes"), once(text, CLIP_IMAGE).try_cast("long").alias("image_size"), once(text, CLIP_MERGE).try_cast("long").alias("n_merge")
    ))


def parse_logs(logs: DataFrame, text: str = "text") -> DataFrame:
    """One row of parsed fields per load log; a reader that needs few of them pays for few."""
    t = F.col(text)
    fields = []
    for name, pattern in [("arena_mib", ARENA), ("out_buf_mib", OUT_BUF), ("cpu_kv_mib", CPU_KV), ("cpu_model_mib", CPU_MODEL)]:
        last, several = buffer_series(t, pattern)
        fields += [last.alias(name), several.alias(f"{name}_all")]
    devices, host = breakdown(t)
    fields += [
        t.contains("CPU_Mapped model buffer").alias("cpu_model_mapped"), hyperparameters(t).alias("meta"), metadata(t).alias("gguf_kv"), contexts(t).alias("contexts"),
        vision(t).alias("vision"), _num(once(t, DRAFT_TOTAL)).alias("mtp_context_mib"), _whole(once(t, NEXTN)).alias("nextn_predict_layers"),
        t.rlike(PER_LAYER).alias("per_layer_token_embd"), F.coalesce(once(t, ARCH), F.lit("?")).alias("arch"), devices.alias("devices"), host.alias("host_breakdown"),
    ]
    return logs.select(*[c for c in logs.columns if c != text], *fields)


def reparse(records: DataFrame, parsed: DataFrame, old: str, new: str, key: str = "log") -> DataFrame:
    """Each record `rewritten`, `unchanged` or `skipped` when its log is read again."""
    joined = records.join(parsed.select(key, F.col(new).alias("__new"), F.lit(True).alias("__have")), key, "left")
    skip = (F.col("status") != "ok") | (F.coalesce(key, F.lit("")) == "") | F.col("__have").isNull()
    state = F.when(skip, "skipped").when(F.col("__new").eqNullSafe(F.col(old)), "unchanged").otherwise("rewritten")
    return joined.withColumn("outcome", state).withColumn(old, F.when(state == "rewritten", F.col("__new")).otherwise(F.col(old))).drop("__new", "__have")


# --- counter pages ---------------------------------------------------------

# Accepted spellings, oldest first (fixed values).
PROMPT_COUNTERS = ["llamacpp:prompt_tokens_total", "llamacpp:n_prompt_tokens_processed_total"]
PREDICTED_COUNTERS = ["llamacpp:tokens_predicted_total", "llamacpp:n_tokens_predicted_total"]


def progress_counters(pages: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """Prompt plus generated tokens of a counter page; null when neither is on it.

    Of several spellings the first listed wins, of several lines the first.
    """
    lines = pages.select(*key, F.posexplode(F.split(body, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    lines = lines.filter(~F.col("line").startswith("#"))
    name = F.regexp_extract("line", r"^(\S+)\s+(\S+)", 1)
    number = F.regexp_extract("line", r"^(\S+)\s+(\S+)", 2).try_cast("double")
    # Pages hold NaN and infinities too: those are no counts. Counts are never negative.
    value = F.when(~F.isnan(number), F.greatest(number, F.lit(0.0))).try_cast("long")
    wanted = lines.select(*key, "line_no", name.alias("name"), value.alias("value")).filter(F.col("name").isin(PROMPT_COUNTERS + PREDICTED_COUNTERS))
    found = wanted.filter(F.col("value").isNotNull())
    out = []
    for label, names in [("prompt", PROMPT_COUNTERS), ("predicted", PREDICTED_COUNTERS)]:
        rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
        out.append(F.min_by("value", F.when(rank > 0, F.struct(rank.alias("r"), F.col("line_no").alias("l")))).alias(label))
    sums = found.groupBy(*key).agg(*out)
    both = pages.select(*key).join(sums, key, "left")
    total = F.coalesce("prompt", F.lit(0)) + F.coalesce("predicted", F.lit(0))
    return both.select(*key, F.when(F.col("prompt").isNotNull() | F.col("predicted").isNotNull(), total).alias("progress"))


def exposition_lines(samples: DataFrame) -> DataFrame:
    """Text exposition lines in order: `family, rank, line`.

    `samples`: family, help, kind, labels (array of name/value structs), value.
    """
    text = F.concat_ws(",", F.transform("labels", lambda e: F.concat(e["name"], F.lit('="'), e["value"], F.lit('"'))))
    labelled = F.when(F.size("labels") > 0, F.concat(F.lit("{"), text, F.lit("}"))).otherwise(F.lit(""))
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    body = samples.select("family", F.lit(2).alias("rank"), F.concat("family", labelled, F.lit(" "), number).alias("line"))
    heads = samples.select("family", "help", "kind").distinct().select("family", F.explode(F.array(
        F.struct(F.lit(0).alias("rank"), F.concat(F.lit("# HELP "), "family", F.lit(" "), "help").alias("line")),
        F.struct(F.lit(1).alias("rank"), F.concat(F.lit("# TYPE "), "family", F.lit(" "), "kind").alias("line")),
    )).alias("h")).select("family", "h.*")
    return heads.unionByName(body).orderBy("family", "rank", "line")


# --- response bodies -------------------------------------------------------

CHUNK_SCHEMA = """choices array<struct<delta: struct<content: string, reasoning_content: string, reasoning: string>>>,
  usage struct<prompt_tokens: bigint, completion_tokens: bigint>,
  timings struct<prompt_ms: double, predicted_ms: double, prompt_n: bigint, draft_n: bigint, draft_n_accepted: bigint>"""


def response_lines(frames: DataFrame, width: int = 256) -> DataFrame:
    """Complete lines of each streamed body: `request, line_no, at_ms, line`.

    A line may start in one frame and end in a later one; it counts from the
    frame that brings its newline. Frames are numbered by a chunked running sum,
    so one long response is never gathered, only single lines are.
    """
    counted = frames.withColumn("__nl", F.length("body") - F.length(F.replace("body", F.lit("\n"))))
    numbered = scan.running(counted.withColumn("__nl", F.col("__nl").cast("long")), ["request"], ["frame_seq"], {"__upto": scan.total(F.col("__nl"))}, width)
    pieces = numbered.select("request", "frame_seq", "at_ms", (F.col("__upto") - F.col("__nl")).alias("__first"), "__upto", F.posexplode(F.split("body", "\n")).alias("i", "piece"))
    pieces = pieces.withColumn("line_no", F.col("__first") + F.col("i"))
    # A piece that its own frame goes on after is the one the newline follows.
    ends = F.col("line_no") < F.col("__upto")
    whole = pieces.groupBy("request", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_seq", "piece"))), lambda e: e["piece"]), "").alias("line"), F.max(F.when(ends, F.col("at_ms"))).alias("at_ms")
    )
    return whole.filter(F.col("at_ms").isNotNull())


def _response_summary(chunks: DataFrame) -> DataFrame:
    c = F.col("c")
    at = F.col("line_no")
    out = [F.max_by(c["usage"], F.when(c["usage"].isNotNull(), at)).alias("usage")]
    for name, alias in [("prompt_ms", "prompt_ms"), ("predicted_ms", "predicted_ms"), ("prompt_n", "prompt_eval_tokens"), ("draft_n", "draft_tokens"), ("draft_n_accepted", "draft_tokens_accepted")]:
        value = c["timings"][name]
        if name.endswith("_ms"):
            value = F.round(value).cast("long")
        out.append(F.max_by(value, F.when(value.isNotNull(), at)).alias(alias))
    delta = F.try_element_at(c["choices"], F.lit(1))["delta"]
    words = F.coalesce(delta["content"], delta["reasoning_content"], delta["reasoning"])
    out.append(F.min(F.when(words != "", F.col("at_ms"))).alias("first_token_ms"))
    return chunks.groupBy("request").agg(*out)


def response_metrics(requests: DataFrame, frames: DataFrame, width: int = 256) -> DataFrame:
    """Token counts and timings per request from its response body.

    `requests`: request, start_ms, end_ms, streaming. `frames`: request,
    frame_seq, at_ms, body. In a stream the last usage object and the last
    non-null timing win and the first text sets the time to first token; a
    plain body is parsed whole. What does not parse is ignored.
    """
    kinds = requests.select("request", "streaming")
    tagged = frames.join(kinds, "request")
    lines = response_lines(tagged.filter("streaming").drop("streaming"), width)
    data = lines.withColumn("line", F.trim("line")).filter(F.col("line").startswith("data: ")).select("request", "line_no", "at_ms", F.expr("substring(line, 7)").alias("data"))
    # One plain body is one document, so its frames belong together.
    bodies = tagged.filter("not streaming").groupBy("request").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_seq", "body"))), lambda e: e["body"]), "").alias("data")
    ).select("request", F.lit(0).cast("long").alias("line_no"), F.lit(None).cast("long").alias("at_ms"), "data")
    parsed = data.filter(F.col("data") != "[DONE]").unionByName(bodies).withColumn("c", F.from_json("data", CHUNK_SCHEMA))
    summary = _response_summary(parsed)
    joined = requests.join(summary, "request", "left")
    return joined.select(
        "request", F.col("usage.prompt_tokens").alias("prompt_tokens"), F.col("usage.completion_tokens").alias("completion_tokens"), "prompt_eval_tokens",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), (F.col("first_token_ms") - F.col("start_ms")).alias("ttft_ms"), "prompt_ms", "predicted_ms", "draft_tokens", "draft_tokens_accepted",
    )
