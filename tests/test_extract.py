"""Contexts of load logs against a plain walk over the text."""

import re
import time

from pyspark.sql import functions as F

from meterloom.operators import extract as E

POOL = ["total_mib", "cells", "layers", "seqs", "seqs_max", "k_type", "k_mib", "v_type", "v_mib"]
STATE = ["total_mib", "cells", "layers", "seqs", "rs_seq", "r_mib", "s_mib"]


def kind(name):
    return float if name.endswith("mib") else str if name.endswith("type") else int


def plain(log):
    out, start = [], 0
    for end in re.finditer(E.CONTEXT_END, log):
        part, start = log[start : end.end()], end.end()
        buffers = {}
        for stage, device, role, mib in re.findall(E.DEV_BUFFER, part):
            buffers.setdefault(device, {})[role.lower() or ("model" if stage.endswith("load_tensors") else "compute")] = float(mib)
        state = re.search(E.RS_POOL, part)
        shape = dict(re.findall(E.GRAPH_SHAPE, part))
        out.append((
            buffers,
            [tuple(kind(n)(v) for n, v in zip(POOL, found)) for found in re.findall(E.KV_POOL, part)],
            tuple(kind(n)(v) for n, v in zip(STATE, state.groups())) if state else None,
            *[int(shape[k]) if k in shape else None for k in ("nodes", "splits")],
        ))
    return out


def read(spark, logs):
    rows = spark.createDataFrame(list(enumerate(logs)), "i int, text string").select("i", E.contexts(F.col("text")).alias("c")).orderBy("i").collect()
    return [None if r.c is None else [(c.buffers, [tuple(p) for p in c.kv_pools], c.rs_pool and tuple(c.rs_pool), c.graph_nodes, c.graph_splits) for c in r.c] for r in rows]


LOAD = "load_tensors: CUDA0 model buffer size = 10.5 MiB\nload_tensors: CUDA0 buffer size = 11.5\nllm_load_tensors:   CUDA1   buffer size = 7\n"
KV = "llama_kv_cache: CUDA0 KV buffer size = 3.25 MiB\nllama_kv_cache: size = 6.50 MiB (  4096 cells,  12 layers,  1/2 seqs), K (f16): 3.00 MiB, V (q8_0): 3.50 MiB\n"
RS = "llama_memory_recurrent: size = 2.00 MiB ( 4 cells, 24 layers, 1 seqs 3 rs_seq), R (f32): 0.50 MiB, S (f32): 1.50 MiB\n"
END = "x sched_reserve: graph nodes  = 77\nx sched_reserve: graph splits = 3\n"
BARE = "llama_init_from_model: graph nodes = 5"


def test_contexts_against_a_plain_walk(spark):
    logs = [
        "", "nothing\nhere\n", BARE, LOAD + KV + END, LOAD + KV + KV + RS + END + KV + RS + RS.replace("2.00", "9.00") + BARE + "\n",
        END + END + LOAD, LOAD + END.replace("\n", "\r\n") + KV + BARE, END.replace("3\n", "3 graph splits = 4\n"), "sched_reserve: : graph nodes\n" + KV + "\u0085" + END,
        BARE + "\nother line\nsched_reserve: graph splits = 3\n" + BARE + "\n\n", KV + "graph nodes = 1\n" + BARE.replace("= 5", "") + "\n" + END,
    ]
    assert read(spark, logs) == [plain(log) for log in logs]
    assert read(spark, [None]) == [None]


def test_a_figure_that_is_no_number_is_zero(spark):
    assert read(spark, ["load_tensors: CUDA0 model buffer size = 1.2.3\n" + END])[0][0][0] == {"CUDA0": {"model": 0.0}}


def test_contexts_of_very_long_logs(spark):
    noise = "slot update: nothing to see in this line of the log\n"
    for log in [noise * 40_000, END + noise * 40_000, noise * 20_000 + END + "a" * 1_000_000, (LOAD + KV + END) * 2_000]:
        began = time.time()
        assert read(spark, [log]) == [plain(log)]
        assert time.time() - began < 20


def test_archives_and_tasks_hold_a_bounded_number_of_logs(spark, tmp_path, monkeypatch):
    from meterloom.catalog import extract as X

    spark.range(1, 101).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    read = []
    monkeypatch.setattr(X, "LOGS_PER_TASK", 30)
    monkeypatch.setattr(X, "LOGS_PER_ARCHIVE", 10)
    monkeypatch.setattr(X.S, "read_log_corpus", lambda s, path, real=X.S.read_log_corpus: read.append(real(s, path)) or read[-1])
    assert X.QUERIES["s8_log_corpus"](spark, str(tmp_path)).collect() == [(125,)]
    logs = [r["text"].count("print_info: arch") for r in read[0].collect()]
    assert sum(logs) == 100 and max(logs) <= 10
    assert X._print_logs(spark, str(tmp_path)).rdd.getNumPartitions() == 4
