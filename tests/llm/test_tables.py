"""Odd inputs and plain versions of the operators over whole tables."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterloom.llm import decontaminate, fixity, licenses, secrets, simhash, topk, toxicity
from meterloom.llm.common import table
from test_nearcopies import plain_kept
from test_texts import SCHEMA, empty, odd  # noqa: F401

SMALL = "/root/testdata/sf0.001"


# Top k


def plain_top_k(queries, rows, k):
    out = []
    for i, q in queries:
        best = defaultdict(lambda: None)
        for j, c in rows:
            if i != j and len(c) == len(q):
                s = int(sum(int(a) * int(b) for a, b in zip(q, c)))
                best[j] = s if best[j] is None else max(best[j], s)
        for n, (s, j) in enumerate(sorted((-s, j) for j, s in best.items())[:k], 1):
            out.append((i, n, j, -s))
    return sorted(set(out))


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)]  # many ties
    rows += [(7, rows[7][1]), (8, [9.0, 9.0, 9.0, 9.0]), (900, []), (901, []), (902, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, (None, [1.0] * 4), (5, None)], "vec_id long, vector array<double>")
    queries = [r for r in rows if r[0] % 50 == 0]
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, 5, block=4, shard=16)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top_k(queries, rows, 5)


def test_top_k_of_large_and_unfit_values(spark):
    big = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 3.0]), (2, [2e9, -3.0])], "vec_id long, vector array<double>")
    assert [tuple(r) for r in topk.top_k(big.where("vec_id = 0"), big, 5).orderBy("rank").collect()] == [(0, 1, 2, 2 * 10**18 - 3), (0, 2, 1, 10**18 + 3)]
    nan = spark.createDataFrame([(0, [0.5, 0.25]), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, None), (4, [float("inf"), 0.0]), (5, [-0.1, 1.0])], "vec_id long, embedding array<float>")
    made = {r[0]: r[1] for r in nan.select("vec_id", topk.quantised()).collect()}
    assert made == {0: [128.0, 64.0], 1: None, 2: None, 3: None, 4: None, 5: [-26.0, 256.0]}
    assert topk.top_k(big.where("false"), big, 5).count() == topk.top_k(big, big.where("false"), 5).count() == 0


@pytest.mark.parametrize("most", [3, 40_000, 10**9])
def test_top_k_of_slices(most):
    rng = np.random.default_rng(most)
    ids, c = rng.integers(0, 60, 200), rng.integers(-most, most + 1, (200, 3)).astype(float)  # ids with several vectors
    queries = np.arange(20) * 4
    q = rng.integers(-most, most + 1, (20, 3)).astype(float)
    wanted = plain_top_k(list(zip(queries, q)), list(zip(ids, c)), 5)
    for slice_ in (1, 7, 64, 200):
        found = list(zip(*(x.tolist() for x in topk.select(queries, q, ids, c, 5, slice_))))
        assert sorted(found) == sorted((i, j, s) for i, _, j, s in wanted)


def test_top_k_gathers_no_repeated_blocks_in_the_driver(spark):
    # The blocks are small, but every shard gets them all: together they are no table to broadcast.
    rows = [(i, [float(i % 7), float(most * (i % 3))]) for most in (1, 10**6) for i in range(300)]
    for df in (spark.createDataFrame(rows[:300], "vec_id long, vector array<double>"), spark.createDataFrame(rows, "vec_id long, vector array<double>")):
        got = topk.top_k(df, df, 2, block=4, shard=8)
        assert got.count() == 600
        got.collect()
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


# Licences


def test_licences(spark):
    mit = licenses.KNOWN["MIT"][2].replace("<year> <holder>", "1999 Someone Else").upper().replace(",", " -")
    rows = [(1, mit), (2, "x\nReleased under the M.I.T. License.\nreleased under the mit licence!"), (3, None), (4, ""), (5, "\n\n"), (6, "copyright only"), (6, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, line int")
    got = sorted((r["doc_id"], r["line"], r["licence"]) for r in licenses.scan(docs, licenses.known(spark)).collect())
    assert got == [(1, 0, "MIT"), (2, 3, "MIT"), *[(6, 0, "CC-BY-NC-4.0"), (6, 0, "CC-BY-NC-4.0"), (6, 1, "CC-BY-NC-4.0"), (6, 1, "CC-BY-NC-4.0")]]
    assert licenses.scan(empty(spark), licenses.known(spark)).count() == 0


# SimHash


def plain_groups(values):
    value = sorted(set(values))
    group = {v: v for v in value}
    changed = True
    while changed:
        changed = False
        for a in value:
            for b in value:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


def test_links_join_the_same_groups(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, 12)
    values = [int(b) for b in base]
    for b in base[:6]:  # chains and stars
        now = int(b)
        for _ in range(14):
            now ^= 1 << int(rng.integers(0, 62))
            values.append(now)
            values.append(now ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))))
    fps = spark.createDataFrame([(v,) for v in [*values, *values[:5]]] + [(None,)], "fp long")
    for tile in (4, 2048):
        got = {r["fp"]: r["root"] for r in simhash.groups(simhash.links(fps, tile=tile)).collect()}
        assert {v: got.get(v, v) for v in set(values)} == plain_groups(values)


def test_pivots_discard_nothing_that_is_linked():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = np.concatenate([x, x ^ np.uint64(5), x ^ np.uint64(1 << 40)])
    some, root = simhash.linked(near.view(np.int64))
    assert len(some) == 400 and len(set(root.tolist())) == 200


def test_near_duplicates_of_odd_rows(spark):
    got = sorted((tuple(r) for r in simhash.near_duplicates(odd(spark)).collect()), key=repr)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(i, "0" * 16, 1) for i in (1, 2, 3)]
    assert len(got) == 9 and len([g for g in got if g[0] == 4 and g[2] == 4]) == 2 and [g[2] for g in got if g[0] is None] == [None]
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]
    assert simhash.near_duplicates(empty(spark)).count() == simhash.keep_one(empty(spark)).count() == 0


def test_simhash_fingerprint_by_hand():
    import xxhash

    for text in ("One two\tTHREE four\x0bfive É", "a b", "word", "x y z x y z x y z"):
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
        runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint_of(text) % (1 << 64) == want
    assert simhash.fingerprint_of("\xa0") != 0 and simhash.fingerprint_of(" \n") == simhash.fingerprint_of(None) == 0


# Decontamination


def plain_hits(docs, items, stride):
    out = defaultdict(list)
    for d, text in docs:
        w = decontaminate.words_of(text)
        for i, question in items:
            want = decontaminate.shingles(decontaminate.words_of(question))
            for p in range(len(w) // stride + 1):
                begins = range(p * stride, min(p * stride + 2 * stride, len(w) - 4)) if len(w) >= 5 else [0] * (p == 0 and bool(w))
                there = {tuple(w[b : b + 5]) for b in begins}
                if want and len(want & there) / len(want) >= 0.8 - 1e-9:
                    out[d, i].append(len(want & there) / len(want))
    return sorted((d, i, max(v), len(v)) for (d, i), v in out.items())


def test_decontamination_against_all_pairs(spark):
    docs = [(r[0], r[1]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    items = [(r[0], r[1]) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    half = " ".join(decontaminate.words_of(items[0][1])[:-8])
    most = "Zzz " + " ".join(decontaminate.words_of(items[0][1])[:-2]).upper().replace(" ", "!! ")
    docs += [(9001, half), (9002, most), (9003, "filler " * 300 + items[1][1]), (9004, None), (9005, ""), (9006, "two words")]
    items += [(9001, "two words"), (9002, ""), (9003, None), (9004, "!!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("passage", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    for stride in (16, 128):
        got = sorted(tuple(r) for r in decontaminate.contaminated(d, b, stride=stride).collect())
        assert got == plain_hits(docs, items, stride)
    hit = {g[0] for g in got}
    assert {9002, 9003, 9006} <= hit and not {9001, 9004, 9005} & hit
    assert {r[0] for r in decontaminate.clean(d, b).select("doc_id").collect()} == {x[0] for x in docs} - hit


def test_answers_have_to_be_there_too(spark):
    q, a = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, q, a), (2, q, None)], "item_id long, q string, a string")
    docs = spark.createDataFrame([(1, f"x {q} y {a} z"), (2, f"x {q} y")], "doc_id long, text string")
    got = sorted(tuple(r)[:2] for r in decontaminate.contaminated(docs, items, "q", "a").collect())
    assert got == [(1, 1), (1, 2), (2, 2)]


def test_several_passes_and_no_items(spark, monkeypatch):
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    whole = sorted(tuple(r) for r in decontaminate.contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    monkeypatch.setattr(decontaminate, "POSTINGS", 1_000)
    assert sorted(tuple(r) for r in decontaminate.contaminated(docs, items).collect()) == whole
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0
    assert decontaminate.clean(odd(spark), items.where("false")).count() == 9
    assert decontaminate.clean(empty(spark), items).columns == empty(spark).columns


# Fixity


def test_fixity_finds_every_fault(spark):
    rows = [(f, o * 50, f"{f}-{o}") for f in (0, 1, 2) for o in range(60)] + [(None, 0, "n"), (3, None, "m"), (4, 0, None), (5, 10, "twice"), (5, 10, "twice")]
    bad = [(f, o, "x" if (f, o) in ((0, 100), (2, 2950)) else r) for f, o, r in rows if (f, o) != (1, 500)] + [(1, 2999, "more"), (6, 0, "new file")]
    made = lambda x: fixity.leaves(spark.createDataFrame(x, "file long, offset long, record string").withColumn("record", F.col("record").cast("binary")))
    for stretch, fan in ((100, 2), (1 << 18, 16)):
        got = sorted((r["file"], r["offset"], r["fault"]) for r in fixity.audit(made(rows), made(bad), stretch, fan).collect())
        assert got == [(0, 100, "changed"), (1, 500, "missing"), (1, 2999, "extra"), (2, 2950, "changed"), (6, 0, "extra")]
    assert fixity.audit(made(rows), made(rows)).count() == 0
    nothing = made(rows).where("false")
    assert fixity.audit(nothing, nothing).count() == 0 and fixity.audit(made(rows), nothing).where("fault = 'missing'").count() == len(rows)


def test_records_behind_a_cut_only_move(spark):
    """Records cut out, changed and added; equal records, one after another and apart."""
    rows = [(f, i, 0, f"{f}-{i % 7 if f == 2 else i}" * (1 + i % 3)) for f in (0, 1, 2, 3) for i in range(40)]
    bad = []
    for f, i, part, r in rows:
        if (f, i) in ((0, 10), (0, 11), (1, 0), (2, 39)):
            continue
        bad.append((f, i, part, "changed" if (f, i) in ((0, 20), (1, 1)) else r))
        if (f, i) in ((0, 30), (3, 39)):
            bad += [(f, i, 1, "added"), (f, i, 2, "added")]
    made = lambda x: fixity.leaves(spark.createDataFrame(x, "file long, n long, part int, record string").withColumn("record", F.col("record").cast("binary")), offset_col=None, order=["n", "part"])

    def offsets(x):
        at, out = defaultdict(int), {}
        for f, i, part, r in x:
            out[f, i, part] = at[f]
            at[f] += len(r)
        return out

    mine, theirs = offsets(rows), offsets(bad)
    want = [(0, mine[0, i, 0], "missing", None) for i in (10, 11)] + [(0, mine[0, 20, 0], "changed", theirs[0, 20, 0])] + [(f, theirs[f, i, k], "extra", theirs[f, i, k]) for f, i in ((0, 30), (3, 39)) for k in (1, 2)]
    # At the start of a file nothing stands before: the changed record takes the place of the one cut out.
    want += [(1, mine[1, 0, 0], "changed", theirs[1, 1, 0]), (1, mine[1, 1, 0], "missing", None), (2, mine[2, 39, 0], "missing", None)]
    for stretch, fan in ((16, 2), (1 << 18, 16)):
        got = [(r["file"], r["offset"], r["fault"], r["replica_offset"]) for r in fixity.audit(made(rows), made(bad), stretch, fan).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


# Pipeline


def test_stages_on_odd_rows_and_empty_tables(spark):
    for docs in (odd(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.encoded(spark, docs, SMALL).where("not exact").count() == 0


def test_pipeline_against_a_plain_version(spark):
    docs = table(spark, SMALL, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()
    from meterloom.llm.common import fold

    learn = fold("doc_id", 5) != 0
    model = toxicity.train(docs.where(learn), table(spark, SMALL, "labels").where(learn))
    left = {r["doc_id"] for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    left = plain_kept([(i, rows[i]["text"]) for i in left])
    items = [(r[0], r[1]) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    left -= {h[0] for h in plain_hits([(i, rows[i]["text"]) for i in left], items, decontaminate.STRIDE)}
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    masked = secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)), path_col="source")
    texts = {r["doc_id"]: r["text"] for r in masked.collect() if r["doc_id"] in left}
    want = {i: np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, t in texts.items()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert {i: bytes(r["ids"]) for i, r in got.items()} == want and all(r["exact"] for r in got.values())


def test_stage_keeps_n_chars_right(spark):
    text = 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b'
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars int")
    out = {r["doc_id"]: r for r in corpus_pipeline.masked(spark, docs, SMALL).collect()}
    assert out[1]["n_chars"] == len(out[1]["text"]) == len(text) - 40 + 8 and out[2]["n_chars"] is None


@pytest.mark.parametrize("name", ["op5_simhash"])
def test_query_against_brute_force(spark, name):
    import __spark_entry__ as entry

    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in entry.queries()[name](spark, SMALL).collect()}
    group = plain_groups([f for f, _ in got.values()])
    least = {}
    for i, (f, _) in got.items():
        least[group[f]] = min(least.get(group[f], i), i)
    assert all(c == least[group[f]] for f, c in got.values())
