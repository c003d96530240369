"""The chosen-path join against brute-force Jaccard."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import chosenpath
from meterloom.llm.common import table
from test_texts import empty, odd

SMALL = "/root/testdata/sf0.001"


def plain_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows, percent=85):
    """doc_id -> (size of its set, smallest id reachable), ids distinct."""
    sets = {i: plain_set(t) for i, t in rows}
    group = {i: i for i in sets}
    full = [i for i in sets if sets[i]]
    for a in full:
        for b in full:
            if a < b and group[a] != group[b]:
                if min(len(sets[a]), len(sets[b])) * 100 < percent * max(len(sets[a]), len(sets[b])):
                    continue
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((group[a], group[b]))
                    group = {k: low if g == high else g for k, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in sets}


def changed(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def texts(seed, n=25, copies=6):
    """Copies of 20 to 400 words with so many words changed that similarities lie on both sides of 0.85."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((20, 60, 150, 400)))]
        out += [" ".join(changed(rng, base, rng.randrange(0, 2 + len(base) // 40))) for _ in range(copies)]
        out.append(" ".join(changed(rng, out[-1].split(), 1)).upper())
    shared = [f"s{k}" for k in range(40)]
    out += [" ".join(shared + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]) for _ in range(n)]
    rng.shuffle(out)
    return list(enumerate(out, 3))


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def expected(rows):
    return {i: (n, c, c == i) for i, (n, c) in plain_components(rows).items()}


@pytest.mark.parametrize("settings", [{}, {"node": 4, "local": 4, "depth": 3}, {"node": 6, "local": 20, "depth": 1}, {"node": 2, "local": 12, "depth": 4, "crowded": 0.3}])
def test_components_against_brute_force_jaccard(spark, settings):
    rows = texts(12)
    want = expected(rows)
    assert 40 < sum(w[2] for w in want.values()) < len(rows) - 40
    assert found(chosenpath.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), **settings)) == want


def test_a_crowd_around_one_text(spark):
    """Copies that are near the first text but not near each other, and others near to one of the copies only."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    near = [changed(rng, base, 6) for _ in range(60)]
    rows = [" ".join(base)] + [" ".join(w) for w in near] + [" ".join(changed(rng, w, 6)) for w in near[:20]] + [" ".join(changed(rng, base, 60)) for _ in range(20)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = expected(rows)
    assert 1 < len({w[1] for w in want.values()}) < 40
    for node, local in ((8, 8), (16, 1000), (256, 4096)):
        assert found(chosenpath.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), node=node, local=local)) == want


def test_groups_hold_every_alike_pair(monkeypatch):
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 3, (40, chosenpath.TOKENS)).astype(np.uint16)
    tokens[20:] = np.where(rng.random((20, chosenpath.TOKENS)) < 0.85, tokens[:20], tokens[20:])
    size = rng.integers(90, 110, 40)
    ids = rng.permutation(1000)[:40].astype(np.int64)
    near = {(int(ids[a]), int(ids[b])) for a in range(40) for b in range(a) if (tokens[a] == tokens[b]).sum() >= chosenpath.ALIKE and 100 * min(size[a], size[b]) >= 85 * max(size[a], size[b])}
    assert len(near) > 8
    for pairs, shingles in ((1, 10**6), (200_000, 150)):
        monkeypatch.setattr(chosenpath, "PAIRS", pairs)
        made = chosenpath.Found(shingles=shingles)
        made.add(ids, size, tokens)
        gid, fp = (c.to_numpy() for c in made.batch().columns)
        held = [set(fp[gid == g].tolist()) for g in np.unique(gid)]
        assert all(any({a, b} <= h for h in held) for a, b in near)
        assert shingles > 1000 or max(map(len, held)) == 2


def test_linked_is_exact_at_the_threshold():
    hundred = np.arange(100, dtype=np.uint64)
    for k, linked in ((85, 1), (84, 0)):
        u, _ = chosenpath.linked(np.array([7, 9]), [hundred, hundred[:k]])
        assert len(u) == linked


def test_query_against_brute_force(spark):
    import __spark_entry__ as entry

    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = found(entry.queries()["op11_near_copies"](spark, SMALL))
    assert got == expected(rows) and len({g[1] for g in got.values()}) < len(got)


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark).withColumn("kept", F.lit("clash")).withColumn("__size", F.lit(1))
    out = chosenpath.near_copies(docs)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "score", "findings", "LANG_PRED", "ids", "decoded", "n_shingles", "component_id", "kept"}
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, None, False), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 7, True)], key=repr)
    assert chosenpath.near_copies(empty(spark)).count() == 0
