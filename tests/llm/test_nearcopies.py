"""Near copies against brute-force Jaccard."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from meterloom.llm import nearcopies
from test_texts import empty, odd


def plain_kept(rows, share=0.8):
    """Smallest ids of the groups that five-word Jaccard similarity joins."""
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if group[a] != group[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-9:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return set(group.values())


def near(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def texts(n=25):
    """Copies of 20 to 400 words with so many words changed that similarities lie on both sides of 0.8."""
    rng = random.Random(12)
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((20, 60, 150, 400)))]
        out += [" ".join(near(rng, base, rng.randrange(0, 2 + len(base) // 30))) for _ in range(6)]
        out.append(" ".join(near(rng, out[-1].split(), 1)).upper())
    rng.shuffle(out)
    return list(enumerate(out))


def test_stage_against_brute_force_jaccard(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert 25 < len(want) < len(rows) - 40
    assert {r[0] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()} == want


def test_small_tiles_and_pivots_lose_no_link(spark):
    rows = texts(8)
    sketched = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = nearcopies.map_text(sketched, "text", nearcopies._SCHEMA, nearcopies._sketched).withColumn("__row", F.col("doc_id")).localCheckpoint()
    for size in ({"tile": 2}, {"shingles": 300}):
        edges = nearcopies.links(sketched, "text", **size)
        found = nearcopies.simhash._rooted(sketched.select(F.col("__set").alias("fp"), "doc_id"), F.col("doc_id"), edges)
        assert {r[0] for r in found.select("best").distinct().collect()} == plain_kept(rows)
    many = texts(40)
    u, v = nearcopies.linked(np.arange(len(many)), [nearcopies.shingle_set(t) for _, t in many])
    assert len(many) > 8 * nearcopies.PIVOTS and len(set(range(len(many))) - set(u.tolist())) == len(plain_kept(many))


def test_near_copies_of_odd_rows(spark):
    kept = nearcopies.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]
    assert nearcopies.keep_one(empty(spark)).count() == 0


def test_alike_sets_have_near_fingerprints():
    rng = np.random.default_rng(3)
    far = 0
    for n in (5, 9, 20, 60, 300):
        for _ in range(60):
            base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            lost = n // 9 if n > 5 else 1
            other = np.concatenate([base[lost:], rng.integers(0, 1 << 64, lost if n > 5 else 0, dtype=np.uint64)])
            assert len(np.intersect1d(base, other)) >= 0.8 * len(np.union1d(base, other)) - 1e-9
            a, b, c = (nearcopies.print_of(np.unique(s)) for s in (base, other, rng.integers(0, 1 << 64, n, dtype=np.uint64)))
            assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= nearcopies.RADIUS
            far += np.bitwise_count((a ^ c).view(np.uint64)).sum() > nearcopies.RADIUS
    assert far == 300


def test_fingerprints_beyond_the_radius_are_not_linked(spark):
    """Sets that share a band only meet in full where their fingerprints are near."""
    rows = [(k, k, [7] * nearcopies.BANDS, [v] * nearcopies.PRINT) for k, v in enumerate((0, 1, 3, -1, -2))]
    distinct = spark.createDataFrame(rows, "fp long, __row long, bands array<long>, print array<long>")
    for tile in (1, 2, 100):
        found = nearcopies.simhash.groups(nearcopies.candidates(distinct, tile))
        assert {tuple(r) for r in found.collect()} == {(1, 0), (2, 0), (4, 3)}
    ids = np.arange(400)
    prints = np.repeat(np.random.default_rng(1).integers(-(1 << 63), 1 << 63 - 1, (40, nearcopies.PRINT)), 10, axis=0) ^ (ids[:, None] % 10)
    u, v = nearcopies.within(ids, prints)
    assert dict(zip(u.tolist(), v.tolist())) == {i: i - i % 10 for i in ids.tolist() if i % 10}
