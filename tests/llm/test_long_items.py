"""Benchmark items longer than the usual passage."""

import random

import pytest

from meterloom.llm import decontaminate


@pytest.mark.parametrize("size", [60, 250, 400, 1000])
def test_long_items_are_found_at_any_offset(spark, size):
    rng = random.Random(size)
    item = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    spread = [w for k, w in enumerate(item) for w in ([w, "x", "y"] if k % 40 == 39 else [w])]  # a few words put in
    docs = [(at, " ".join(["filler"] * at + item + ["more"] * 300)) for at in (0, 64, 127, 200, 500)]
    docs += [(1000 + at, " ".join(["filler"] * at + spread)) for at in (0, 64, 127)]
    docs.append((2000, " ".join(["filler"] * 64 + item[: size * 7 // 10] + ["more"] * 300)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "some other question of nine words in all")], "item_id long, text string")
    got = {r["doc_id"]: r["overlap"] for r in decontaminate.contaminated(d, items).collect()}
    assert set(got) == {i for i, _ in docs} - {2000} and all(got[at] == 1.0 for at in (0, 64, 127, 200, 500))
    assert {r[0] for r in decontaminate.clean(d, items).select("doc_id").collect()} == {2000}
