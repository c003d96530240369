"""Runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from meterloom.llm import periodic
from meterloom.llm.common import table
from test_texts import empty, odd

SMALL = "/root/testdata/sf0.001"


def plain_runs(w, least=24, exponent=3):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q):
                s = w[i : i + length]
                if not any(s[r:] == s[: length - r] for r in range(1, q)):
                    out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def plain_row(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(plain_collapse(w, runs))))


def sequences(rng):
    """Words of few letters, repeated stretches and their repetitions, nested."""
    w = []
    for _ in range(rng.randrange(0, 5)):
        letters = rng.choice((1, 2, 3, 50))
        kind = rng.randrange(4)
        if kind == 0:
            w += [rng.randrange(letters) for _ in range(rng.randrange(60))]
        elif kind == 1:
            w += ([rng.randrange(letters) for _ in range(rng.randrange(1, 14))] * 60)[: rng.randrange(10, 90)]
        elif kind == 2 and w:
            w = (w + w[-rng.randrange(1, len(w) + 1) :] * rng.randrange(1, 4))[:300]
        else:
            w += [rng.randrange(100, 999) for _ in range(rng.randrange(5))]
    return [b"%d" % x for x in w]


@pytest.mark.parametrize("least, exponent", [(24, 3), (6, 3), (12, 4), (3, 3), (25, 3), (30, 7)])
def test_runs_against_all_periods(least, exponent):
    rng = random.Random(least * exponent)
    for _ in range(60):
        texts = [sequences(rng) for _ in range(rng.randrange(1, 6))]
        assert periodic.runs_of(texts, least, exponent) == [plain_runs(w, least, exponent) for w in texts]


def test_words_shared_by_a_pair():
    for least in range(3, 60):
        for exponent in range(3, 8):
            if least >= exponent:
                assert periodic.shared_words(least, exponent) == min(max(least, exponent * q) - q for q in range(1, least + 1))


def test_texts_of_one_word_and_of_repeated_lines_stay_quick():
    n = 60_000
    assert periodic.runs_of([[b"a"] * n]) == [[(0, n, 1)]]
    assert periodic.runs_of([[b"a", b"b", b"c"] * (n // 3)]) == [[(0, n, 3)]]
    lines = [w for i in range(3_000) for w in [b"%d" % i, *(b"w%d" % k for k in range(20))]]
    assert periodic.runs_of([lines]) == [[]]


def test_query_against_the_plain_version(spark):
    import __spark_entry__ as entry

    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in entry.queries()["op12_periodic_runs"](spark, SMALL).collect()}
    want = {r["doc_id"]: plain_row(r["doc_id"], r["text"]) for r in rows}
    assert len(rows) == len(want) and any(w[1] for w in want.values()) and got == want


def test_operator_on_odd_rows(spark):
    docs = odd(spark).withColumn("runs", F.lit("clash"))
    out = periodic.find(docs)
    assert sorted(out.columns) == sorted([*docs.columns, "collapsed"]) and out.count() == docs.count()
    for r in out.collect():
        words = r["text"].encode().split() if r["text"] else []
        runs = plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == b" ".join(plain_collapse(words, runs)).decode()
    assert periodic.find(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.find(docs, exponent=2)


def test_greatest_run_is_exact(spark):
    rows = spark.createDataFrame([([(0, 30, 7), (5, 60, 14), (9, 31, 7), (10, 62, 14)],), ([],), (None,)], "runs array<struct<start: long, length: long, period: long>>")
    assert [r[0] and tuple(r[0]) for r in rows.select(periodic.greatest()).collect()] == [(9, 31, 7), None, None]
