"""Source divergence against a plain count."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from meterloom.llm import divergence
from test_texts import empty, odd

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_audit(rows, least, top):
    held, total, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = plain_terms(text)
        total[g].update(terms)
        held[g[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = [g for g in groups if g[0] == lang]
        share = {}
        for name, counts in [*((g, total[g]) for g in own), ("all", sum((total[g] for g in own), Counter()))]:
            of = sum(counts[t] for t in kept)
            share[name] = {t: 1 + 1000000000 * (counts[t] + 2) // (of + 2 * len(kept)) for t in kept}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for g in own:
            pairs = [(-sum(far(share[g][t], share[o][t]) for t in kept), o[1].encode(), o[1]) for o in own if o != g]
            terms = [(-far(share[g][t], share["all"][t]), t.encode(), t) for t in kept if total[g][t] and share[g][t] > share["all"][t]]
            out += [(*g, "pair", item, -v, k) for k, (v, _, item) in enumerate(sorted(pairs), 1)]
            out += [(*g, "term", item, -v, k) for k, (v, _, item) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def corpus(seed=3, sources=9, rows=400):
    rng = np.random.default_rng(seed)
    words = [*(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)), "Émile", "ЖУК", "naïve", "\U0001f600", "a b"]
    out = []
    for _ in range(rows):
        s = int(rng.integers(sources))
        picks = rng.integers(0, len(words), int(rng.integers(0, 40))) // (1 + s % 3)
        out.append((rng.choice([" ", ", ", "\n", "-_-", "1"]).join(words[k].upper() if k % 7 == 0 else words[k] for k in picks), ["en", "de", None, ""][s % 4], None if s == 5 else f"s{s}"))
    return [*out, (None, "en", "bare"), ("", "xx", "one"), ("only few words", "xx", "two"), (None, None, None)]


def test_audit_against_the_plain_version(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "value": F.lit("x"), "slot": F.lit(2)})
    for least, settings in ((10, {}), (3, {"block": 16, "tile": 2}), (1, {"block": 40, "tile": 3, "top": 4}), (10_000, {})):
        got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=least, **settings).collect())
        want = plain_audit(rows, least, settings.get("top", 10))
        assert got == want and len({w[2] for w in want}) == (1 if least == 10_000 else 2)


def test_tokens_and_counts_handed_on_early(spark):
    text = "Straße\x00x\x7fY[Z{ab`c퟿A1B d " * 3
    assert divergence.term_counts(text.encode()) == Counter(t.encode() for t in plain_terms(text))
    rows = corpus(8)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    whole = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in divergence.counted(docs, "text", "lang", "source").collect()}
    early = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in divergence.counted(docs, "text", "lang", "source", held=5).collect()}
    assert whole == early


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("alpha Beta, gamma " * 50).encode()
    whole = divergence.term_counts(text)
    for size in (1, 3, 7, 20):
        monkeypatch.setattr(divergence, "SLICE", size)
        assert divergence.term_counts(text) == whole == {b"alpha": 50, b"beta": 50, b"gamma": 50}


def test_large_counts_stay_exact(spark):
    n, of, v = 9_000_000_000_000_000, 9_000_000_000_000_001, 3
    row = spark.createDataFrame([(n, of, v), (0, 5, 0)], "n long, of long, v long")
    assert [r[0] for r in row.select(divergence._share("n", "of", "v")).collect()] == [1 + 1000000000 * (n + 2) // (of + 2 * v), None]


def test_odd_rows_and_empty_tables(spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd(spark).collect()]
    assert sorted(tuple(r) for r in divergence.audit(odd(spark), min_docs=1).collect()) == plain_audit(rows, 1, 10)
    assert divergence.audit(empty(spark)).count() == 0
