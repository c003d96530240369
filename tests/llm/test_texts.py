"""Odd inputs and plain versions of the operators on single texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import bpe, language, quality, secrets, toxicity
from meterloom.llm.common import bounded, fold, pieces, ragged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, findings string, LANG_PRED int, ids string, decoded string"


def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "the thing is"), (4, "same same"), (4, "same same"), (5, "word " * 30_000), (6, "x" * 100_000), (7, "日本 العربية 123 🙂")]
    return spark.createDataFrame([(i, t, None, None, None, "old", "old", 0, "old", "old") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(spark, n=300):
    rng = random.Random(3)
    words = {"en": ["the", "thing", "and", "other", "with"], "de": ["der", "und", "nicht", "schön", "mit"], "ru": ["это", "для", "слово", "как"]}
    rows = []
    for i in range(n):
        lang = list(words)[i % 3]
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


def test_helpers(spark):
    assert list(pieces([5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4)]
    assert ragged(np.array([3, 0, 10]), np.array([2, 0, 3])).tolist() == [3, 4, 10, 11, 12]
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    a, b = ({r[0] for r in bounded(df, ["doc_id"], 50).collect()} for _ in range(2))
    assert a == b and 20 < len(a) <= 50
    import zlib

    assert [r[0] for r in df.select(fold("doc_id", 4)).limit(5).collect()] == [zlib.crc32(str(i).encode()) % 4 for i in range(5)]


# Language


@pytest.fixture(scope="module")
def lingua(spark):
    return language.train(corpus(spark))


def test_languages_and_spans(spark, lingua):
    assert lingua.langs == ["de", "en", "ru"]
    text = "the thing and the other thing with the other и это слово для слово как"
    found = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = language.identify(found, lingua, switch=3.0).first()
    assert [text[s["start"] : s["end"]].split()[0] for s in row["spans"]] == ["the", "и"] and [s["lang"] for s in row["spans"]] == ["en", "ru"]
    assert row["lang_pred"] == "en" and 0 < row["score"] < 1


def test_language_of_odd_rows(spark, lingua):
    out = language.identify(odd(spark), lingua)
    assert out.count() == 9 and [c.lower() for c in out.columns].count("lang_pred") == 1
    got = {r["doc_id"]: r for r in out.collect()}
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, []) for i in (1, 2, 3))
    assert got[7]["lang_pred"] in lingua.langs
    assert language.identify(empty(spark), lingua).count() == 0
    none = language.train(empty(spark))
    assert none.langs == [] and {r["lang_pred"] for r in language.identify(odd(spark), none).collect()} == {"und"}


def test_viterbi_against_all_labellings():
    from itertools import product

    rng = np.random.default_rng(1)
    counts = np.array([4, 1, 0, 5])
    scores = rng.normal(size=(10, 3)) * 4
    got = language._best(scores, counts, 2.0)
    begin = 0
    for n in counts:
        part = scores[begin : begin + n]
        value = lambda path: sum(part[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        assert not n or value(got[begin : begin + n]) == pytest.approx(max(map(value, product(range(3), repeat=int(n)))))
        begin += n


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out()))
    right = language.identify(docs.where(language.held_out()), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


# Toxicity and quality


def trained(spark, operator, label):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", label)
    learn = fold("doc_id", 5) != 0
    model = operator.train(docs.where(learn), labels.where(learn))
    rows = operator.score(docs.where(~learn), model).join(labels, "doc_id").select("score", label).collect()
    return model, np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def auc(score, label):
    place = np.argsort(np.argsort(score))
    n = label.sum()
    return (place[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("operator, label, least", [(toxicity, "toxic", 0.8), (quality, "quality", 0.95)])
def test_held_out_scores(spark, operator, label, least):
    model, score, truth = trained(spark, operator, label)
    assert auc(score, truth) > least
    out = operator.score(odd(spark), model)
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert out.count() == 9 and out.columns.count("score") == 1 and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] == got[3]
    assert operator.score(empty(spark), model).count() == 0


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_nothing_to_learn_from(spark, operator, label):
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1)], f"doc_id long, {label} int")
    for labels in (none, none.where("false")):
        for docs in (odd(spark), empty(spark)):
            model = operator.train(docs, labels)
            assert len({round(r["score"], 9) for r in operator.score(odd(spark), model).collect()}) == 1


def test_risk_is_kept_from_going_negative():
    # Feature 0 marks positives, half of the unlabelled texts with it are positives too.
    positive = np.array([True] * 20 + [False] * 100)
    row = np.concatenate([np.arange(20), np.arange(20, 40)])
    weight, bias = toxicity.descend(row, np.zeros(40, np.int64), 1, positive, 0.2)
    assert bias < 0 < bias + weight[0]


def test_quality_projection_is_the_mean_of_vectors(spark):
    model = quality.fit(["good fine text here", "bad junk ### !!"] * 5, [1, 0] * 5)
    text = "good ### text text"
    bucket, weight = quality._features([text])[0]
    logit = np.append(weight @ model.vectors[bucket], 1.0) @ model.output
    want = 1 / (1 + np.exp(logit[0] - logit[1]))
    got = quality.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["score"]
    assert got == pytest.approx(want)


# BPE


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    signs = [*" \n\t'sdtvermll!.,?ab1²½Éñßİ漢\u0085　​🏽-_", "'ll", "  ", "<|endoftext|>", "don't", "''s", " 's"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["a" * 3000, "word " * 2000, "<|endoftext|>"]
    with open(path, encoding="utf-8") as f:
        v = bpe.vocabulary(f.read())
    for words in ([], [b"don", b"'t", b" word", b"a", b"\n"]):
        ids, sizes = bpe.encode_texts(texts, v, bpe.compile_lexicon(words, v))
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
        assert bpe.decode_ids(ids, sizes, v) == [library.decode(w, skip_special_tokens=False) for w in want]
    wild = [[rng.randrange(v.size) for _ in range(12)] for _ in range(500)]
    assert bpe.decode_ids(np.concatenate(wild), np.full(500, 12), v) == [library.decode(w, skip_special_tokens=False) for w in wild]


def test_lexicon_is_minimal_and_complete(tmp_path):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        v = bpe.vocabulary(f.read())
    words = [b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b" x"]
    lexicon = bpe.map_lexicon(bpe.write_lexicon(bpe.compile_lexicon(words, v), str(tmp_path)))
    place = bpe.look_up([*words, b"ta", b"tapss", b"", b"y"], lexicon)
    assert sorted(place[:7].tolist()) == list(range(7)) and (place[7:] == -1).all()
    for w, p in zip(words, place):
        assert lexicon["ids"][lexicon["start"][p] : lexicon["start"][p + 1]].tolist() == bpe.merge(w, v)
    tails = {frozenset(w[i:] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} for i in [len(p)]}
    assert len(lexicon["final"]) == len(tails)  # one state per set of continuations


def test_bpe_of_odd_rows(spark):
    import public_tokenizers

    for docs in (odd(spark), empty(spark)):
        codec = bpe.prepare(docs, public_tokenizers.path("byte_bpe_50k.json"), words=20)
        out = bpe.decode(bpe.encode(docs, codec), codec)
        assert out.columns.count("ids") == out.columns.count("decoded") == 1
        assert all(r["decoded"] == (r["text"] or "") for r in out.collect()) and out.count() == docs.count()
    one = bpe.encode(spark.createDataFrame([(1, "a<|endoftext|>")], "doc_id long, text string"), codec)
    assert one.select(bpe.unpack()).first()[0] == [64, 50256]


# Secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_secrets_are_found_and_masked(spark, forest):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'see someone@mail4.example.com, token = "{key}" and commit {key} or 4699065906345690. token = "{key}"'
    docs = spark.createDataFrame([(1, text, "src1")], "doc_id long, text string, source string")
    found = secrets.scan(docs, forest, path_col="source").first()["findings"]
    assert [text[f["start"] : f["end"]] for f in found] == [key, key] and all(f["score"] >= 0.5 for f in found)
    assert text[found[0]["start"] - 1] == text[found[1]["end"]] == '"'
    assert secrets.redact(docs, forest, path_col="source").first()["text"] == text.replace(f'"{key}"', '"[SECRET]"')


def test_forest_on_held_out_findings(spark, forest):
    other = secrets.labelled_findings(spark, 6_000).where("label is not null").subtract(secrets.labelled_findings(spark))
    rows = other.select(F.concat("left", "candidate", "right").alias("text"), "path", "label")
    hit = secrets.scan(rows, forest, path_col="path").agg(F.avg(((F.size("findings") > 0) == (F.col("label") == 1)).cast("int"))).first()[0]
    assert hit > 0.95


def test_secrets_of_odd_rows(spark, forest):
    out = secrets.scan(odd(spark), forest)
    assert out.count() == 9 and out.columns.count("findings") == 1 and all(r["findings"] == [] for r in out.collect())
    assert by_id(secrets.redact(odd(spark), forest), "text") == by_id(odd(spark), "text")
    assert secrets.scan(empty(spark), forest).count() == secrets.redact(empty(spark), forest).count() == 0
    many = " ".join(f'token = "{i:040x}"' for i in range(500))
    docs = spark.createDataFrame([(1, many)], "doc_id long, text string")
    assert secrets.redact(docs, secrets.train(secrets.labelled_findings(spark).where("false"))).first()["text"].count("[SECRET]") == 500


def test_no_python_in_the_secret_scan(spark, forest):
    plan = secrets.scan(odd(spark), forest)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
