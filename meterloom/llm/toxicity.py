"""Toxicity scores from positive and unlabelled texts.

A linear classifier over the presence of hashed word and character n-grams is
trained with the non-negative positive-unlabelled risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

under logistic loss. When the part in the maximum turns negative the step goes
against its gradient, which keeps the classifier from memorising the positives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm.common import bounded, map_text, pieces, ragged
from meterloom.llm.subword import hashed, numbered
from meterloom.session import settle

BUCKETS = 1 << 18
SIZES = (4, 6, 8)
OFTEN = 3
#: Bound of the training sample: confirmed rows and unlabelled rows collected.
POSITIVES = 2_000
UNLABELLED = 8_000
#: Features kept: those whose share among positives stands out by so many standard errors.
STANDS_OUT = 7.0
#: … and which occur in this share of the sampled positives.
SUPPORT = 0.015
#: … and in so many of them.
LEAST = 4
MOST_FEATURES = 4_096


@dataclass(frozen=True)
class Model:
    number: np.ndarray  # feature -> its number among those kept, -1 if not used
    weight: np.ndarray
    bias: float


def _present(texts: list[str | None], number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs, by text; features are numbered where `number` is given.

    An n-gram is feature `bucket`, and also `BUCKETS + bucket` in a text that has it `OFTEN` times.
    """
    words, index, counts = numbered(texts)
    owner, bucket = hashed(words, SIZES, BUCKETS)
    if number is not None:
        some = (number[bucket] >= 0) | (number[bucket + BUCKETS] >= 0)
        owner, bucket = owner[some], bucket[some]
    order = np.argsort(owner, kind="stable")
    bucket, size = bucket[order], np.bincount(owner, minlength=len(words))
    first = np.cumsum(size) - size
    used = size[index] > 0
    text = np.repeat(np.arange(len(texts)), counts)[used]
    pair, times = np.unique(text * np.int64(max(1, len(words))) + index[used], return_counts=True)
    text, word = pair // max(1, len(words)), pair % max(1, len(words))
    flat = np.repeat(text, size[word]) * np.int64(2 * BUCKETS) + bucket[ragged(first[word], size[word])]
    both, place = np.unique(flat, return_inverse=True)
    often = np.bincount(place, np.repeat(times, size[word]), len(both)) >= OFTEN
    both = np.sort(np.concatenate([both, both[often] + BUCKETS]))
    text, feature = both // (2 * BUCKETS), both % (2 * BUCKETS)
    if number is not None:
        some = number[feature] >= 0
        text, feature = text[some], number[feature[some]]
    return text, feature


def descend(row: np.ndarray, col: np.ndarray, features: int, positive: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.05, shrink: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk.

    `row`, `col`: which text has which feature; `positive`: which texts are
    confirmed. Both kinds of text must occur.
    """
    n, m = int(positive.sum()), int((~positive).sum())
    weight, bias = np.zeros(features), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, rounds + 1):
        g = bias + np.bincount(row, weight[col], n + m)
        s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        risk_u = np.logaddexp(0, g[~positive]).mean()
        risk_p = np.logaddexp(0, g[positive]).mean()
        up = np.where(positive, -prior * (1 - s) / n, 0.0)
        down = np.where(positive, -prior * s / n, s / m)
        slope = up + down if risk_u - prior * risk_p >= 0 else -down
        grad = np.append(np.bincount(col, slope[row], features) + shrink * weight / features, slope.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on at most `positives` confirmed and `unlabelled` other rows of `docs`.

    Rows are chosen by a hash of their id. The class prior is the share of
    confirmed rows among rows with a label. Executors count n-grams over the
    sample; the driver gets the kept features of each sampled text. Null texts
    count as empty. Without confirmed rows, without texts, or where no n-gram
    stands out, every text scores the prior.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    seen = marked.agg(F.count(F.lit(1)), F.sum((F.col(label_col) == 1).cast("long"))).first()
    prior = min(max((seen[1] or 0) / max(1, seen[0]), 1e-3), 0.999)
    ids = bounded(marked.where(F.col(label_col) == 1).select(id_col), [id_col], positives)
    p = docs.join(F.broadcast(ids.distinct()), id_col, "left_semi").select(text_col, F.lit(True).alias("positive")).limit(positives)
    u = bounded(docs.select(id_col, text_col), [id_col], unlabelled).select(text_col, F.lit(False).alias("positive"))
    sample = settle(p.unionByName(u).repartition(16), "toxic-sample")
    size = {r[0]: r[1] for r in sample.groupBy("positive").count().collect()}
    number = np.full(2 * BUCKETS, -1, np.int64)
    flat = Model(number, np.zeros(1), float(np.log(prior / (1 - prior))))
    n, m = size.get(True, 0), size.get(False, 0)
    if not n or not m:
        return flat

    def count(batches):
        for batch in batches:
            for a, b, texts, positive in _cut(batch):
                text, bucket = _present(texts)
                for flag in (True, False):
                    often = np.bincount(bucket[positive[text] == flag], minlength=2 * BUCKETS)
                    at = np.flatnonzero(often)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(often[at] * flag), pa.array(often[at] * (not flag))], names=["bucket", "p", "u"])

    share = (F.col("p") + F.col("u")) / (n + m)
    z = (F.col("p") / n - F.col("u") / m) / F.sqrt(share * (1 - share) * (1 / n + 1 / m))
    counted = sample.mapInArrow(count, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    best = counted.where((share < 1) & (F.col("p") >= max(LEAST, SUPPORT * n)) & (z >= STANDS_OUT)).select("bucket", z.alias("z")).orderBy(F.desc("z"), "bucket").limit(MOST_FEATURES)
    chosen = np.sort(np.array([r[0] for r in best.select("bucket").collect()], np.int64))
    if not len(chosen):
        return flat
    number[chosen] = np.arange(len(chosen))

    def keep(batches):
        for batch in batches:
            for a, b, texts, positive in _cut(batch):
                text, feature = _present(texts, number)
                held = np.split(feature, np.searchsorted(text, np.arange(1, len(texts))))
                yield pa.RecordBatch.from_arrays([pa.array(positive), pa.array([x.tolist() for x in held], pa.list_(pa.int64()))], names=["positive", "features"])

    got = sorted((not r[0], r[1]) for r in sample.mapInArrow(keep, "positive boolean, features array<long>").collect())
    held = [np.asarray(x, np.int64) for _, x in got]
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    weight, bias = descend(row, np.concatenate(held), len(chosen), np.array([not x for x, _ in got]), prior)
    return Model(number, weight, bias)


def _cut(batch: pa.RecordBatch):
    texts, positive = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
    for a, b in pieces([len(t) if t else 0 for t in texts]):
        yield a, b, texts[a:b], positive[a:b]


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability that a whole text is toxic.

    Empty and null texts have no features and get the score of the bias alone.
    A column named `score_col` is replaced; all others, repeated rows included,
    pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        m = sent.value
        text, feature = _present(texts, m.number)
        g = m.bias + np.bincount(text, m.weight[feature] if len(feature) else None, len(texts))
        return [1 / (1 + np.exp(-np.clip(g, -40, 40)))]

    return map_text(docs, text_col, T.StructType([T.StructField(score_col, T.DoubleType())]), work)
