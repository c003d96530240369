"""Quality scores from supervised subword embeddings.

Every word has a vector: the mean of the learned vectors of its hashed
character n-grams and of the word itself. A document is the mean of its words'
vectors, a softmax layer turns that into class probabilities, and both are
learned together by stochastic gradient descent. A word that repeats the one
before it is read as the token `REPEATED`, so that runs of one word have a
vector of their own.

Averaging and the output layer are linear, so scoring projects every n-gram
vector onto the output once and averages the projections; the result is the
same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm.common import bounded, map_text
from meterloom.llm.subword import hashed, numbered, per_text

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
WIDTH = 10
#: Bound of the training sample.
LABELLED = 2_500
REPEATED = "\x02same"


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # (BUCKETS, WIDTH)
    output: np.ndarray  # (WIDTH + 1, 2), the last row is the bias
    share: float  # of class 1, for texts without words


def _words(text: str) -> list[str]:
    words = text.lower().split()
    return [w if w != before else REPEATED for w, before in zip(words, [None, *words])]


def _features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, weight) of each text; the weights of a text add up to 1."""
    words, index, counts = numbered(texts, _words)
    owner, bucket = hashed(words, SIZES, BUCKETS)
    order = np.argsort(owner, kind="stable")
    bucket, size = bucket[order], np.bincount(owner, minlength=len(words))
    first = np.cumsum(size) - size
    out, at = [], 0
    for n in counts:
        own, often = np.unique(index[at : at + n], return_counts=True)
        at += n
        share = np.repeat(often / max(1, n) / size[own], size[own]) if n else np.zeros(0)
        where = np.concatenate([np.arange(first[w], first[w] + size[w]) for w in own]) if n else np.zeros(0, np.int64)
        buckets, place = np.unique(bucket[where], return_inverse=True)
        out.append((buckets, np.bincount(place, share, len(buckets))))
    return out


def fit(texts: list[str], labels: list[int], epochs: int = 5, rate: float = 1.0, seed: int = 7) -> Model:
    """Learn vectors and output by SGD over one text at a time, the rate falling to zero.

    One class only, or no rows, gives a constant score: the share of class 1,
    within 0.001 and 0.999 (0.5 when there is nothing to learn from).
    """
    y = np.asarray(labels, np.int64)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float64)
    output = np.zeros((WIDTH + 1, 2))
    if len(set(labels)) < 2:
        output[-1, 1] = np.log(share / (1 - share))
    else:
        made = [x for start in range(0, len(texts), 500) for x in _features(texts[start : start + 500])]
        steps, step = epochs * len(y), 0
        for _ in range(epochs):
            for i in rng.permutation(len(y)):
                now = rate * (1 - step / steps)
                step += 1
                bucket, weight = made[i]
                hidden = np.append(weight @ vectors[bucket], 1.0)
                logit = hidden @ output
                prob = np.exp(logit - logit.max())
                error = prob / prob.sum()
                error[y[i]] -= 1
                back = output[:-1] @ error
                output -= now * np.outer(hidden, error)
                # weights of long texts are tiny: the step is taken along the mean's direction
                if len(bucket):
                    vectors[bucket] -= now * np.outer(weight / weight.max(), back) * 0.1
    return Model(vectors, output, share)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", rows: int = LABELLED) -> Model:
    """Fit on at most `rows` labelled rows of `docs`, chosen by a hash of their id.

    Null labels are left out. An id with several labels counts with each of them.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).alias("__label"))
    sample = bounded(marked, [id_col], rows)
    got = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(text_col, "__label").limit(rows).collect()
    got.sort(key=lambda r: (r[0] or "", r[1]))
    return fit([r[0] or "" for r in got], [int(r[1]) for r in got])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability of class 1 of every whole text.

    Texts without words (null, empty, blanks) get the share of class 1 in
    training. A column named `score_col` is replaced; all others, repeated rows
    included, pass through.
    """
    side = model.output[:, 1] - model.output[:, 0]
    sent = docs.sparkSession.sparkContext.broadcast((model.vectors @ side[:-1], float(side[-1]), model.share))

    def work(texts):
        projected, bias, share = sent.value
        words, index, counts = numbered(texts, _words)
        owner, bucket = hashed(words, SIZES, BUCKETS)
        word = np.bincount(owner, projected[bucket], len(words)) / np.maximum(1, np.bincount(owner, minlength=len(words)))
        g = per_text(word[index] if len(words) else np.zeros(0), counts) / np.maximum(1, counts) + bias
        return [np.where(counts > 0, 1 / (1 + np.exp(-np.clip(g, -40, 40))), share)]

    return map_text(docs, text_col, T.StructType([T.StructField(score_col, T.DoubleType())]), work)
