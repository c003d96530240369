"""Languages of whole texts and of spans inside mixed texts.

A word's script narrows the languages it may be in; each of those gives the
word a score, the log-probability of its character n-grams. A Viterbi pass over
the words of a text then finds the labelling with the best total score, where
every change of language costs a fixed penalty. Runs of one label are spans.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm.common import bounded, fold, map_text
from meterloom.llm.subword import hashed

BUCKETS = 1 << 14
SIZES = (2, 3, 4)
#: Bound of the training sample.
LABELLED = 3_000
#: Cost of a change of language, in nats.
SWITCH = 12.0
#: A language uses a script that has this share of its letters at least.
USES = 0.01
UNKNOWN = "und"

# First and last code points of Unicode blocks, by script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x323AF)],
}
_OTHER = len(SCRIPTS) + 1

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
OUTPUTS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages): log-probability of an n-gram
    allowed: np.ndarray  # (scripts + 2, languages)


@lru_cache(maxsize=1)
def _scripts() -> np.ndarray:
    """Script number of every code point; 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if unicodedata.category(chr(i))[0] == "L":
            out[i] = _OTHER
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            out[a : b + 1][out[a : b + 1] > 0] = k
    return out


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower case of every code point where that is one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(_scripts()):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def _split(texts: list[str | None]):
    """Words (runs of letters) of all texts: distinct words, their scripts, and
    for each occurrence its number, text, start and end in the text."""
    joined = "\n".join(t or "" for t in texts)
    points = _lower()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    script = _scripts()[points]
    letter = np.concatenate([[False], script > 0, [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, end = edge[::2], edge[1::2]
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    text = np.searchsorted(begins, start, "right") - 1
    lowered = points.tobytes().decode("utf-32-le", "surrogatepass")
    words = [lowered[a:b] for a, b in zip(start.tolist(), end.tolist())]
    number = dict.fromkeys(words)
    number = dict(zip(number, range(len(number))))
    index = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    scripts = np.zeros(len(number), np.uint8)
    scripts[index] = script[start]
    return list(number), scripts, index, text, start - begins[text], end - begins[text]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = LABELLED) -> Model:
    """Count n-grams and scripts per language over at most `rows` labelled rows of `docs`.

    Rows with a null text or language teach nothing. Counting is done by the
    executors; what comes back is a number per language and bucket.
    """
    some = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    sample = bounded(some, [id_col], rows).select(text_col, lang_col).repartition(8)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            words, scripts, index, text, start, end = _split(batch.column(0).to_pylist())
            lang = np.asarray([names.index(x) for x in langs])[text] if len(text) else np.zeros(0, np.int64)
            owner, bucket = hashed(words, SIZES, BUCKETS, whole=False)
            for k, name in enumerate(names):
                often = np.bincount(index[lang == k], minlength=len(words))
                grams = np.bincount(bucket, often[owner], BUCKETS)
                used = np.bincount(scripts[index[lang == k]], (end - start)[lang == k], _OTHER + 1)
                values = np.concatenate([grams, used]).astype(np.int64)
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(values[at])], names=["lang", "at", "n"])

    counted = sample.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    rows_ = counted.collect()
    langs = sorted({r["lang"] for r in rows_})
    number = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((BUCKETS + _OTHER + 1, len(langs)))
    for r in rows_:
        counts[r["at"], number[r["lang"]]] = r["n"]
    grams, used = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    return Model(langs, np.log(grams / grams.sum(0)), used >= USES * np.maximum(1, used.sum(0)))


def _best(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word. All texts advance together, longest first."""
    total, langs = scores.shape
    if langs == 1 or not total:
        return np.zeros(total, np.int64)
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    counts, begin = counts[order], begin[order]
    alive = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), "right")
    came = np.zeros((total, langs), np.int8 if langs < 128 else np.int32)
    state = np.zeros((len(counts), langs))
    same = np.arange(langs)
    for t, n in enumerate(alive):
        here = begin[:n] + t
        if t:
            top = state[:n].argmax(1)
            reach = state[np.arange(n), top] - switch
            stay = state[:n] >= reach[:, None]
            came[here] = np.where(stay, same, top[:, None])
            state[:n] = np.where(stay, state[:n], reach[:, None])
        state[:n] += scores[here]
    label = np.zeros(total, np.int64)
    now = state.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        here = begin[:n] + t
        label[here] = now[:n]
        now[:n] = came[here, now[:n]]
    return label


def label(texts: list[str | None], model: Model, switch: float = SWITCH, spans: bool = True) -> list:
    """Language, share of letters in it, and spans of each text."""
    words, scripts, index, text, start, end = _split(texts)
    langs = len(model.langs)
    counts = np.bincount(text, minlength=len(texts))
    if not langs or not len(words):
        none = [UNKNOWN] * len(texts)
        return [none, [0.0] * len(texts), [[] for _ in texts]]
    owner, bucket = hashed(words, SIZES, BUCKETS, whole=False)
    score = np.stack([np.bincount(owner, model.table[bucket, k], len(words)) for k in range(langs)], 1)
    may = model.allowed[scripts]
    may[~may.any(1)] = True
    score[~may] = -1e9
    best = _best(score[index], counts, switch)
    letters = np.bincount(text * langs + best, end - start, len(texts) * langs).reshape(len(texts), langs)
    top = letters.argmax(1)
    whole = letters.sum(1)
    share = letters[np.arange(len(texts)), top] / np.maximum(1, whole)
    names = [model.langs[k] if n else UNKNOWN for k, n in zip(top, whole)]
    made = [[] for _ in texts]
    if spans:
        turn = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (best[1:] != best[:-1])]))
        last = np.append(turn[1:] - 1, len(text) - 1)
        for i, a, b, k in zip(text[turn].tolist(), start[turn].tolist(), end[last].tolist(), best[turn].tolist()):
            made[i].append({"start": a, "end": b, "lang": model.langs[k]})
    return [names, share, made]


def identify(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """Add `lang_pred`, `score` (share of letters in it) and `spans` (character offsets, end exclusive).

    Null texts, texts without letters, and any text when the model knows no
    language get `und`, score 0 and no spans. Ties between languages go to the
    first name. Columns of these names are replaced, others pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, text_col, OUTPUTS, lambda texts: label(texts, sent.value, switch))


def held_out(id_col: str = "doc_id"):
    """Rows never learned from."""
    return fold(id_col, 4) == 2
