"""Benchmark items found in training texts: BM25 retrieval with block-max pruning, then overlap checks.

Test items are indexed as BM25 documents; every training passage is a query. An
item is retrieved when its score reaches the item's threshold, which is set so
that no passage can hold the asked share of the item's word shingles and score
less. Postings are kept in blocks of items with the largest weight per block, and
a block is only scored where those maxima could reach the threshold. What is
retrieved is verified by counting the shingles of the question, and of the answer
if there is one, that the passage holds.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm.common import arrow_type, map_text, pieces, ragged

WORDS = 5
SHARE = 0.8
K1, B = 1.2, 0.75
#: Items per block of the index.
BLOCK = 16
#: Words from one passage's start to the next; a passage is twice as long. Items of more than half as many words have longer ones.
STRIDE = 128
#: Items indexed at once; more are searched in further passes, so what is sent to the tasks stays bounded.
ITEMS = 20_000
#: Postings of a piece of passages expanded at once.
POSTINGS = 4_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and numbers."""
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list, size: int = WORDS) -> set:
    """Distinct runs of `size` words; a shorter text is one run."""
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


@dataclass(frozen=True)
class Index:
    ids: list[int]
    term: dict[str, int]
    question: list[set]  # shingles as tuples of term numbers
    answer: list[set]
    words: np.ndarray  # of question and answer together
    need: np.ndarray  # score from which an item is retrieved
    first: np.ndarray  # postings of a term: items and weights
    items: np.ndarray
    weight: np.ndarray
    block_first: np.ndarray  # and per block: the largest weight
    blocks: np.ndarray
    block_max: np.ndarray
    block_need: np.ndarray


def build(rows: list[tuple], share: float = SHARE) -> Index:
    """Index (id, question, answer) rows. Items without words can't be found and are left out."""
    rows = [(i, words_of(q), words_of(a)) for i, q, a in rows]
    rows = [(i, q, a) for i, q, a in rows if q or a]
    term: dict[str, int] = {}
    coded = [([term.setdefault(w, len(term)) for w in q], [term.setdefault(w, len(term)) for w in a]) for _, q, a in rows]
    counts = [np.unique(np.array(q + a), return_counts=True) for q, a in coded]
    df = np.bincount(np.concatenate([c[0] for c in counts]) if counts else [], minlength=len(term))
    idf = np.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(q) + len(a) for q, a in coded]) if coded else 1.0
    question, answer = [shingles(q) for q, _ in coded], [shingles(a) for _, a in coded]
    need, t_all, i_all, w_all = [], [], [], []
    for i, ((q, a), (t, n)) in enumerate(zip(coded, counts)):
        weight = idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * (len(q) + len(a)) / mean))
        # Leaving out r shingles leaves out r words at most; these may be the heaviest.
        lost = sum(len(s) - math.ceil(share * len(s) - 1e-9) for s in (question[i], answer[i]))
        need.append(max(0.0, weight.sum() - np.sort(weight)[::-1][:lost].sum()) * (1 - 1e-9))
        t_all.append(t)
        i_all.append(np.full(len(t), i))
        w_all.append(weight)
    t_all, i_all, w_all = (np.concatenate(x) if x else np.zeros(0) for x in (t_all, i_all, w_all))
    order = np.lexsort((i_all, t_all))
    t_all, i_all, w_all = t_all[order].astype(np.int64), i_all[order].astype(np.int64), w_all[order]
    first = np.searchsorted(t_all, np.arange(len(term) + 1))
    pair = t_all * (len(rows) // BLOCK + 1) + i_all // BLOCK
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    block_max = np.maximum.reduceat(w_all, start) if len(start) else np.zeros(0)
    need = np.array(need)
    block_need = np.minimum.reduceat(need, np.arange(0, len(need), BLOCK)) if len(need) else np.zeros(0)
    return Index([r[0] for r in rows], term, question, answer, np.array([len(q) + len(a) for q, a in coded], np.int64), need, first, i_all, w_all, np.searchsorted(t_all[start], np.arange(len(term) + 1)), (i_all // BLOCK)[start], block_max, block_need)


def _expand(first: np.ndarray, owner: np.ndarray, terms: np.ndarray):
    n = first[terms + 1] - first[terms]
    return np.repeat(owner, n), ragged(first[terms], n)


def _retrieve(query: np.ndarray, terms: np.ndarray, index: Index) -> tuple[list, list, list]:
    """(passage, item, score) of all items that reach their threshold; `query` is in order."""
    number, row = np.unique(query, return_inverse=True)
    blocks = len(index.block_need)
    r, p = _expand(index.block_first, row, terms)
    bound = np.bincount(r * blocks + index.blocks[p], index.block_max[p], len(number) * blocks).reshape(-1, blocks)
    open_ = bound >= index.block_need - 1e-12
    some = open_.any(1)[row]
    r, p = _expand(index.first, row[some], terms[some])
    item = index.items[p]
    live = open_[r, item // BLOCK]
    key, spot = np.unique(r[live] * np.int64(len(index.ids)) + item[live], return_inverse=True)
    score = np.bincount(spot, index.weight[p][live], len(key))
    r, item = key // len(index.ids), key % len(index.ids)
    hit = score >= index.need[item] - 1e-12
    return number[r[hit]].tolist(), item[hit].tolist(), score[hit].tolist()


def strides(index: Index) -> np.ndarray:
    """Stride of every item: `STRIDE`, doubled until it is at least twice the item's words.

    So a copy that spreads over up to twice its own length lies in one passage as
    a whole, wherever it begins. It depends on the item alone, not on the others.
    """
    over = np.maximum(2 * index.words, STRIDE) / STRIDE
    return STRIDE * (1 << np.ceil(np.log2(over)).astype(np.int64))


def search(texts: list[str | None], index: Index, share: float = SHARE, stride: int | None = None) -> list[tuple]:
    """(text number, passage, item number, score, question overlap, answer overlap) of every verified hit.

    A passage holds the shingles that begin in `2 * stride` words; passages
    begin every `stride` words, and each item has the stride of its length
    unless one is given. A text of fewer words than a shingle is one shingle as
    a whole.
    """
    if not index.ids:
        return []
    per_text = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
    get = index.term.get
    coded = np.fromiter((get(w, -1) for ws in per_text for w in ws), np.int64, int(counts.sum()))
    own = strides(index) if stride is None else np.full(len(index.ids), stride)
    return [hit for s in np.unique(own).tolist() for hit in _passages(coded, counts, index, share, s, own == s)]


def _passages(coded: np.ndarray, counts: np.ndarray, index: Index, share: float, stride: int, wanted: np.ndarray) -> list[tuple]:
    """The hits of the `wanted` items in passages of one stride."""
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(coded)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.flatnonzero(coded >= 0)
    # A word lies in the passages that begin with its own stretch and with the one before. The last
    # words of a passage's last shingle reach into the next stretch, so they count there too.
    stretch = place[at] // stride
    back = (place[at] % stride < WORDS - 1).astype(np.int64) + 1
    n = np.minimum(stretch, back) + 1
    owner = np.repeat(np.arange(len(at)), n)
    passage = stretch[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    most = int(counts.max(initial=0)) // stride + 1
    wide = len(index.term)
    pair = np.unique((text[at][owner] * most + passage) * np.int64(wide) + coded[at][owner])
    query, terms = pair // wide, pair % wide
    found = []
    cost = np.cumsum(index.first[terms + 1] - index.first[terms])
    start = 0
    while start < len(query):
        # Whole passages, as many as have at most POSTINGS postings together, or one.
        stop = int(np.searchsorted(cost, (cost[start - 1] if start else 0) + POSTINGS, "right"))
        stop = max(int(np.searchsorted(query, query[min(stop, len(query) - 1)])) if stop < len(query) else len(query), int(np.searchsorted(query, query[start], "right")))
        found.append(_retrieve(query[start:stop], terms[start:stop], index))
        start = stop
    out = []
    begin = np.cumsum(counts) - counts
    for r, i, s in (x for part in found for x in zip(*part)):
        if not wanted[i]:
            continue
        t, part = divmod(int(r), most)
        a = int(begin[t]) + part * stride
        run = coded[a : min(a + 2 * stride + WORDS - 1, int(begin[t] + counts[t]))].tolist()
        there = shingles(run) if len(run) >= WORDS or counts[t] < WORDS else set()
        over = [len(w & there) / len(w) if w else None for w in (index.question[i], index.answer[i])]
        if all(o is None or o >= share - 1e-9 for o in over):
            out.append((t, part, i, s, *over))
    return out


def _indexes(items: DataFrame, question_col: str, answer_col: str | None, item_col: str, share: float):
    """Broadcast indexes of at most about `ITEMS` items each, that hold all items together."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    listed = items.select(F.col(item_col).alias("item_id"), F.col(question_col).alias("question"), answer.alias("answer")).distinct()
    passes = max(1, math.ceil(listed.count() / ITEMS))
    for part in range(passes):
        rows = listed.where(F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(passes)) == part).orderBy("item_id", "question", "answer").collect()
        yield items.sparkSession.sparkContext.broadcast(build([tuple(r) for r in rows], share))


def contaminated(docs: DataFrame, items: DataFrame, question_col: str = "text", answer_col: str | None = None, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", share: float = SHARE, stride: int | None = None) -> DataFrame:
    """`doc_id`, `item_id`, `overlap`, `passages`: items whose question (and answer, where given) a text holds.

    `overlap` is the largest share of the item's distinct shingles in one
    passage, at least `share`; `passages` counts the passages that hold it.
    Words are compared without case and punctuation. Null and empty texts hold
    nothing, items without words are found nowhere. Repeated rows of one id
    count as one text; rows with a null id are reported under null.
    """
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    item_type = arrow_type(items.schema[item_col].dataType)
    found = None
    for sent in _indexes(items, question_col, answer_col, item_col, share):

        def work(batches, sent=sent):
            index = sent.value
            for batch in batches:
                ids, texts = (batch.column(k).to_pylist() for k in (0, 1))
                for a, b in pieces([len(t) if t else 0 for t in texts]):
                    hits = search(texts[a:b], index, share, stride)
                    overlap = [min(x for x in h[4:] if x is not None) for h in hits]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[a + h[0]] for h in hits], batch.schema.field(0).type), "item_id": pa.array([index.ids[h[2]] for h in hits], item_type), "passage": pa.array([h[1] for h in hits], pa.int64()), "overlap": pa.array(overlap, pa.float64())})

        made = docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(work, f"doc_id {kind}, item_id {item_kind}, passage long, overlap double")
        found = made if found is None else found.unionByName(made)
    return found.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"), F.countDistinct("passage").alias("passages"))


def clean(docs: DataFrame, items: DataFrame, question_col: str = "text", answer_col: str | None = None, text_col: str = "text", item_col: str = "item_id", share: float = SHARE, stride: int | None = None) -> DataFrame:
    """`docs` without the rows whose text holds an item; all columns are kept, each row is judged by its own text."""
    for sent in _indexes(items, question_col, answer_col, item_col, share):

        def work(texts, sent=sent):
            held = {h[0] for h in search(texts, sent.value, share, stride)}
            return [[i in held for i in range(len(texts))]]

        docs = map_text(docs, text_col, T.StructType([T.StructField("__held", T.BooleanType())]), work).where("not __held").select(*docs.columns)
    return docs
