"""Runs: stretches of words that repeat with a period, found from maximal pairs.

Two places of a text that go on alike for `l` words, and neither one word
further nor one word earlier, are a maximal pair. A pair at distance `d` makes
the stretch of `d + l` words with period `d`, and no word beside the stretch
keeps that period. So the pairs whose distance and length satisfy

    d + l >= max(min_length, exponent * d)

are the runs, one for every multiple of a run's least period, and nothing has to
be extended; of the same stretch the least period stays.

Pairs come from the tree of LCP intervals, built bottom-up over the sorted
suffixes. An interval of depth `l` holds the places of a repeated sequence of
`l` words in order, each with its left word as class; when a child joins, places
of different classes at most `l // (exponent - 1)` apart are pairs. Places that
close together of a sequence that long are equally spaced, so all but the first
have the same left word: the first one in reach settles a place, and an interval
costs a search per place of its smaller child. The number of pairs that satisfy
the condition grows with the number of words, not with its square.

A pair that satisfies it shares at least `shared_words` words, so only places
whose sequence of about that many words occurs again in the text take part; they
are found by hashes for all texts of a piece at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm.common import map_text

MIN_LENGTH = 24
EXPONENT = 3

_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def shared_words(min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> int:
    """Words that both places of a fitting pair share at least."""
    period = min_length // exponent
    return min(min_length - period, (exponent - 1) * (period + 1)) if period else exponent - 1


def _repeated(codes: np.ndarray, doc: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Places whose next `width` (a power of two) words probably occur again in the same text; none that does is left out."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < width:
        h = h ^ (h >> np.uint64(31))
        h[:-step] = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
        step *= 2
    place = np.flatnonzero(np.arange(len(codes)) + width <= end)
    h = (h[place] ^ (h[place] >> np.uint64(29))) + doc[place].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(h)
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    return np.unique(place[order[np.concatenate([same, same + 1])]])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any key; the first does."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _suffixes(codes: np.ndarray, end: np.ndarray, doc: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The marked places in the order of the words that follow, text by text (prefix doubling)."""
    n = len(codes)
    order = np.lexsort((codes, doc))
    fresh = _starts(codes[order], doc[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step, open_ = 1, np.arange(n)
    while len(open_):
        after = np.where(open_ + step < end[open_], rank[np.minimum(open_ + step, n - 1)], -1)
        order = np.lexsort((after, rank[open_]))
        open_, after = open_[order], after[order]
        group = rank[open_]
        at = np.arange(len(open_))
        first = np.maximum.accumulate(np.where(_starts(group), at, 0))
        fresh = _starts(group, after)
        rank[open_] = group + np.maximum.accumulate(np.where(fresh, at, 0)) - first
        alone = fresh & np.append(fresh[1:], True)
        open_ = open_[~alone]
        step *= 2
    return marked[np.argsort(rank[marked])]


def _common(words: list, order: list, doc: np.ndarray, end: np.ndarray, least: int) -> list:
    """For each place in `order` how many words it shares with the one before; 0 across texts."""
    before = dict(zip(order[1:], order))
    length: dict = {}
    last, h = -2, 0
    for i in sorted(order):
        j = before.get(i)
        # A shared sequence that is still `least` long after its first word is marked there too.
        h = h - 1 if i == last + 1 and h > least else 0
        last = i
        if j is None or doc[i] != doc[j]:
            length[i], h = 0, 0
            continue
        top = int(end[i]) - max(i, j)
        while h < top and words[i + h] == words[j + h]:
            h += 1
        length[i] = h
    return [length[i] for i in order]


def fitting_pairs(order: list, common: list, left: list, least: int, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list:
    """(place, distance, shared words) of the maximal pairs that fit, by the tree of LCP intervals."""
    found: list = []

    def joined(one: list, other: list, depth: int) -> list:
        """Pairs of places in both (sorted) children of an interval; all places of both."""
        many, few = (one, other) if len(one) >= len(other) else (other, one)
        reach = depth // (exponent - 1)
        for x in few:
            at = bisect_left(many, x - reach)
            if at == len(many):
                continue
            y = many[at]
            if y > x + reach or left[y] == left[x]:
                continue
            if y < x:
                found.append((y, x - y, depth))
            else:
                found.extend((x, z - x, depth) for z in many[at : bisect_right(many, x + reach)])
        if len(few) > 32:
            many += few
            many.sort()
        else:
            for x in few:
                insort(many, x)
        return many

    stack: list = []  # (depth, places) of the intervals that are still open
    for k in range(len(order)):
        child = [order[k]]
        depth = common[k + 1] if k + 1 < len(order) else 0
        while stack and stack[-1][0] > depth:
            below, places = stack.pop()
            child = joined(places, child, below)
        if depth < least:
            continue
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, joined(stack[-1][1], child, depth))
        else:
            stack.append((depth, child))
    return [p for p in found if p[1] + p[2] >= min_length]


def runs_of(texts: list[list], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every sequence of words, by start, then period."""
    least = shared_words(min_length, exponent)
    out: list = [[] for _ in texts]
    flat = [w for words in texts for w in words]
    if not flat:
        return out
    number = dict.fromkeys(flat)
    number = dict(zip(number, range(len(number))))
    codes = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
    del flat, number
    sizes = np.array([len(words) for words in texts])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    marked = _repeated(codes, doc, end, 1 << (least.bit_length() - 1))
    if not len(marked):
        return out
    # Only texts with marked places go on.
    some = np.isin(doc, doc[marked])
    moved = np.cumsum(some) - 1
    codes, doc, end, marked = codes[some], doc[some], moved[end[some] - 1] + 1, moved[marked]
    begin = np.concatenate([[0], end[:-1]])
    begin = np.maximum.accumulate(np.where(_starts(doc), begin, 0))
    order = _suffixes(codes, end, doc, marked).tolist()
    words = codes.tolist()
    left = {p: (words[p - 1] if p > begin[p] else -1) for p in order}
    best: dict = {}
    for place, period, common in fitting_pairs(order, _common(words, order, doc, end, least), left, least, min_length, exponent):
        key = (place, period + common)
        best[key] = min(period, best.get(key, period))
    for (place, length), period in best.items():
        out[doc[place]].append((int(place - begin[place]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list, found: list) -> list:
    """Words without those that a run repeats: all of a run after its first period goes."""
    if not found:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(kept).tolist()]


def find(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Add `runs` (array of start, length, period in words, by start, then period) and `collapsed` of every whole text.

    Words are what stands between ASCII blanks. A run is a stretch of words
    with least period q and at least max(min_length, exponent * q) words that no
    neighbouring word extends; `exponent` is 3 or more. `collapsed` has the
    words that no run contains after its first q words, joined by one space.
    Null and empty texts have no run and collapse to an empty text. Rows are
    worked on one by one, repeated rows too; columns named `runs` or
    `collapsed` are replaced, all others pass through.
    """
    if exponent < 3 or min_length < exponent:
        raise ValueError("a run has to hold its period three times at least")
    outputs = T.StructType([T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])

    def work(texts):
        words = [t.encode().split() if t else [] for t in texts]
        found = runs_of(words, min_length, exponent)
        lists = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
        return [lists, pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, found)], pa.binary()).cast(pa.string())]

    return map_text(docs, text_col, outputs, work)


def greatest(runs: str = "runs") -> Column:
    """The run with the greatest length / period (exact), of equal ones the first; null without runs."""
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast(_RUN), lambda a, x: F.when(better(a, x), x).otherwise(a))
