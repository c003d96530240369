"""Byte-level BPE encoding and decoding.

Words that are frequent in the corpus are compiled into a minimal acyclic
transducer: states with the same continuations are shared, and every transition
carries a number so that the numbers along a word's path add up to its place in
a table of token ids. The arrays are one file, sent to the executors with
`addFile` and memory-mapped there, so the workers of a machine share one copy.
Words the automaton does not accept are merged exactly, pair by pair. Both
routes give the same ids; the lexicon only decides how fast.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm.common import map_text, pieces, ragged, sizes
from meterloom.session import discard, settle_mapped

#: Bound of the lexicon: the most frequent words of the corpus.
LEXICON = 60_000
#: Longest word of the lexicon, in bytes; longer ones are merged.
LONGEST = 48
#: Distinct words a task counts before it hands them on.
FLUSH = 150_000
#: Signs (or bytes of ids) encoded or decoded at once: the two run in workers of their own beside each other.
PIECE = 250_000

LETTER, NUMBER, SPACE, OTHER, BREAK = 1, 2, 3, 4, 5
# The white space of Unicode, and the word endings that are split off after an apostrophe.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    out[WHITE] = SPACE
    return out


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary file, ready for lookups by id."""

    byte_id: np.ndarray  # byte -> id
    pair: np.ndarray  # sorted left * size + right
    rank: np.ndarray
    merged: np.ndarray
    text: np.ndarray  # bytes of all ids, one after another
    start: np.ndarray  # start of each id's bytes, and the end
    special: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.start) - 1


def vocabulary(content: str) -> Vocabulary:
    """Read the JSON of a byte-level BPE tokenizer."""
    doc = json.loads(content)
    vocab = doc["model"]["vocab"]
    # A printable character stands for each byte: itself, or one from U+0100 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = [b for b in range(256) if b not in set(plain)]
    of_char = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(spare)}
    special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
    size = max([*vocab.values(), *special.values()]) + 1
    raw = [b""] * size
    for token, i in vocab.items():
        raw[i] = bytes(map(of_char.__getitem__, token))
    for token, i in special.items():
        raw[i] = token.encode()
    byte_id = np.zeros(256, np.int64)
    for char, b in of_char.items():
        byte_id[b] = vocab[char]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in doc["model"]["merges"]]
    key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(key, kind="stable")
    start = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return Vocabulary(byte_id, key[order], order.astype(np.int64), merged[order], np.frombuffer(b"".join(raw), np.uint8), start, special)


def split_words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts as the byte-level splitting rule cuts them, and the number of words of each text.

    Runs of letters, of numbers and of other signs are words, with one blank
    before them if there is one; white space that nothing takes is a word up to
    the last sign before a word; an apostrophe right after a word takes its
    usual ending.
    """
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    breaks = np.concatenate([[0], np.cumsum(lengths + 1)])
    kind = _classes()[points]
    kind[breaks] = BREAK
    begin = np.empty(len(kind), bool)
    begin[0] = True
    begin[1:] = kind[1:] != kind[:-1]
    begin[breaks] = True
    begin[breaks[breaks + 1 < len(kind)] + 1] = True
    at = np.flatnonzero(begin)
    # The last sign of a run of white space before a word is a word of its own, or a blank that joins the next word.
    space = np.flatnonzero(kind[at] == SPACE)
    ends = np.append(at[1:], len(kind))[space]
    before_word = kind[np.minimum(ends, len(kind) - 1)] != BREAK
    last = ends[before_word] - 1
    begin[last] = True
    blank = last[points[last] == 0x20]
    begin[blank + 1] = False
    # An apostrophe alone between the word before and letters.
    mark = np.flatnonzero((points == 0x27) & begin)
    mark = mark[(kind[mark + 1] == LETTER) & begin[mark + 1]]
    if len(mark):
        for i in mark.tolist():
            for ending in ENDINGS:
                n = len(ending)
                if joined[i + 1 : i + 1 + n] == ending and (kind[i + 1 : i + 1 + n] == LETTER).all():
                    begin[i + 1] = False
                    if kind[i + 1 + n] != BREAK:
                        begin[i + 1 + n] = True
                    break
    at = np.flatnonzero(begin)
    wide = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    byte_at = np.concatenate([[0], np.cumsum(wide)])
    end = np.append(at[1:], len(kind))
    word = kind[at] != BREAK
    at, end = at[word], end[word]
    raw = joined.encode()
    words = [raw[a:b] for a, b in zip(byte_at[at].tolist(), byte_at[end].tolist())]
    counts = np.diff(np.searchsorted(at, breaks))
    return words, counts


def merge(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of one word: the pair of lowest rank is merged, leftmost first, until none is left."""
    ids = v.byte_id[np.frombuffer(word, np.uint8)].tolist()
    after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]

    def offer(i: int):
        j = after[i]
        if j >= 0:
            key = ids[i] * v.size + ids[j]
            k = int(np.searchsorted(v.pair, key))
            if k < len(v.pair) and v.pair[k] == key:
                heapq.heappush(heap, (int(v.rank[k]), i, key, int(v.merged[k])))

    heap: list = []
    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        _, i, key, new = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j < 0 or ids[i] * v.size + ids[j] != key:
            continue
        ids[i], ids[j] = new, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [i for i in ids if i >= 0]


def merge_all(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of many words, where each word's begin and how many it has; short words are merged side by side."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin, length, out, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int64)], 0
    for low, high in ((1, 8), (9, 16), (17, 32), (33, 64)):
        rows = np.flatnonzero((size >= low) & (size <= high))
        for k in range(0, len(rows), 50_000):
            part = rows[k : k + 50_000]
            ids = _side_by_side([words[i] for i in part.tolist()], high, v)
            length[part] = (ids >= 0).sum(1)
            begin[part] = at + np.cumsum(length[part]) - length[part]
            out.append(ids[ids >= 0])
            at += len(out[-1])
    for i in np.flatnonzero(size > 64).tolist():
        out.append(np.array(merge(words[i], v), np.int64))
        begin[i], length[i] = at, len(out[-1])
        at += len(out[-1])
    return np.concatenate(out), begin, length


def _side_by_side(words: list[bytes], width: int, v: Vocabulary) -> np.ndarray:
    """One merge per word and round: the pair of lowest rank, leftmost first. Rows are padded with -1."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.full((len(words), width), -1, np.int64)
    ids[np.arange(width) < size[:, None]] = v.byte_id[flat]
    none = np.int64(1) << 40

    def ranks(left, right):
        key = left * v.size + right
        k = np.minimum(np.searchsorted(v.pair, key), len(v.pair) - 1)
        hit = (v.pair[k] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, v.rank[k], none), v.merged[k]

    if width < 2 or not len(v.pair):
        return ids
    rank, new = ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel())
    rank, new = rank.reshape(len(words), -1), new.reshape(len(words), -1)
    done = np.full((len(words), width), -1, np.int64)
    place = np.arange(len(words))
    while True:
        best = rank.argmin(1)
        line = np.arange(len(ids))
        more = rank[line, best] < none
        done[place[~more]] = ids[~more]
        if not more.any():
            return done
        place, ids, rank, new, best = place[more], ids[more], rank[more], new[more], best[more]
        line = np.arange(len(ids))
        ids[line, best] = new[line, best]
        # close the gap right of the merged pair
        column = np.arange(width - 1)
        shift = column[None, :] > best[:, None]
        ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
        ids[:, -1] = -1
        if width > 2:
            gap = column[None, :-1] > best[:, None]
            rank[:, :-1] = np.where(gap, rank[:, 1:], rank[:, :-1])
            new[:, :-1] = np.where(gap, new[:, 1:], new[:, :-1])
        rank[:, -1] = none
        for at in (best, best - 1):
            ok = (at >= 0) & (at < width - 1)
            r, m = ranks(ids[line[ok], at[ok]], ids[line[ok], at[ok] + 1])
            rank[line[ok], at[ok]], new[line[ok], at[ok]] = r, m


def compile_lexicon(words: list[bytes], v: Vocabulary) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of the words, as arrays.

    Words are added in order; once a branch can't grow any more, its states are
    replaced by equal ones that exist. A state's transitions are keyed by
    state * 256 + byte in one sorted array; `skip` adds up to the number of
    words before the one that is spelled.
    """
    words = sorted(set(w for w in words if w))
    register: dict[tuple, int] = {}
    path: list[list] = [[False, []]]  # states of the last word: final, transitions
    states: list[tuple] = []

    def close(down_to: int):
        while len(path) > down_to:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            if path:
                last = path[-1][1]
                last[-1] = (last[-1][0], register[key])

    previous = b""
    for w in words:
        same = len(os.path.commonprefix([previous, w]))
        close(same + 1)
        for b in w[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        previous = w
    close(0)
    number = [0] * len(states)  # words accepted from each state; children come first
    key, target, skip = [], [], []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for b, t in edges:
            key.append(s * 256 + b)
            target.append(t)
            skip.append(n)
            n += number[t]
        number[s] = n
    ids, begin, lengths = merge_all(words, v)
    ids = ids[ragged(begin, lengths)]
    return {
        "key": np.array(key, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64), "final": np.array([f for f, _ in states], np.int64),
        "start": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), "ids": ids.astype(np.int64), "root": np.array([len(states) - 1], np.int64),
    }


_PARTS = ("key", "target", "skip", "final", "start", "ids", "root")


def write_lexicon(lexicon: dict[str, np.ndarray], folder: str) -> str:
    """One file: the sizes of the arrays, then the arrays."""
    body = b"".join([np.array([len(lexicon[p]) for p in _PARTS], np.int64).tobytes(), *(lexicon[p].tobytes() for p in _PARTS)])
    path = os.path.join(folder, f"lexicon-{uuid.uuid4().hex}.bin")  # a session takes each name once
    with open(path, "wb") as f:
        f.write(body)
    return path


@lru_cache(maxsize=2)
def map_lexicon(path: str) -> dict[str, np.ndarray]:
    whole = np.memmap(path, np.int64, "r")
    out, at = {}, len(_PARTS)
    for part, n in zip(_PARTS, whole[: len(_PARTS)].tolist()):
        out[part] = whole[at : at + n]
        at += n
    return out


def look_up(words: list[bytes], lexicon: dict[str, np.ndarray]) -> np.ndarray:
    """Place of each word in the lexicon, -1 where the automaton does not accept it."""
    place = np.full(len(words), -1, np.int64)
    if not len(lexicon["key"]):
        return place
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    row = np.flatnonzero((size > 0) & (size <= LONGEST))
    state, total = np.full(len(row), lexicon["root"][0]), np.zeros(len(row), np.int64)
    key, target, skip, final = (lexicon[k] for k in ("key", "target", "skip", "final"))
    step = 0
    while len(row):
        k = state * 256 + flat[begin[row] + step]
        at = np.minimum(np.searchsorted(key, k), len(key) - 1)
        on = key[at] == k
        row, at = row[on], at[on]
        state, total = target[at], total[on] + skip[at]
        step += 1
        ended = size[row] == step
        good = ended & (final[state] == 1)
        place[row[good]] = total[good]
        row, state, total = row[~ended], state[~ended], total[~ended]
    return place


def frequent_words(docs: DataFrame, text_col: str, special: list[str], words: int) -> list[bytes]:
    """The most frequent words over all texts, at most `words`; which of equally frequent ones is left to a hash.

    Counts are written once; a histogram of their logarithms says from which
    count on words fit, and only those come back.
    """

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for a, b in pieces(sizes(batch.column(0))):
                texts = [t or "" for t in batch.column(0).slice(a, b - a).to_pylist()]
                segments, _, _ = _segments(texts, special)
                seen.update(split_words(segments)[0])
                if len(seen) > FLUSH:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    counted = docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    height = F.floor(F.log2("n") * 8)
    counted = settle_mapped(counted.where((F.length("word") <= LONGEST) & (F.col("n") > 1)).withColumn("height", height), "word-counts")
    room, cut, share = words, 0, 0.0
    for row in sorted(counted.groupBy("height").count().collect(), reverse=True):
        cut, share = row["height"], min(1.0, room / row["count"])
        if share < 1:
            break
        room -= row["count"]
    spread = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    top = counted.where((F.col("height") > cut) | ((F.col("height") == cut) & spread)).select("word").limit(words)
    out = [bytes(r["word"]) for r in top.collect()]
    discard(counted)
    return out


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def _segments(texts: list[str], special: list[str]) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Texts cut at special tokens: the pieces, how many each text has, and the tokens between them."""
    if not any(s in t for s in special for t in texts):
        return texts, np.ones(len(texts), np.int64), [[] for _ in texts]
    import regex

    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
    out, counts, between = [], [], []
    for t in texts:
        parts = cut.split(t)
        out += parts
        counts.append(len(parts))
        between.append(cut.findall(t))
    return out, np.array(counts, np.int64), between


def encode_texts(texts: list[str | None], v: Vocabulary, lexicon: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and how many each text has."""
    texts = [t or "" for t in texts]
    segments, per_text, between = _segments(texts, list(v.special))
    words, counts = split_words(segments)
    number = dict.fromkeys(words)
    number = dict(zip(number, range(len(number))))
    index = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    distinct = list(number)
    place = look_up(distinct, lexicon)
    fresh = np.flatnonzero(place < 0)
    merged, at, size = merge_all([distinct[i] for i in fresh.tolist()], v)
    start = np.asarray(lexicon["start"])
    known = np.where(place >= 0, place, 0)
    length = np.where(place >= 0, start[known + 1] - start[known], 0) if len(start) > 1 else np.zeros(len(distinct), np.int64)
    begin = start[known] if len(start) > 1 else np.zeros(len(distinct), np.int64)
    length[fresh] = size
    begin[fresh] = len(lexicon["ids"]) + at
    table = np.concatenate([lexicon["ids"], merged])
    ids = table[ragged(begin[index], length[index])]
    ends = np.concatenate([[0], np.cumsum(length[index])])
    stops = np.cumsum(counts)
    sizes = ends[stops] - ends[stops - counts]
    if len(segments) == len(texts):
        return ids, sizes
    parts, out, totals, s = np.split(ids, np.cumsum(sizes)[:-1]), [], [], 0
    for n, tokens in zip(per_text.tolist(), between):
        line = [parts[s]]
        for k, token in enumerate(tokens, 1):
            line += [np.array([v.special[token]]), parts[s + k]]
        s += n
        out += line
        totals.append(sum(map(len, line)))
    return np.concatenate(out), np.array(totals, np.int64)


def decode_ids(ids: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of id sequences; bytes that are no UTF-8 become U+FFFD."""
    length = v.start[ids + 1] - v.start[ids]
    raw = v.text[ragged(v.start[ids], length)].tobytes()
    ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@dataclass(frozen=True)
class Codec:
    """A vocabulary and the lexicon file compiled for a corpus."""

    vocabulary: object  # broadcast
    file: str

    def lexicon(self) -> dict[str, np.ndarray]:
        return map_lexicon(SparkFiles.get(self.file))


def prepare(docs: DataFrame, vocabulary_path: str, text_col: str = "text", words: int = LEXICON) -> Codec:
    """Count the words of all texts and compile the `words` most frequent ones (fewer, if there are fewer)."""
    with open(vocabulary_path, encoding="utf-8") as f:
        v = vocabulary(f.read())
    context = docs.sparkSession.sparkContext
    path = write_lexicon(compile_lexicon(frequent_words(docs, text_col, list(v.special), words), v), tempfile.mkdtemp(prefix="lexicon-"))
    context.addFile(path)
    return Codec(context.broadcast(v), os.path.basename(path))


def encode(docs: DataFrame, codec: Codec, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of every whole text, packed as little-endian unsigned 32-bit integers.

    Strings of special tokens in a text become their ids. Null and empty texts
    give no ids. A column named `ids_col` is replaced, all others pass through;
    `unpack` turns packed ids into an array.
    """

    def work(texts):
        ids, sizes = encode_texts(texts, codec.vocabulary.value, codec.lexicon())
        ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
        raw = ids.astype("<u4").tobytes()
        return [pa.array([raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())]

    return map_text(docs, text_col, T.StructType([T.StructField(ids_col, T.BinaryType())]), work, PIECE)


def decode(coded: DataFrame, codec: Codec, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of packed ids, special tokens kept; null ids give an empty text."""

    def work(rows):
        sizes = np.array([len(r) // 4 if r else 0 for r in rows], np.int64)
        ids = np.frombuffer(b"".join(r for r in rows if r), "<u4").astype(np.int64)
        return [decode_ids(ids, sizes, codec.vocabulary.value)]

    return map_text(coded, ids_col, T.StructType([T.StructField(text_col, T.StringType())]), work, PIECE)


def unpack(ids_col: str = "ids"):
    """Packed ids as an array of longs."""
    digits = F.hex(ids_col)
    swapped = F.regexp_replace(digits, "(..)(..)(..)(..)", "$4$3$2$1 ")
    return F.transform(F.filter(F.split(swapped, " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
