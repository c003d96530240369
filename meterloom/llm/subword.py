"""Hashed word and character n-gram features, worked out once per distinct word of a piece."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(1099511628211)
_SEED = np.uint64(14695981039346656037)


def numbered(texts: list[str | None], split=None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words, each occurrence's number, and words per text."""
    split = split or (lambda t: t.lower().split())
    per_text = [split(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
    words = [w for ws in per_text for w in ws]
    index = dict.fromkeys(words)
    index = dict(zip(index, range(len(index))))
    return list(index), np.fromiter(map(index.__getitem__, words), np.int64, len(words)), counts


def hashed(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of `<word>`, and of the whole word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(chars))
    numbers, found = [], []
    with np.errstate(over="ignore"):
        h = np.full(len(chars), _SEED)
        for n in range(1, max(sizes, default=0) + 1):
            size = len(chars) - n + 1
            if size <= 0:
                break
            h = (h[:size] ^ chars[n - 1 :]) * _PRIME
            if n in sizes:
                some = left[:size] >= n
                numbers.append(owner[:size][some])
                found.append(_bucket(h[some] + np.uint64(n), buckets))
        if whole:
            power = np.cumprod(np.full(int(lengths.max()), _PRIME, np.uint64))
            sums = np.add.reduceat(chars * power[np.arange(len(chars)) - np.repeat(ends - lengths, lengths)], ends - lengths)
            numbers.append(np.arange(len(words)))
            found.append(_bucket(sums, buckets))
    return np.concatenate(numbers), np.concatenate(found)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's words."""
    ends = np.concatenate([[0], np.cumsum(values)])
    stops = np.cumsum(counts)
    return ends[stops] - ends[stops - counts]
