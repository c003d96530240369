"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The method is that of `simhash` with a fingerprint wide enough for 0.8: 256 bits
over the shingles of a set, linked at `RADIUS` bits. Every text also gets a
sketch of least shingle hashes, cut into bands, in place of the blocks of bits
that agree at two bits but not at so wide a radius. Fingerprints that share a
band meet in tiles of bounded size, where a table of Hamming distances to some
of them (pivots) discards pairs and the rest are counted bit by bit; tiles hold
fingerprints only. The texts of each group so linked then meet, once, and their
whole shingle sets are compared exactly: sizes, then a table of Jaccard
distances to some reference sets discard pairs, the rest is counted.

A pair of similarity s shares no band with probability (1 - s ** ROWS) ** BANDS,
5e-8 at 0.8. At 0.8 a bit differs with probability 0.15 (0.19 in sets of four
and five shingles), so a pair is beyond the radius with probability 1e-9 (1e-5).

Texts with the same shingle set take part once. Bands that bring the same texts
together make one tile, and a tile gives at most one link per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm import simhash
from meterloom.llm.common import map_text, ragged
from meterloom.session import settle_mapped

WORDS = 5
SHARE = 0.8
SEED = 42
BANDS, ROWS = 32, 4
#: Longs of a fingerprint, and the bits in which linked ones may differ.
PRINT, RADIUS = 4, 76
PIVOTS = 8
#: Texts and shingles of one band compared in one piece are at most about twice as many.
TILE, TILE_SHINGLES = 1_024, 1_000_000

_SCHEMA = T.StructType([T.StructField("__set", T.LongType()), T.StructField("__size", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType())), T.StructField("__print", T.ArrayType(T.LongType()))])


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes in order; a shorter text is one shingle. Words are those of `simhash`."""
    import xxhash

    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles], np.uint64))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row of `BANDS` keys for every set; sets must not be empty."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), BANDS), np.uint64)
    if not sets:
        return out.view(np.int64)
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    for b in range(BANDS):
        for r in range(ROWS):
            least = np.minimum.reduceat(flat * factors[0, b, r], first)
            out[:, b] = (out[:, b] ^ (least >> np.uint64(29)) ^ least) * factors[1, b, r]
    return out.view(np.int64)


def print_of(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of a set that is not empty: the hashes themselves vote on the first 64 bits, mixtures of them on the others."""
    words = shingles[:, None] + np.arange(PRINT, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        words[:, 1:] = (words[:, 1:] ^ (words[:, 1:] >> np.uint64(shift))) * np.uint64(factor)
    words[:, 1:] ^= words[:, 1:] >> np.uint64(31)
    return simhash.majority(words)


def _sketched(texts: list[str | None]) -> list:
    import xxhash

    sets = [shingle_set(t) for t in texts]
    digest = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
    found = iter(bands_of([s for s in sets if len(s)]).tolist())
    return [digest.tolist(), [len(s) for s in sets], [next(found) if len(s) else None for s in sets], [print_of(s).tolist() if len(s) else None for s in sets]]


def within(ids: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct sets and their fingerprints: the ids linked to a smaller one in their group, and the smallest of the group."""
    order = np.argsort(ids)
    ids, x = np.asarray(ids, np.int64)[order], np.ascontiguousarray(np.asarray(prints, np.int64)[order]).view(np.uint64)
    refs = x[np.unique(np.linspace(0, len(x) - 1, PIVOTS).astype(int))] if len(x) > 8 * PIVOTS else x[:1]
    label = simhash.nearby(x, RADIUS, refs)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    root = least[label]
    some = root != ids
    return ids[some], root[some]


def linked(ids: np.ndarray, sets: list[np.ndarray], share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """For distinct sets: the ids linked to a smaller one in their group, and the smallest of the group.

    Groups are what similarities of at least `share` join, directly or in steps,
    among these sets alone. No set may be empty.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = np.asarray(ids, np.int64)[order], [sets[k] for k in order]
    size = np.array([len(s) for s in sets], np.int64)
    begin = np.cumsum(size) - size
    terms, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(terms), bool)

    def alike(i: int, j: np.ndarray) -> np.ndarray:
        own = code[begin[i] : begin[i] + size[i]]
        mark[own] = True
        both = np.add.reduceat(mark[code[ragged(begin[j], size[j])]], np.cumsum(size[j]) - size[j], dtype=np.int64)
        mark[own] = False
        return both / (size[i] + size[j] - both)

    every = np.arange(len(sets))
    table = [alike(i, every) for i in np.linspace(0, len(sets) - 1, PIVOTS).astype(int)] if len(sets) > 8 * PIVOTS else []
    last = np.searchsorted(size, size / share + 1e-6, "right")
    label = every.copy()
    for i in range(len(sets)):
        j = np.arange(i + 1, last[i])
        j = j[label[j] != label[i]]
        for row in table:
            j = j[np.abs(row[j] - row[i]) <= 1 - share + 1e-9]
        if len(j):
            j = j[alike(i, j) >= share - 1e-9]
            label = simhash._join(label, np.full(len(j), i), j)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    root = least[label]
    some = root != ids
    return ids[some], root[some]


def _links(pair: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    return pa.table({"u": pa.array(pair[0], pa.int64()), "v": pa.array(pair[1], pa.int64())})


def _dealt(held: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key dealt to pieces `a`, `b`, so that any two rows meet in one; `parts` says how many pieces a key is cut into."""
    salted = held.join(parts, keys).withColumn("s", F.pmod(F.xxhash64("fp"), "parts"))
    pieces = salted.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return pieces.withColumn("a", F.least("s", "o")).withColumn("b", F.greatest("s", "o")).drop("s", "o", "parts")


def candidates(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (`u`, `v`), v the smaller, of the sets whose fingerprints are within the radius, among those that share a band."""
    spread = distinct.select("fp", F.posexplode("bands").alias("t", "key"))
    met = spread.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor(F.xxhash64("fp")).alias("mix")).where("n > 1")
    shared = met.groupBy("n", "lo", "hi", "mix").agg(F.min(F.struct("t", "key")).alias("k")).select("k.t", "k.key", F.ceil(F.col("n") / tile).alias("parts"))
    tiles = _dealt(spread, shared, ["t", "key"]).join(distinct.select("fp", "print"), "fp")

    def compare(part: pa.Table) -> pa.Table:
        prints = part.column("print").combine_chunks().flatten().to_numpy()
        return _links(within(part.column("fp").to_numpy(), prints.reshape(-1, PRINT)))

    return tiles.select("t", "key", "a", "b", "fp", "print").groupBy("t", "key", "a", "b").applyInArrow(compare, "u long, v long").distinct()


def links(rows: DataFrame, text_col: str, tile: int = TILE, shingles: int = TILE_SHINGLES) -> DataFrame:
    """Links (`u`, `v`), v the smaller, that join the sets of `rows` (with `__row` and the sketches) into groups."""
    distinct = rows.where("__size > 0").groupBy(F.col("__set").alias("fp")).agg(F.min("__row").alias("__row"), F.first("__size").alias("size"), F.first("__bands").alias("bands"), F.first("__print").alias("print"))
    grouped = simhash.groups(candidates(distinct, tile))
    every = grouped.unionByName(grouped.select(F.col("root").alias("fp"), "root").distinct())
    held = every.join(distinct.select("fp", "__row", "size"), "fp")
    parts = held.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("size") / shingles)).alias("parts"))
    pieces = _dealt(held.drop("size"), parts, ["root"]).join(rows.select("__row", F.col(text_col).alias("text")), "__row").select("root", "a", "b", "fp", "text")

    def compare(part: pa.Table) -> pa.Table:
        return _links(linked(part.column("fp").to_numpy(), [shingle_set(t) for t in part.column("text").to_pylist()]))

    return pieces.groupBy("root", "a", "b").applyInArrow(compare, "u long, v long").distinct()


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The row of the smallest id of every group of near copies, with all its columns.

    Texts without words are copies of each other. Of rows that repeat that id
    one is kept; ids count as smaller than null.
    """
    rows = settle_mapped(map_text(docs, text_col, _SCHEMA, _sketched).withColumn("__row", F.monotonically_increasing_id()), "sketched")
    slim = rows.select(F.col("__set").alias("fp"), F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__row").alias("row")).alias("best"))
    found = simhash._rooted(slim, F.col("best"), links(rows, text_col)).select("fp", F.col("best.row").alias("kept"))
    lost = slim.join(found, "fp").where(F.col("best.row") != F.col("kept")).select(F.col("best.row").alias("__row"))
    return rows.join(lost, "__row", "left_anti").select(*docs.columns)
