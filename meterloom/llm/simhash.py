"""SimHash fingerprints and the groups they link.

Fingerprints that differ in at most `RADIUS` bits are linked. Two blocks of bits
out of four agree in every linked pair, so pairs are only looked for among
distinct fingerprints that share two blocks. There a table of Hamming distances
to reference fingerprints (pivots) discards pairs: distances to one pivot can't
differ by more than the distance of the pair, so a pair whose largest coordinate
difference exceeds the radius is out. What is left is verified bit by bit.

Exact copies share one fingerprint and take part once. A crowded block pair is
cut into tiles of bounded size that are compared on their own, and a tile gives
at most one link per fingerprint, so neither memory nor output grows with the
square of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm.common import map_text
from meterloom.session import discard, settle

WORDS = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
PIVOTS = 16
#: Fingerprints of one block pair compared in one piece are at most about twice as many.
TILE = 2_048
#: Candidate pairs expanded at once in a task.
PAIRS = 1_000_000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint_of(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint, as a signed integer."""
    import xxhash

    parts = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII blanks split
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    return int(majority(np.array([digest(s, seed) for s in shingles], np.uint64))[0])


def majority(h: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the hashes, as signed integers: one for hashes, w for rows of w hashes."""
    rows = h.reshape(len(h), -1).view(np.uint8)
    width = rows.shape[1]
    per_byte = np.bincount((rows + np.arange(0, 256 * width, 256)).ravel(), minlength=256 * width).reshape(width, 256)
    set_bits = (per_byte @ _BITS).ravel() * 2 > len(h)
    return np.packbits(set_bits, bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """Add the fingerprint of every whole text as a long; texts without words have 0."""
    return map_text(docs, text_col, T.StructType([T.StructField(out_col, T.LongType())]), lambda texts: [pa.array([fingerprint_of(t) for t in texts], pa.int64())])


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def linked(values: np.ndarray, radius: int = RADIUS, refs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints: those linked to a smaller one in their group, and the smallest of the group.

    Groups are what links join, directly or in steps, among `values` alone.
    """
    x = np.unique(values).view(np.uint64)
    label = nearby(x[:, None], radius, (pivots() if refs is None else refs)[:, None])
    signed = x.view(np.int64)
    least = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(least, label, signed)
    root = least[label]
    some = root != signed
    return signed[some], root[some]


def nearby(x: np.ndarray, radius: int, refs: np.ndarray) -> np.ndarray:
    """For rows of fingerprints (one or more integers each): a row of the group that links within the radius join, the same one for all its rows."""
    table = np.bitwise_count(x[:, None, :] ^ refs[None, :, :]).sum(2, dtype=np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    near, table = x[order], table[order]
    reach = np.searchsorted(table[:, 0], table[:, 0] + radius, "right") - np.arange(len(near)) - 1
    label = np.arange(len(near))
    start = 0
    while start < len(near):
        stop = max(start + 1, int(np.searchsorted(np.cumsum(reach[start:]), PAIRS, "right")) + start)
        i = np.repeat(np.arange(start, stop), reach[start:stop])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reach[start:stop]) - reach[start:stop], reach[start:stop])
        for k in range(1, table.shape[1]):
            some = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[some], j[some]
        some = np.bitwise_count(near[i] ^ near[j]).sum(1, dtype=np.int16) <= radius
        label = _join(label, i[some], j[some])
        start = stop
    out = np.empty(len(near), np.int64)
    out[order] = order[label]
    return out


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while len(i):
        a, b = label[i], label[j]
        some = a != b
        if not some.any():
            break
        i, j, a, b = i[some], j[some], a[some], b[some]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def links(fps: DataFrame, col: str = "fp", tile: int = TILE) -> DataFrame:
    """Links (`u`, `v`), v the smaller, that join the same groups as all pairs within the radius."""
    width = 64 // BLOCKS
    masks = [sum(((1 << width) - 1) << (width * b) for b in pair) for pair in combinations(range(BLOCKS), BLOCKS - RADIUS)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    distinct = fps.select(F.col(col).alias("fp")).where(F.col("fp").isNotNull()).distinct()
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    spread = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    shared = spread.groupBy("t", "key").count().where("count > 1")
    parts = F.ceil(F.col("count") / tile)
    salted = spread.join(shared, ["t", "key"]).withColumn("s", F.pmod(F.xxhash64("fp"), parts))
    dealt = salted.withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    tiles = dealt.groupBy("t", "key", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(F.collect_list("fp").alias("fps"))

    def compare(batches):
        for batch in batches:
            made = [linked(np.asarray(fps, np.int64)) for fps in batch.column(0).to_pylist()]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[k] for m in made])) for k in (0, 1)], names=["u", "v"])

    return tiles.select("fps").mapInArrow(compare, "u long, v long").distinct()


def groups(edges: DataFrame) -> DataFrame:
    """(`fp`, `root`): every linked fingerprint with the smallest one it reaches.

    Each round hangs every node's larger neighbours, then its smaller ones,
    on the smallest; links end as stars after a number of rounds that grows
    with the logarithm of the longest chain. Rounds are written to the shared
    folder.
    """
    now, was = settle(edges, "links"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        after = settle(small, "links")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if mark == was:
            return now.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        was = mark


def _rooted(rows: DataFrame, best, edges: DataFrame | None = None) -> DataFrame:
    """(`fp`, `root`, `best`): the least `best` of a group, for every fingerprint of `rows`; `edges` are `links` unless given."""
    per_fp = rows.groupBy("fp").agg(F.min(best).alias("best"))
    grouped = groups(links(rows) if edges is None else edges)
    rooted = per_fp.join(grouped, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("best").alias("best"))
    return rooted.select("fp", "root").join(least, "root")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`doc_id`, `fingerprint` (16 hexadecimal digits) and `component_id`, the smallest id reachable.

    One row per input row, repeated rows included. Texts without words have
    fingerprint zero and are linked like any other. A null id is never the
    smallest; a group of null ids only has a null component. Other columns are
    not passed on.
    """
    rows = settle(fingerprints(docs.select(id_col, text_col), text_col).select(id_col, "fp"), "fingerprints")
    found = _rooted(rows, F.col(id_col))
    return rows.join(found, "fp", "left").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The row of the smallest id of every group, with all its columns.

    Of rows that repeat that id one is kept; ids count as smaller than null.
    """
    rows = settle(fingerprints(docs, text_col, "__fp").withColumn("__row", F.monotonically_increasing_id()), "fingerprinted")
    slim = rows.select(F.col("__fp").alias("fp"), F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__row").alias("row")).alias("best"))
    found = _rooted(slim, F.col("best")).select("fp", F.col("best.row").alias("kept"))
    lost = slim.join(found, "fp").where(F.col("best.row") != F.col("kept")).select(F.col("best.row").alias("__row"))
    return rows.join(lost, "__row", "left_anti").select(*docs.columns)
