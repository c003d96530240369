"""Exact top-k inner-product search by tiled matrix products.

Query vectors are packed into blocks and candidates into shards, both of bounded
size. Every block meets every shard once; a task multiplies the two matrices a
slice at a time and selects each query's best rows of the tile, and the short
lists are merged in a tree, a bounded number of lists at a time. Blocks travel
to every shard, so shards grow with the number of queries, and values travel as
shorts where they fit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
#: Candidates of a shard at least, and those multiplied at once.
SHARD = 4_096
#: Values of a shard at most, above that least number of candidates.
SHARD_VALUES = 1 << 22
#: Lists of a query merged at once.
FAN = 32
SCALE = 256


def quantised(vector: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as doubles that hold whole numbers; null unless all are finite."""
    fine = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    floored = F.transform(vector, lambda x: _floor(x.cast("double") * F.lit(float(scale))))
    return F.when(fine, floored)


def _floor(x: Column) -> Column:
    # Beyond 2^53 every double is whole; below, the cast to long is exact.
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the smallest kind of float that holds every sum of products exactly; doubles if none does."""
    most = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] if q.size and c.size else 0.0
    kind = np.float32 if most < 2.0**24 else np.float64
    return q.astype(kind), c.astype(kind)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact whole inner products, as floats where those hold them; beyond a long they stop at its ends."""
    if q.dtype == np.float32 or not q.size or float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**53:
        return q @ c.T
    whole = np.vectorize(int, otypes=[object])
    ends = np.iinfo(np.int64)
    return np.array([[min(max(int(s), ends.min), ends.max) for s in line] for line in whole(q).dot(whole(c).T)], np.int64).reshape(len(q), len(c))


def _first(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `k` best distinct ids of each row, best first, ties to smaller ids."""
    # ~ turns the order round without leaving the long.
    by = np.lexsort((~scores, ids, row))
    row, ids, scores = row[by], ids[by], scores[by]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, scores = row[once], ids[once], scores[once]
    by = np.lexsort((ids, ~scores, row))
    row, ids, scores = row[by], ids[by], scores[by]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], scores[kept]


def select(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, slice_: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's `k` best candidates, its own id left out, ties to smaller ids.

    Candidates are taken in order of id, a slice at a time. Once every query
    has `k` of them, only a score above its last one gets in.
    """
    order = np.argsort(ids, kind="stable")
    ids, (q, c) = ids[order], _exact(q, c[order])
    row, found, best = (np.empty(0, np.int64) for _ in range(3))
    for at in range(0, len(ids), slice_):
        scores = _products(q, c[at : at + slice_])
        here, first = np.unique(ids[at : at + slice_], return_index=True)
        if len(here) < scores.shape[1]:
            scores = np.maximum.reduceat(scores, first, axis=1)
        place = np.minimum(np.searchsorted(here, query_ids), len(here) - 1)
        own = np.flatnonzero(here[place] == query_ids)
        scores[own, place[own]] = -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min
        if len(row) == k * len(q):
            above = scores > best[k - 1 :: k, None].astype(scores.dtype)
        else:
            edge = max(len(here) - k, 0)
            above = scores >= np.partition(scores, edge, axis=1)[:, edge, None]
        at_row, col = np.divmod(np.flatnonzero(above), len(here))
        others = here[col] != query_ids[at_row]
        at_row, col = at_row[others], col[others]
        if len(at_row):
            row, found, best = _first(*map(np.concatenate, ((row, at_row), (found, here[col]), (best, scores[at_row, col].astype(np.int64)))), k)
    return query_ids[row], found, best


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector: str = "vector", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: the `k` candidates of highest inner product.

    `vector` holds whole numbers as doubles. Ties go to the smaller id; all
    candidates are given if there are fewer. A query's own id is no candidate
    for it. Rows with a null id or vector take no part; a vector is compared
    with vectors of its own length. Repeated rows count once; where one id has
    several vectors, its best score counts. Empty tables give an empty result.
    """
    clean = lambda df: df.select(id_col, vector).where(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
    queries, candidates = clean(queries), clean(candidates)
    # Repeated rows only make the parts smaller, so nothing is shuffled to be counted.
    (n_queries, _, most_q), (n_candidates, width, most_c) = (_extent(df, vector) for df in (queries, candidates))
    if all(most <= np.iinfo(np.int16).max for most in (most_q, most_c)):
        queries, candidates = (df.withColumn(vector, F.col(vector).cast("array<smallint>")) for df in (queries, candidates))
    queries, candidates = queries.distinct(), candidates.distinct()
    # Queries go to every shard: as many shards as candidates a query, unless that leaves cores idle or makes a shard too large.
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n_candidates / max(shard, min(n_queries, SHARD_VALUES // max(width, 1), n_candidates // (2 * cores)))))
    blocks = max(1, math.ceil(n_queries / block))

    def packed(df: DataFrame, parts: int, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64(id_col, vector), F.lit(parts)).cast("int")
        rows = df.groupBy(part.alias(name), F.size(vector).alias("width")).agg(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(vector).alias("v"))).alias("rows"))
        return rows.select(name, "width", F.col("rows.i").alias(f"{name}_ids"), F.flatten("rows.v").alias(f"{name}_values"))

    left = packed(queries, blocks, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # Statistics don't see how often a block is repeated, and would have the repeated blocks gathered in the driver as a small table.
    tiles = left.hint("merge").join(packed(candidates, shards, "shard"), ["shard", "width"])

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at, width, qi, qv, ci, cv = (batch.column(j)[i] for j in range(6))
                ids, values = [_numpy(x) for x in (qi, ci)], [_numpy(x) for x in (qv, cv)]
                w = width.as_py()
                made = select(ids[0], values[0].reshape(len(ids[0]), w), ids[1], values[1].reshape(len(ids[1]), w), k)
                yield pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(np.full(len(made[0]), at.as_py(), np.int32))], names=["query_id", "vec_id", "score", "part"])

    lists = tiles.select("shard", "width", "block_ids", "block_values", "shard_ids", "shard_values").mapInArrow(work, "query_id long, vec_id long, score long, part int")
    parts = shards
    while parts > 1:
        parts = math.ceil(parts / FAN)
        lists = _best(lists.withColumn("part", F.floor(F.col("part") / FAN).cast("int")), k)
    lists = _best(lists.withColumn("part", F.lit(0)), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _extent(df: DataFrame, vector: str) -> tuple[int, int, float]:
    """Rows of a table, the longest vector and the largest value, whatever its sign."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    n, width, most = df.agg(F.count(F.lit(1)), F.max(F.size(vector)), F.max(most)).first()
    return n, width or 0, most or 0.0


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The `k` best distinct ids of each query and part."""
    once = lists.groupBy("query_id", "part", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _numpy(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)
