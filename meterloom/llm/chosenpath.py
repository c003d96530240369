"""Near copies by a chosen-path set similarity join.

Every text is its set of word shingles, and every distinct set a row of minwise
tokens. A tree starts with all sets; each node selects `BRANCHES` of the tokens
and sends a set to one child for each, named by the token's value. Two sets of
similarity s stay together in a child with probability s, so with s = 0.85 and
two branches a pair reaches a small node of a tree with probability 0.969 at
any depth: the chance that it is never in one follows q = (1 - s + s q)^2, whose
solution is 0.031. `TREES` independent trees miss it with probability 3e-8.

Branching goes on over the whole cluster while nodes are too large for a task;
a node that fits is branched further inside one. It stops in one of two ways. A
small node is compared exhaustively, by tokens first. A node whose child holds
most of it is not taken further, since branching no longer separates it: such a
crowd is dealt out in pieces that each get the crowd's centre, the set nearest
to its most common tokens; what the centre does not bring together is then
compared with the whole crowd. Either way sets that are alike by tokens go to
exact comparison on whole sets in groups of bounded size, and a group gives at
most one link per set.

Texts with the same set take part once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.llm import simhash
from meterloom.llm.common import map_text, ragged, without
from meterloom.session import settle

WORDS = 5
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 85
SEED = 42
TREES, BRANCHES, DEPTH = 5, 2, 5
#: Minwise tokens of a set; the first TREES * BRANCHES name the children of the roots.
TOKENS = 64
#: Equal tokens of 64 that a pair needs to be compared exactly: a pair at 0.85 has fewer with probability 4e-8.
ALIKE = 36
#: Sets of a node compared exhaustively, sets of a node branched inside a task, and shingles of a group compared exactly, at most.
NODE, LOCAL, SHINGLES = 256, 4_096, 1_000_000
#: A child with this share of its parent shows that branching does not separate the parent.
CROWDED = 0.6
#: Token comparisons held at once in a task.
PAIRS = 200_000

_SCHEMA = T.StructType([T.StructField("__set", T.LongType()), T.StructField("__size", T.LongType()), T.StructField("__roots", T.ArrayType(T.LongType())), T.StructField("__tokens", T.BinaryType())])


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles in order; a shorter text is one shingle, a text without words none."""
    import xxhash

    parts = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII blanks split
    if not parts:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles], np.uint64))


def tokens_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row of `TOKENS` minwise values for every set; sets must not be empty."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), TOKENS), np.uint64)
    if sets:
        flat = np.concatenate(sets)
        first = np.cumsum([0, *map(len, sets[:-1])])
        for c in range(TOKENS):
            out[:, c] = np.minimum.reduceat(flat * factors[c], first) * factors[c - 1]
    return out


def _sketched(texts: list[str | None]) -> list:
    import xxhash

    sets = [shingle_set(t) for t in texts]
    digest = [xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets]
    found = tokens_of([s for s in sets if len(s)])
    roots = iter(found[:, : TREES * BRANCHES].view(np.int64).tolist())
    short = iter([row.tobytes() for row in (found >> np.uint64(48)).astype("<u2")])
    full = [bool(len(s)) for s in sets]
    return [pa.array(np.array(digest, np.uint64).view(np.int64)), [len(s) for s in sets], [next(roots) if f else None for f in full], [next(short) if f else None for f in full]]


def linked(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """For distinct sets: the ids linked to a smaller one in their group, and the smallest of the group.

    Groups are what pairs with 100 * intersection >= percent * union join,
    directly or in steps, among these sets alone. No set may be empty.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = np.asarray(ids, np.int64)[order], [sets[k] for k in order]
    size = np.array([len(s) for s in sets], np.int64)
    begin = np.cumsum(size) - size
    terms, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(terms), bool)
    label = np.arange(len(sets))
    last = np.searchsorted(percent * size, 100 * size, "right")
    for i in range(len(sets)):
        j = np.arange(i + 1, last[i])
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        own = code[begin[i] : begin[i] + size[i]]
        mark[own] = True
        both = np.add.reduceat(mark[code[ragged(begin[j], size[j])]], np.cumsum(size[j]) - size[j], dtype=np.int64)
        mark[own] = False
        j = j[100 * both >= percent * (size[i] + size[j] - both)]
        if len(j):
            label = simhash._join(label, np.full(len(j), i), j)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    root = least[label]
    some = root != ids
    return ids[some], root[some]


def alike(size: np.ndarray, tokens: np.ndarray, classes: np.ndarray | None = None, percent: int = PERCENT):
    """Pairs (i < j) of sets that may be linked, a bounded number at a time: enough equal tokens, sizes near enough.

    `classes` is read again for every piece: pairs of one class are left out.
    """
    n = len(size)
    step = max(1, PAIRS // n)
    for a in range(0, n, step):
        rows = slice(a, min(n, a + step))
        near = np.minimum(size[rows, None], size[None, :]) * 100 >= percent * np.maximum(size[rows, None], size[None, :])
        near &= np.arange(n)[None, :] > np.arange(n)[rows, None]
        i, j = np.nonzero(near)
        for k in range(0, len(i), max(1, PAIRS // 8)):
            x, y = i[k : k + max(1, PAIRS // 8)] + a, j[k : k + max(1, PAIRS // 8)]
            if classes is not None:
                some = classes[x] != classes[y]
                x, y = x[some], y[some]
            some = (tokens[x] == tokens[y]).sum(axis=1) >= ALIKE
            yield x[some], y[some]


class Found:
    """Groups of sets to be compared exactly.

    A group goes by its least member, so what several trees find of the same
    copies falls together; `apart` keeps groups as they are. Very long texts
    meet in pairs of their own.
    """

    def __init__(self, node: int = NODE, shingles: int = SHINGLES, apart: bool = False):
        self.node, self.shingles, self.apart = node, shingles, apart
        self.gids: list = []
        self.members: list = []

    def add(self, ids: np.ndarray, size: np.ndarray, tokens: np.ndarray, classes: np.ndarray | None = None) -> None:
        """Compare all sets by tokens: what may be linked, directly or in steps, makes a group."""
        label = np.arange(len(ids))
        for i, j in alike(size, tokens, classes if classes is not None else label):
            label[:] = simhash._join(label.copy(), i, j)
        order = np.argsort(label, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if len(group) > 1 and (len(group) > self.node or size[group].sum() <= self.shingles):
                self._named(ids[group], _hash(*sorted(ids[group].tolist())) if self.apart else int(ids[group].min()))
            elif len(group) > 1:
                for i, j in alike(size[group], tokens[group], None if classes is None else classes[group]):
                    for pair in zip(i.tolist(), j.tolist()):
                        two = ids[group[list(pair)]]
                        self._named(two, _hash(*sorted(two.tolist())))

    def branch(self, ids: np.ndarray, size: np.ndarray, tokens: np.ndarray, name: int, depth: int, crowded: float) -> None:
        """Branch a node until its parts are small, or branching no longer separates them."""
        if len(ids) <= self.node or depth == 0:
            self.add(ids, size, tokens)
            return
        parts = []
        for b in range(BRANCHES):
            token = tokens[:, TREES * BRANCHES + _hash(name, b) % (TOKENS - TREES * BRANCHES)]
            order = np.argsort(token, kind="stable")
            parts += [(b, p) for p in np.split(order, np.flatnonzero(np.diff(token[order])) + 1)]
        if max(len(p) for _, p in parts) >= crowded * len(ids):
            self.add(ids, size, tokens)
            return
        for b, p in parts:
            if len(p) > 1:
                self.branch(ids[p], size[p], tokens[p], _hash(name, b, int(tokens[p[0], 0])), depth - 1, crowded)

    def _named(self, fps: np.ndarray, name: int) -> None:
        self.gids.append(np.full(len(fps), name))
        self.members.append(fps)

    def batch(self) -> pa.RecordBatch:
        """`gid` and `fp` of every member."""
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p) if p else np.zeros(0), pa.int64()) for p in (self.gids, self.members)], names=["gid", "fp"])


def _hash(*parts: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(np.array(parts, np.int64).tobytes(), SEED) >> 1


def _compared(nodes: DataFrame, node: int, depth: int, crowded: float, classes: bool = False) -> DataFrame:
    """Distinct (`gid`, `fp`) of nodes given as `key` and an array `m` of fp, size, tokens and, if told so, class."""

    def run(batches):
        for batch in batches:
            found = Found(node, apart=classes)
            for key, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                members = row.values
                ids, size = (members.field(name).to_numpy() for name in ("fp", "size"))
                tokens = np.frombuffer(b"".join(members.field("tokens").to_pylist()), "<u2").reshape(len(ids), -1)
                if classes:
                    found.add(ids, size, tokens, members.field("class").to_numpy())
                else:
                    found.branch(ids, size, tokens, key, depth, crowded)
            yield found.batch()

    return nodes.select("key", "m").mapInArrow(run, "gid long, fp long").distinct()


def _stats(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor(F.xxhash64("fp")).alias("mix"), *more).where("n > 1")


def grow(sets: DataFrame, node: int = NODE, local: int = LOCAL, depth: int = DEPTH, crowded: float = CROWDED) -> list[DataFrame]:
    """Groups (`gid`, `fp`) level by level: those of nodes that fit a task, and whole nodes that branching does not separate."""
    rows = sets.select(F.posexplode("roots").alias("token", "value"), "fp").select(F.xxhash64("token", "value").alias("key"), "fp")
    found, stats = [], settle(_stats(rows), "nodes")
    for level in range(1, depth + 1):
        # Nodes with the same members are one.
        alone = stats.groupBy("n", "lo", "hi", "mix").agg(F.min("key").alias("node"))
        held = rows.join(alone.where(F.col("n") <= local).select("node"), F.col("key") == F.col("node")).select("key", "fp").join(sets.select("fp", "size", "tokens"), "fp")
        lists = held.groupBy("key").agg(F.collect_list(F.struct("fp", "size", "tokens")).alias("m"))
        found.append(settle(_compared(lists, node, depth - level, crowded), "groups"))
        large = alone.where(F.col("n") > local).select(F.col("node").alias("large"), "n", "lo")
        if large.isEmpty():
            break
        open_ = settle(rows.join(large, F.col("key") == F.col("large")).select("key", "fp", "n", "lo"), "open")
        if level == depth:
            found.append(open_.select(F.col("lo").alias("gid"), "fp"))
            break
        # A node's tokens are chosen by its name, from those that no root uses.
        own = open_.join(sets.select("fp", "tokens"), "fp").withColumn("b", F.explode(F.array(*map(F.lit, range(BRANCHES)))))
        token = F.pmod(F.xxhash64("key", "b", F.lit(SEED)), F.lit(TOKENS - TREES * BRANCHES)) + TREES * BRANCHES
        value = F.substring(F.col("tokens"), (2 * token + 1).cast("int"), F.lit(2))
        below = settle(own.select(F.xxhash64("key", "b", value).alias("key"), F.col("key").alias("parent"), F.col("n").alias("up"), "fp"), "children")
        stats = settle(_stats(below, F.first("parent").alias("parent"), F.first("up").alias("up")), "nodes")
        full = settle(stats.groupBy("parent").agg((F.max("n") >= crowded * F.first("up")).alias("full")).where("full").select("parent"), "full")
        found.append(open_.join(full, F.col("key") == F.col("parent"), "left_semi").select(F.col("lo").alias("gid"), "fp"))
        rows = below.join(full, "parent", "left_anti")
        stats = stats.join(full, "parent", "left_anti")
    return found


def _carrying(rows: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """`rows` with columns of the set `fp` names; a set is joined once, however many crowds it is in (at most one for each token of the roots and level)."""
    rest = [c for c in rows.columns if c != "fp"]
    held = rows.groupBy("fp").agg(F.collect_list(F.struct(*rest)).alias("__in")).join(sets.select("fp", *columns), "fp")
    return held.select("fp", *columns, F.explode("__in").alias("__in")).select("__in.*", "fp", *columns)


def _centres(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """(`gid`, `centre`): of each crowd the set that agrees most with the most common tokens.

    The tokens are counted on about `NODE` members per crowd, chosen by hash;
    that decides which set is the centre and nothing else.
    """
    held = _carrying(crowd, sets, "tokens")
    some = held.where(F.pmod(F.xxhash64("fp", "gid"), "n") < NODE).groupBy("gid").agg(F.collect_list("tokens").alias("some"))

    def common(batches):
        for batch in batches:
            made = []
            for row in batch.column(1):
                t = np.frombuffer(b"".join(row.as_py()), "<u2").reshape(-1, TOKENS)
                made.append(np.array([np.bincount(t[:, c]).argmax() for c in range(TOKENS)], "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["gid", "mode"])

    def agreeing(batches):
        for batch in batches:
            t, m = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, TOKENS) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((t != m).sum(axis=1))], names=["gid", "fp", "off"])

    modes = some.mapInArrow(common, "gid long, mode binary")
    scored = held.join(modes, "gid").select("gid", "fp", "tokens", "mode").mapInArrow(agreeing, "gid long, fp long, off long")
    return scored.groupBy("gid").agg(F.min(F.struct("off", "fp")).alias("best")).select("gid", F.col("best.fp").alias("centre"))


def _stars(crowd: DataFrame, centres: DataFrame, node: int) -> DataFrame:
    """Crowds in pieces, each with the crowd's centre: `crowd`, `gid` of the piece, `fp`, `centre`, `n`."""
    parts = F.ceil(F.col("n") / node).cast("long")
    named = [F.col("gid").alias("crowd"), F.xxhash64("gid", "part").alias("gid")]
    dealt = crowd.join(centres, "gid").withColumn("part", F.pmod(F.xxhash64("fp"), parts)).select(*named, "fp", "centre", "n")
    heads = centres.join(crowd.groupBy("gid").agg(F.first("n").alias("n")), "gid").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.where("fp <> centre").unionByName(heads.select(*named, F.col("centre").alias("fp"), "centre", "n"))


def _strangers(pieces: DataFrame, made: DataFrame, sets: DataFrame, node: int) -> DataFrame:
    """Groups of what a crowd's centre left out, with all of the crowd: every part of the one meets every part of the other."""
    rooted = pieces.join(made.select("gid", F.col("u").alias("fp"), "v"), ["gid", "fp"], "left").withColumn("root", F.coalesce("v", "fp"))
    heart = rooted.where("fp = centre").select("gid", F.col("root").alias("heart"))
    known = rooted.join(heart, "gid").withColumn("out", F.col("root") != F.col("heart"))
    known = settle(known.groupBy("crowd", "fp").agg(F.min("out").alias("out"), F.first("centre").alias("centre")), "crowd-members")
    sizes = known.groupBy("crowd").agg(F.sum(F.col("out").cast("long")).alias("few"), F.count(F.lit(1)).alias("many")).where("few > 0")
    here = _carrying(known.join(sizes, "crowd"), sets, "size", "tokens")
    many, few = (F.ceil(F.col(c) / (node // 2)).cast("long") for c in ("many", "few"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # What the centre has brought together need not be compared again.
    kind = F.when(F.col("out"), F.col("fp")).otherwise(F.col("centre")).alias("class")
    member = F.struct("fp", "size", "tokens", kind).alias("m")
    left = here.where("out").select("crowd", F.pmod(F.xxhash64("fp", F.lit(SEED)), few).alias("a"), F.explode(upto(many)).alias("b"), member)
    right = here.select("crowd", F.explode(upto(few)).alias("a"), F.pmod(F.xxhash64("fp"), many).alias("b"), member)
    tiles = left.unionByName(right).groupBy("crowd", "a", "b").agg(F.collect_set("m").alias("m"))
    return _compared(tiles.withColumnRenamed("crowd", "key"), node, 0, 1.0, classes=True)


def verified(groups: DataFrame, rows: DataFrame, sets: DataFrame, text_col: str, percent: int) -> DataFrame:
    """(`gid`, `u`, `v`): the sets u of each group that whole sets link to a smaller one, and the smallest v they reach in it."""
    # A text is joined once, however many groups compare it.
    wanted = groups.groupBy("fp").agg(F.collect_list("gid").alias("gids")).join(sets.select("fp", "row"), "fp")
    texts = rows.select(F.col("__row").alias("row"), F.col(text_col).alias("text"))
    # One side is a list of row numbers: where it is small the texts of other rows need not move at all.
    needed = wanted.select("row").distinct()
    if needed.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(needed), "row", "left_semi")
    held = wanted.join(texts, "row").select(F.explode("gids").alias("gid"), "fp", "text")
    dealt = held.repartition("gid").sortWithinPartitions("gid")

    def compare(batches):
        now, ids, sets = None, [], []
        for batch in batches:
            for gid, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if gid != now:
                    yield from _links(now, ids, sets, percent)
                    now, ids, sets = gid, [], []
                ids.append(fp)
                sets.append(shingle_set(text.as_py()))
        yield from _links(now, ids, sets, percent)

    return settle(dealt.mapInArrow(compare, "gid long, u long, v long"), "links")


#: Row numbers (8 bytes each) sent to every executor at most.
BROADCAST_ROWS = 500_000


def _links(gid: int, ids: list, sets: list, percent: int):
    if len(ids) > 1:
        u, v = linked(np.array(ids, np.int64), sets, percent)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), gid), pa.int64()), pa.array(u), pa.array(v)], names=["gid", "u", "v"])


def links(rows: DataFrame, text_col: str, percent: int = PERCENT, node: int = NODE, local: int = LOCAL, depth: int = DEPTH, crowded: float = CROWDED) -> DataFrame:
    """(`fp`, `root`): every set of `rows` (with `__row` and the sketch) that is linked, with the smallest one it reaches."""
    distinct = rows.where("__size > 0").groupBy(F.col("__set").alias("fp")).agg(F.min("__row").alias("row"), F.first("__size").alias("size"), F.first("__roots").alias("roots"), F.first("__tokens").alias("tokens"))
    sets = settle(distinct, "sets")
    found = settle(_all(grow(sets, node, local, depth, crowded)).distinct(), "groups")
    crowds = found.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * node)
    crowd = settle(found.join(crowds, "gid"), "crowds")
    if crowd.isEmpty():
        made = verified(found, rows, sets, text_col, percent)
    else:
        pieces = settle(_stars(crowd, _centres(crowd, sets), node), "pieces")
        made = verified(found.join(crowds, "gid", "left_anti").unionByName(pieces.select("gid", "fp")), rows, sets, text_col, percent)
        rest = settle(_strangers(pieces, made, sets, node), "groups")
        if not rest.isEmpty():
            made = made.unionByName(verified(rest, rows, sets, text_col, percent))
    return simhash.groups(made.select("u", "v").distinct())


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT, node: int = NODE, local: int = LOCAL, depth: int = DEPTH, crowded: float = CROWDED) -> DataFrame:
    """Add `n_shingles`, `component_id` (the smallest id reachable) and `kept` (the row has that id).

    One row per input row, repeated rows included. Texts without words and null
    texts have no shingle and are linked with nothing: their component is their
    own id. A null id is never the smallest of a group; a group of null ids has
    a null component, and a row with a null id is not kept. Columns of these
    names are replaced, those named like the sketch's (`__set`, …) go, all others
    but the text pass through.
    """
    kept = without(docs, ["n_shingles", "component_id", "kept", "__row", *_SCHEMA.names])
    sketched = map_text(kept, text_col, _SCHEMA, _sketched)
    rows = settle(sketched.withColumn("__row", F.monotonically_increasing_id()), "sketched")
    grouped = links(rows, text_col, percent, node, local, depth, crowded)
    least = rows.where("__size > 0").groupBy(F.col("__set").alias("fp")).agg(F.min(F.col(f"`{id_col}`")).alias("best"))
    rooted = least.join(grouped, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("best").alias("__best"))
    found = rooted.select("fp", "root").join(best, "root").select(F.col("fp").alias("__set"), "__best")
    own = F.when(F.col("__size") > 0, F.col("__best")).otherwise(F.col(f"`{id_col}`"))
    out = rows.drop(text_col).join(found, "__set", "left")
    passed = [F.col(f"`{c}`") for c in without(kept, [text_col]).columns]
    return out.select(*passed, F.col("__size").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col(f"`{id_col}`") == own, F.lit(False)).alias("kept"))
