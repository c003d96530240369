"""Fixity audit of WARC replicas by trees of digests.

The records of a file are leaves. Records whose offsets lie in one stretch of the
file make a node, a fixed number of neighbouring stretches make the node above,
and so on to the root. Two replicas are compared root by root; only below nodes
that differ are children compared, down to the records that are not the same.

A record that was cut out or added moves all records behind it in the file, so
the stretches behind it differ too. Below them records are matched by digest and
order whatever their offset; what finds no match is judged by the matched record
it follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.scan import last_seen, running, total
from meterloom.session import settle

#: Bytes of a file that one lowest node covers, and nodes under one node.
STRETCH = 1 << 18
FAN = 16


def record(url: str, record_id: str, body: str) -> Column:
    """The bytes of a WARC resource record with this target, id and content."""
    content = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(record_id).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), content, F.lit(b"\r\n\r\n"))


def leaves(records: DataFrame, file_col: str = "file", offset_col: str | None = "offset", bytes_col: str = "record", order: list[str] | None = None, width: int = 256) -> DataFrame:
    """`file`, `offset`, `digest` of every record; a null record has the digest of no bytes.

    Without an offset column offsets follow from the sizes of the records before,
    in the given order (its first column a whole number); only digests and sizes
    are moved for that.
    """
    body = F.coalesce(F.col(bytes_col), F.lit(b""))
    hashed = F.sha2(body, 256).alias("digest")
    if offset_col is not None:
        return records.select(F.col(file_col).alias("file"), F.col(offset_col).cast("long").alias("offset"), hashed)
    slim = records.select(F.col(file_col).alias("file"), *order, hashed, F.octet_length(body).cast("long").alias("__size"))
    placed = running(slim, ["file"], [*order, "digest"], {"__end": total(F.col("__size"))}, width)
    return placed.select("file", (F.col("__end") - F.col("__size")).alias("offset"), "digest")


def tree(found: DataFrame, levels: int, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """`file`, `level` (0: stretches), `node`, `digest` of all nodes up to the roots.

    A node's digest covers its children's places and digests in order. A lowest
    node holds the records that begin in one stretch, a higher one at most
    `fan` nodes, so no task holds a file.
    """
    key = F.concat_ws(" ", F.coalesce(F.col("offset").cast("string"), F.lit("-")), "digest")
    now = found.groupBy("file", F.floor(F.coalesce("offset", F.lit(-1)) / stretch).cast("long").alias("node")).agg(_over(key)).withColumn("level", F.lit(0))
    all_ = now
    for level in range(1, levels + 1):
        now = now.groupBy("file", F.floor(F.col("node") / fan).cast("long").alias("node")).agg(_over(F.concat_ws(" ", F.col("node").cast("string"), "digest"))).withColumn("level", F.lit(level))
        all_ = all_.unionByName(now)
    return all_.select("file", "level", "node", "digest")


def _over(key: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256).alias("digest")


def _height(found: DataFrame, stretch: int, fan: int) -> int:
    last = found.agg(F.max("offset")).first()[0] or 0
    nodes, levels = int(last) // stretch + 1, 0
    while nodes > 1:
        nodes, levels = math.ceil(nodes / fan), levels + 1
    return levels


def _named(rows: DataFrame) -> DataFrame:
    """Places without nulls, and the records of one digest numbered within their file."""
    key = F.when(F.col("file").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("file").cast("string")))
    placed = rows.withColumns({"key": key, "place": F.coalesce("offset", F.lit(-1).cast("long"))})
    return placed.withColumn("copy", F.row_number().over(Window.partitionBy("key", "digest").orderBy("place")))


def _unmatched(side: DataFrame, other: DataFrame, stretch: int, fan: int) -> DataFrame:
    """Records that the other side lacks, with the matched record they follow and how far behind it they are."""
    there = other.select("key", "digest", "copy", F.lit(True).alias("there"))
    rows = side.join(there, ["key", "digest", "copy"], "left").withColumn("lost", F.when(F.col("there"), 0).otherwise(1).cast("long"))
    order, width = ["place", "digest", "copy"], stretch * fan
    rows = running(rows, ["key"], order, {"n": total(F.col("lost"))}, width)
    rows = running(rows, ["key"], order, {"after": last_seen(F.when(F.col("lost") == 0, F.struct("digest", "copy", "n")))}, width)
    behind = F.col("n") - F.coalesce("after.n", F.lit(0))
    return rows.where("lost = 1").select("key", "file", "offset", "digest", F.col("after.digest").alias("ahead"), F.col("after.copy").alias("ahead_copy"), behind.alias("behind"))


def audit(primary: DataFrame, replica: DataFrame, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """`file`, `offset`, `replica_offset`, `fault`, `primary_digest`, `replica_digest` of every record that differs.

    Both sides are tables of `leaves`. `fault` is `missing` (not in the replica),
    `extra` (only there) or `changed`: another record stands at its place behind
    the last record that both have. `offset` is the primary's, of an extra
    record the replica's. A record that only moved is no fault. Null files and
    offsets are places like any other; equal records of a file are matched in
    their order. Equal or empty replicas give no rows.
    """
    sides = [settle(x.select("file", F.col("offset").cast("long").alias("offset"), "digest"), "leaves") for x in (primary, replica)]
    levels = max(_height(x, stretch, fan) for x in sides)
    trees = [settle(tree(x, levels, stretch, fan), "nodes") for x in sides]

    def differing(level: int, under: DataFrame | None) -> DataFrame:
        a, b = (t.where(F.col("level") == level).select("file", "node", "digest") for t in trees)
        if under is not None:
            a, b = (x.join(under, x["file"].eqNullSafe(under["up_file"]) & (F.floor(x["node"] / fan) == under["up"]), "left_semi") for x in (a, b))
        b = b.select(F.col("file").alias("f"), F.col("node").alias("n"), F.col("digest").alias("d"))
        both = a.join(b, a["file"].eqNullSafe(b["f"]) & (a["node"] == b["n"]), "full_outer").where(~F.col("digest").eqNullSafe(F.col("d")))
        return both.select(F.coalesce("file", "f").alias("up_file"), F.coalesce("node", "n").alias("up"))

    bad = None
    for level in range(levels, -1, -1):
        bad = differing(level, bad)
    bad = settle(bad, "stretches")
    place = F.floor(F.coalesce("offset", F.lit(-1)) / stretch).cast("long")
    below = [x.withColumn("at", place).join(bad, F.col("file").eqNullSafe(bad["up_file"]) & (F.col("at") == bad["up"]), "left_semi").drop("at") for x in sides]
    a, b = (settle(_named(x), "records") for x in below)
    lost, new = _unmatched(a, b, stretch, fan), _unmatched(b, a, stretch, fan)
    new = new.select(*[F.col(c).alias(f"r_{c}") for c in new.columns])
    same = [lost[c].eqNullSafe(new[f"r_{c}"]) for c in ("key", "ahead", "ahead_copy", "behind")]
    both = lost.join(new, same, "full_outer")
    fault = F.when(F.col("r_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    offset = F.when(F.col("digest").isNull(), F.col("r_offset")).otherwise(F.col("offset"))
    return both.select(F.when(F.col("digest").isNull(), F.col("r_file")).otherwise(F.col("file")).alias("file"), offset.alias("offset"), F.col("r_offset").alias("replica_offset"), fault.alias("fault"), F.col("digest").alias("primary_digest"), F.col("r_digest").alias("replica_digest"))
