"""How far sources of one language differ in the words they use.

A table of 256 bytes lowers A-Z and blanks every other ASCII sign in one pass,
`bytes.split` gives the terms (ASCII letters and everything beyond ASCII), and a
`Counter` per document gives how often each occurs. A task adds its documents up
per source before anything is shuffled.

Sources are compared on the terms a language keeps. Most sources hold few of
them, so nothing dense is built: a term that neither of two sources holds adds
the same amount for every such term, a term that one of them holds depends on
the other's size alone, and only shared terms meet. Terms are cut into blocks,
and a block gives one number per pair of sources.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.session import settle

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Bytes of a text split at once; terms a task holds before it hands them on.
SLICE, HELD = 1 << 22, 200_000
#: Entries (source, term) of a block, at least; sources that meet in one piece.
BLOCK, TILE = 8_192, 1_024

#: Lower letters stay, A-Z are lowered, bytes beyond ASCII stay, all others become blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text."""
    plain = text.translate(TABLE)
    counts, at = Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


def counted(docs: DataFrame, text_col: str, group_col: str, source_col: str, held: int = HELD) -> DataFrame:
    """(`lang`, `source`, `term`, `n` occurrences, `docs` rows that hold it), summed over all rows."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    slim = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"), name(group_col).alias("lang"), name(source_col).alias("source"))

    def run(batches):
        seen: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k in range(batch.num_rows):
                text = batch.column(0)[k].as_py()
                if not text:
                    continue
                counts = term_counts(text)
                total, rows = seen[langs[k], sources[k]]
                size -= len(rows)
                total.update(counts)
                rows.update(counts.keys())
                size += len(rows)
                if size > held:
                    yield from _batches(seen)
                    seen.clear()
                    size = 0
        yield from _batches(seen)

    parts = slim.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    summed = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.withColumn("term", F.col("term").cast("string"))


def _batches(seen: dict):
    for (lang, source), (total, rows) in seen.items():
        n = len(total)
        terms = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()), pa.array([total[t] for t in terms], pa.int64()), pa.array([rows[t] for t in terms], pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )


def _share(count: str, of: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (of + 2 * terms)), exact; null without terms."""
    return F.expr(f"if({terms} > 0, 1 + (cast({SCALE} as decimal(19,0)) * cast({count} + 2 as decimal(19,0))) div cast({of} + 2 * {terms} as decimal(19,0)), null)").cast("long")


def _apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of shares, which stay below 2^31."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def block_sums(slot: np.ndarray, base: np.ndarray, own: np.ndarray, term: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For sources `slot` with share `base` of a term they lack, and entries (index `own`, `term`, share `p`):
    how much these entries add to each pair of sources beyond the amount of a term that both lack."""
    n = len(slot)
    both_lack = _far(base[:, None], base[None, :])
    out = np.zeros((n, n), np.int64)
    one = np.zeros((n, n), np.int64)
    dense = np.zeros(int(term.max()) + 1 if len(term) else 0, np.int64)
    order = np.argsort(own, kind="stable")
    own, term, p = own[order], term[order], p[order]
    begin = np.searchsorted(own, np.arange(n + 1))
    for i in range(n):
        here = slice(begin[i], begin[i + 1])
        if begin[i] == begin[i + 1]:
            continue
        value, times = np.unique(p[here], return_counts=True)
        one[i] = times @ (_far(value[:, None], base[None, :]) - both_lack[i])
        dense[term[here]] = p[here]
        rest = slice(begin[i + 1], None)
        x = dense[term[rest]]
        some = np.flatnonzero(x)
        x, j, y = x[some], own[rest][some], p[rest][some]
        np.add.at(out[i], j, _far(x, y) - _far(x, base[j]) - _far(base[i], y) + both_lack[i, j])
        dense[term[here]] = 0
    return out + one + one.T


def _pair_sums(entries: DataFrame, facts: DataFrame, block: int, tile: int) -> DataFrame:
    """(`lang`, `x`, `y`, `more`), x < y: what the entries of both sources add to the pair."""
    per_lang = facts.groupBy("lang").agg(F.sum("held").alias("held"), F.count(F.lit(1)).alias("sources"))
    # A block holds as many entries as it may give pairs, so blocks don't blow the data up.
    room = F.greatest(F.lit(block), F.pow(F.least("sources", F.lit(tile)), 2))
    plan = per_lang.where("held > 0").select("lang", F.greatest(F.ceil(F.col("held") / room), F.lit(1)).cast("long").alias("parts"), F.ceil(F.col("sources") / tile).cast("long").alias("tiles"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    side = F.floor(F.col("slot") / tile)

    def dealt(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("o", F.explode(upto("tiles")))
        return met.select("lang", "part", F.least(side, "o").alias("a"), F.greatest(side, "o").alias("b"), "slot", "base", "term", "p")

    heads = facts.join(plan, "lang").withColumn("part", F.explode(upto("parts"))).withColumns({"term": F.lit(None).cast("string"), "p": F.lit(None).cast("long")})
    rows = entries.join(plan, "lang").withColumn("part", F.pmod(F.xxhash64("term"), "parts"))
    met = dealt(heads).unionByName(dealt(rows))

    def compare(part: pa.Table) -> pa.Table:
        head = part.filter(pc.is_null(part.column("term")))
        body = part.filter(pc.is_valid(part.column("term")))
        slot, first = np.unique(head.column("slot").to_numpy(), return_index=True)
        base = head.column("base").to_numpy()[first]
        own = np.searchsorted(slot, body.column("slot").to_numpy())
        term = body.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        sums = block_sums(slot, base, own, term, body.column("p").to_numpy())
        a, b = part.column("a")[0].as_py(), part.column("b")[0].as_py()
        x, y = np.nonzero(np.triu(sums, 1))
        some = (slot[x] // tile == a) & (slot[y] // tile == b)
        x, y = x[some], y[some]
        return pa.table({"lang": pa.array([part.column("lang")[0].as_py()] * len(x), pa.string()), "x": pa.array(slot[x], pa.int64()), "y": pa.array(slot[y], pa.int64()), "more": pa.array(sums[x, y], pa.int64())})

    found = met.groupBy("lang", "part", "a", "b").applyInArrow(compare, "lang string, x long, y long, more long")
    return found.groupBy("lang", "x", "y").agg(F.sum("more").alias("more"))


def _pairs(facts: DataFrame, tile: int) -> DataFrame:
    """Every source with every other one of its language; a language with many sources is dealt out in tiles."""
    tiles = facts.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("tiles"))
    side = F.floor(F.col("slot") / tile)
    spread = facts.join(tiles, "lang").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    left = spread.select("lang", side.alias("a"), F.col("o").alias("b"), "source", "slot", "base", "terms")
    right = spread.select("lang", F.col("o").alias("a"), side.alias("b"), F.col("source").alias("item"), F.col("slot").alias("slot2"), F.col("base").alias("base2"))
    return left.join(right, ["lang", "a", "b"]).where("slot <> slot2")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, text_col: str = "text", group_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank`: how far a source is from the others of its language, and by which terms.

    A language keeps the terms that at least `min_docs` of its rows hold. Part
    `pair` has every other source of the language with the summed distance over
    all kept terms; part `term` has the `top` terms that the source uses more
    than its language does. Null texts, languages and sources count as empty;
    a source without terms is compared all the same, and a language that keeps
    no term has distance 0 between its sources and no `term` rows. Repeated rows
    count each; ties are ordered by item. Other columns are not read. An empty
    table gives no rows.
    """
    counts = settle(counted(docs, text_col, group_col, source_col), "term-counts")
    kept = settle(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    entries = settle(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")

    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    groups = docs.select(name(group_col).alias("lang"), name(source_col).alias("source")).distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    known = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "held", "terms", "lang_total"])
    slot = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    facts = settle(known.withColumn("slot", slot).withColumn("base", _share("0", "total", "terms")), "sources")

    shares = entries.join(facts, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))
    pairs = _pairs(facts, tile).withColumns({"x": F.least("slot", "slot2"), "y": F.greatest("slot", "slot2")})
    sums = _pair_sums(shares.select("lang", "term", "slot", "base", "p"), facts.select("lang", "slot", "base", "held"), block, tile)
    value = F.when(F.col("terms") > 0, F.coalesce("more", F.lit(0)) + F.col("terms") * _apart("base", "base2")).otherwise(F.lit(0)).cast("long")
    pair_rows = pairs.join(sums, ["lang", "x", "y"], "left").select("lang", "source", "item", value.alias("value"))
    higher = shares.withColumn("q", _share("lang_n", "lang_total", "terms")).where("p > q")
    term_rows = higher.select("lang", "source", F.col("term").alias("item"), _apart("p", "q").cast("long").alias("value"))
    return _ranked(pair_rows, "pair").unionByName(_ranked(term_rows, "term").where(F.col("rank") <= top))
