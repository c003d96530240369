"""What the operators share: bounded batches of text, bounded samples, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters (bytes) worked on at once in a task; a longer text makes a piece of its own.
PIECE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns whose names an operator is about to write are replaced."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def pieces(lengths: list[int], bound: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most `bound` characters, or one row."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > bound:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def sizes(texts: pa.Array) -> list[int]:
    """Bytes of each text, 0 for null, without making Python strings of them."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def map_text(df: DataFrame, text_col: str, outputs: T.StructType, work: Callable[[list[str | None]], list], bound: int = PIECE_CHARS) -> DataFrame:
    """Add columns computed from whole texts, a bounded piece of rows at a time.

    `work` gets the texts of a piece and returns one list or Arrow array per
    output. Columns of the outputs' names are replaced, all others pass through.
    Empty tables give empty results.
    """
    rows = df.select(text_col, *[F.col(f"`{c}`") for c in without(df, [*outputs.names, text_col]).columns])
    keep_text = text_col not in outputs.names
    kept = rows.schema.fields if keep_text else rows.schema.fields[1:]
    schema = T.StructType([*kept, *outputs.fields])
    names, first = schema.names, 0 if keep_text else 1

    def run(batches):
        types = None
        for batch in batches:
            for a, b in pieces(sizes(batch.column(0)), bound):
                texts = batch.column(0).slice(a, b - a).to_pylist()
                types = types or [arrow_type(f.dataType) for f in outputs.fields]
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(work(texts), types)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[first:], *made], names=names)

    return rows.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of an id's text, modulo `folds`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def bounded(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most `rows` rows, chosen by a hash of `keys`: the same ones each time.

    Rows under a hash threshold set from the row count are taken, so what meets
    in one place is about `rows` keys, whatever the size of the table.
    """
    spread = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    total = df.count()
    cut = (1 << 40) if total <= rows else int((1 << 40) * rows / total)
    return df.where(spread < cut).orderBy(spread, *keys).limit(rows)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, … of every range, one range after another."""
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if not len(out):
        return out
    some = lengths > 0
    starts, lengths, ends = starts[some], lengths[some], ends[some]
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)
