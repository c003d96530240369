"""Column builders over telemetry rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_MS = {"10s": 10_000, "1m": 60_000, "5m": 300_000, "30m": 1_800_000, "2h": 7_200_000}
_UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration_ms(text: str) -> int:
    """`"5m"` as milliseconds."""
    for unit in sorted(_UNITS, key=len, reverse=True):
        number = text[: -len(unit)]
        if text.endswith(unit) and number.isdigit():
            return int(number) * _UNITS[unit]
    raise ValueError(f"not a duration: {text!r}")


def bucket_for_span(span_ms: int) -> str:
    """The bucket that keeps a chart of this span at a readable point count."""
    for limit, bucket in ((300_000, "10s"), (3_600_000, "1m"), (21_600_000, "5m"), (86_400_000, "30m")):
        if span_ms <= limit:
            return bucket
    return "2h"


def time_bucket(stamp: str, width_ms: int) -> Column:
    """Start of the epoch-aligned bucket, on whole numbers (truncating)."""
    return F.expr(f"(`{stamp}` div {int(width_ms)}) * {int(width_ms)}")


def decode_ms() -> Column:
    """Engine decode time, else the window from first token to completion."""
    return F.coalesce(F.col("predicted_ms"), F.col("duration_ms") - F.col("ttft_ms"))


def prefill_ms() -> Column:
    return F.coalesce(F.col("prompt_ms"), F.col("ttft_ms"))


def tokens_per_second(tokens: Column, ms: Column) -> Column:
    """A rate only where time passed and tokens came out; otherwise null, not zero."""
    return F.when((ms > 0) & (tokens > 0), tokens / (ms / F.lit(1000.0)))


def completion_time() -> Column:
    return F.col("timestamp_ms") + F.coalesce(F.col("duration_ms"), F.lit(0))


def within(stamp: str, since: int | None, until: int | None) -> Column:
    """Inclusive window; an open side adds no predicate, so pushdown stays simple."""
    condition = F.lit(True)
    if since is not None:
        condition = F.col(stamp) >= F.lit(since)
    if until is not None:
        upper = F.col(stamp) <= F.lit(until)
        condition = upper if since is None else condition & upper
    return condition
