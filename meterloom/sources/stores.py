"""Reading and writing the tables and documents the library works on."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions import scan
from meterloom.session import discard, folders, remove, settle

# --- telemetry tables ------------------------------------------------------

_LONG, _TEXT = T.LongType(), T.StringType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name.rstrip("_"), kind) for name, kind in columns.items()])


REQUEST_METRICS = _schema(
    metric_id=_LONG, service_id=_LONG, run_id=_LONG, timestamp_ms=_LONG, endpoint=_TEXT, model=_TEXT, prompt_tokens=_LONG, completion_tokens=_LONG,
    prompt_eval_tokens=_LONG, duration_ms=_LONG, ttft_ms=_LONG, prompt_ms=_LONG, predicted_ms=_LONG, draft_tokens=_LONG, draft_tokens_accepted=_LONG, status_code=_LONG,
)
DEVICE_SAMPLES = _schema(sample_id=_LONG, device=_TEXT, timestamp_ms=_LONG, total_bytes=_LONG, free_bytes=_LONG, used_bytes=_LONG)
SERVICE_LOGS = _schema(service_id=_LONG, run_id=_LONG, timestamp_ms=_LONG, seq=_LONG, stream=_TEXT, line=_TEXT)
EVENT_FEED = _schema(
    type=_TEXT, service=_TEXT, from_=_TEXT, to=_TEXT, reservations=T.MapType(_TEXT, _LONG), changed_services=T.ArrayType(_TEXT), class_=_TEXT,
    rolling_mean=T.FloatType(), trigger=_TEXT, detail=_TEXT, at_ms=_LONG,
)


def dated(df: DataFrame, stamp: str) -> DataFrame:
    return df.withColumn("dt", F.to_date(F.timestamp_millis(F.col(stamp))))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append request metrics, partitioned by day so windows prune and retention drops folders.

    A rebalance before the write splits large days and joins small ones, so the
    number of writers follows a day's size.
    """
    rows = dated(metrics.select(*REQUEST_METRICS.fieldNames()), "timestamp_ms")
    rows.hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*REQUEST_METRICS.fields, T.StructField("dt", T.DateType())])).parquet(path)


def append_device_samples(samples: DataFrame, path: str) -> None:
    """Append samples with `used = total - free`, partitioned by day like the request metrics."""
    used = samples.withColumn("used_bytes", F.col("total_bytes") - F.col("free_bytes")).select(*DEVICE_SAMPLES.fieldNames())
    dated(used, "timestamp_ms").hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def read_device_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*DEVICE_SAMPLES.fields, T.StructField("dt", T.DateType())])).parquet(path)


def prune_days(spark: SparkSession, path: str, cutoff_ms: int) -> list[str]:
    """Drop the rows of a dated table that are older than the cutoff; the names of the days that went.

    Whole old days are removed by folder and never read. Of the day that holds
    the cutoff only the newer rows are kept: they are written beside the table
    first and then take the day's place, so an interrupted run leaves either
    the old or the new day, and a repeated one does no harm.
    """
    day = f"dt={datetime.fromtimestamp(cutoff_ms / 1000, timezone.utc):%Y-%m-%d}"
    days = [f for f in folders(spark, path) if f.startswith("dt=")]
    old = [d for d in days if d < day]
    if day in days:
        table = spark.read.option("basePath", path).parquet(f"{path}/{day}")
        kept = settle(table.where(F.col("timestamp_ms") >= cutoff_ms), "kept-day")
        if kept.isEmpty():
            old.append(day)
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
        discard(kept)
    for d in old:
        remove(spark, f"{path}/{d}")
    return old


def sequence_logs(lines: DataFrame, known: DataFrame | None, order: list[str], width: int = scan.CHUNK_MS) -> DataFrame:
    """Number new lines per (service, run), going on after the numbers already stored.

    The stored side is one aggregated row per run. Numbering is chunked, so a
    run that writes most of the lines is spread like any other.
    """
    keys = ["service_id", "run_id"]
    numbered = scan.running(lines, keys, order, {"seq": scan.count()}, width)
    if known is None:
        return numbered.withColumn("seq", F.col("seq") - 1)
    last = known.groupBy(*keys).agg((F.max("seq") + 1).alias("__next"))
    return numbered.join(last, keys, "left").withColumn("seq", F.col("seq") - 1 + F.coalesce("__next", F.lit(0))).drop("__next")


# --- measurement records ---------------------------------------------------


class BadRecord(ValueError):
    """A dataset line that cannot be read, by file and line."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and their place in it (order of blocks, then of lines)."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _nested(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _nested(kind.elementType)
    if isinstance(kind, T.MapType):
        return _nested(kind.valueType)
    return isinstance(kind, T.StructType)


def _unknown(text: Column, kind: T.DataType, at: str = "") -> Column:
    """Paths of the fields in a JSON text that the schema does not name, at any depth: in structs, list elements and map values."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        known = F.array(*[F.lit(n) for n in kind.fieldNames()]).cast("array<string>")

        def walk(fields: Column) -> Column:
            keys = F.coalesce(F.map_keys(fields), none)
            found = [F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit(at), k))]
            found += [_unknown(F.element_at(fields, f.name), f.dataType, f"{at}{f.name}.") for f in kind.fields if _nested(f.dataType)]
            return F.flatten(F.array(*found)) if len(found) > 1 else found[0]

        # Bound once: every use of an expression outside a lambda would parse the text again.
        return F.transform(F.array(F.from_json(text, "map<string,string>")), walk)[0]
    if isinstance(kind, T.ArrayType):
        each = F.from_json(text, "array<string>")
        return F.coalesce(F.flatten(F.transform(each, lambda e: _unknown(e, kind.elementType, f"{at[:-1]}[]."))), none)
    if isinstance(kind, T.MapType):
        each = F.map_values(F.from_json(text, "map<string,string>"))
        return F.coalesce(F.flatten(F.transform(each, lambda e: _unknown(e, kind.valueType, f"{at[:-1]}{{}}."))), none)
    return none


def read_ndjson_checked(spark: SparkSession, path: str, schema: T.StructType, cell: str = "cell") -> DataFrame:
    """Records with an `error` column: null, or why the line is refused. Blank lines are skipped."""
    rows = _lines(spark, path).filter(F.trim("value") != "")
    probe = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    parsed = rows.withColumn("r", F.from_json("value", probe, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    unknown = F.array_distinct(_unknown(F.col("value"), schema))
    error = (
        F.when(F.col("r.__corrupt").isNotNull() | F.col("r").isNull(), F.lit("not a record"))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(unknown, ", ")))
        .when(F.trim(F.coalesce(F.col(f"r.{cell}"), F.lit(""))) == "", F.lit("blank cell id"))
    )
    return parsed.select("file", "block", "row", "value", *[F.col(f"r.{n}").alias(n) for n in schema.fieldNames()], error.alias("error"))


def read_ndjson_strict(spark: SparkSession, path: str, schema: T.StructType, cell: str = "cell") -> DataFrame:
    """Every line must be a record of this schema and name no other field at any depth; the first bad one is named by file and line."""
    checked = read_ndjson_checked(spark, path, schema, cell)
    place = F.struct("file", "block", "row")
    bad = checked.filter(F.col("error").isNotNull()).agg(F.min_by(F.struct("file", "block", "row", "error", F.substring("value", 1, 80).alias("start")), place).alias("b")).first()["b"]
    if bad is not None:
        before = _lines(spark, path).where((F.col("file") == bad["file"]) & ((F.col("block") < bad["block"]) | ((F.col("block") == bad["block"]) & (F.col("row") < bad["row"]))))
        raise BadRecord(f"{bad['file']}:{before.count() + 1}: {bad['error']}: {bad['start']}")
    return checked.select(*schema.fieldNames())


def read_ndjson_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Drop lines that do not parse, such as the torn tail of a file still being written."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_ndjson(records: DataFrame, path: str, compression: str = "none", per_file: int = 0) -> None:
    """One object per line, keys in schema order, non-ASCII characters escaped; `per_file` records to a file at most (0: no bound).

    A compressed file is read by one task, so a compression asks for a bound.
    """
    if compression != "none" and per_file <= 0:
        raise ValueError("compressed files need a bound on their records")
    text = F.to_json(F.struct(*records.columns), {"writeNonAsciiCharacterAsCodePoint": "true"})
    records.select(text.alias("value")).write.option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def read_log_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Archived logs, one row per file; gzip by extension, bad bytes replaced."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log"), F.col("value").alias("text"))


def read_drift_csv(spark: SparkSession, path: str) -> DataFrame:
    """Drift files with a header; a number that does not parse reads as zero."""
    raw = spark.read.option("header", True).schema("service string, architecture string, context string, predicted_total_mib string, actual_post_chat_total_mib string").csv(path)
    whole = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long"))
    return raw.select("service", "architecture", whole("context").alias("context"), whole("predicted_total_mib").alias("predicted"), whole("actual_post_chat_total_mib").alias("actual"))


# --- rate documents --------------------------------------------------------


def write_rates(rates: DataFrame, default: int, path: str) -> None:
    """A rate table as one JSON document: `{"by_key": {...}, "default": n}`.

    The table is a constants document (one entry per architecture-sized key).
    """
    entries = rates.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("by_key"))
    entries.select(F.to_json(F.struct("by_key", F.lit(default).cast("long").alias("default"))).alias("value")).coalesce(1).write.text(path)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Long form of a rate document: key, value, is_default (one row with a null key)."""
    doc = spark.read.schema("by_key map<string,bigint>, `default` bigint").json(path)
    listed = doc.select(F.explode(F.map_entries("by_key")).alias("e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("value"), F.lit(False).alias("is_default"))
    rest = doc.select(F.lit(None).cast("string").alias("key"), F.col("default").alias("value"), F.lit(True).alias("is_default"))
    return listed.unionByName(rest)


def read_event_feed(spark: SparkSession, path: str) -> DataFrame:
    """The tagged event feed as a stream of one wide row type."""
    return spark.readStream.schema(EVENT_FEED).json(path)
