"""Prediction against measurement: listings, scoreboards and group order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions import records as R
from meterloom.functions.reduce import percent_error
from meterloom.operators import hygiene as H

TOLERANCE_PCT = 5.0


def validation_report(records: DataFrame, predictions: DataFrame, skip: H.Reasons) -> DataFrame:
    """Each comparable configuration once, beside its prediction.

    `skip` lists why a record is left out. `predictions`: cell, predicted_mib, cards_placed. A prediction placed on a
    different number of cards than measured is not comparable.
    """
    comparable = records.filter(H.first_reason(skip).isNull())
    rows = comparable.select(
        *[R.factor(c).alias(c) for c in R.CONFIGURATION], "cell", "pos", R.factor("label").alias("label"), R.parsed("arch").alias("arch"),
        R.gpu_used().alias("measured_mib"), R.cards_measured().alias("cards_measured"),
    )
    once = H.first_per_configuration(rows, R.CONFIGURATION, "pos")
    joined = once.join(predictions.filter(F.col("predicted_mib") > 0), "cell")
    same_cards = (F.col("cards_measured") == 0) | (F.col("cards_measured") == F.col("cards_placed"))
    drift = percent_error(F.col("predicted_mib").cast("double"), F.col("measured_mib").cast("double"))
    return joined.filter(same_cards).select("label", "arch", "predicted_mib", "measured_mib", drift.alias("drift_pct"))


def scoreboard(records: DataFrame, predictions: DataFrame, labels: list[str], tolerance: float = TOLERANCE_PCT) -> DataFrame:
    """Every listed label with its latest reading and prediction; gaps are shown, not dropped."""
    spark = records.sparkSession
    listed = spark.createDataFrame([(label,) for label in labels], "label string")
    latest = H.production_readings(records, labels).select("label", F.col("used").alias("measured_mib"))
    joined = listed.join(latest, "label", "left").join(predictions.select("label", "predicted_mib"), "label", "left")
    drift = percent_error(F.col("predicted_mib").cast("double"), F.col("measured_mib").cast("double"))
    state = F.when(drift.isNull(), "missing").when(F.abs(drift) <= tolerance, "ok").otherwise("outside")
    return joined.select("label", "predicted_mib", "measured_mib", F.round(drift, 6).alias("drift_pct"), state.alias("state"))


def group_order(rows: DataFrame) -> DataFrame:
    """Groups by row count, largest first, then by key."""
    keys = ["runtime", "split", "arch", "variant"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *[F.asc_nulls_first(k) for k in keys])


def entry_order(entries: DataFrame) -> DataFrame:
    """Fitted entries with the variant-guarded ones first."""
    return entries.orderBy(F.col("variant").isNull(), "arch", "split")
