"""Leave-one-model-out: what the other models say against what a model says itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.reduce import consensus, half_even, percent_error, verdict, without_each
from meterloom.session import settle


def consensus_folds(points: DataFrame, constant: str, tolerance: float = 0.15, floor: float = 0.0) -> DataFrame:
    """Folds of a median-type constant. `points`: model, v. One row per model.

    Values are counted per model once. A rank among the other models' values is
    a rank among all values, moved by the model's own values that come before
    it (`without_each`), so no row is repeated and models are never listed.
    Points without a model have no fold and belong to all of them; a model
    without a value changes nothing when it is left out.
    """
    counts = settle(points.where("v is not null").groupBy("model", "v").agg(F.count(F.lit(1)).alias("w")), "counts")
    value = F.when(verdict(F.col("median"), F.col("lowest"), F.col("highest"), tolerance, floor) == "ok", half_even(F.col("median")))
    alone = consensus(points.where("model is not null"), ["model"], "v", tolerance, floor).select("model", value.alias("alone"))
    others = without_each(counts, "model", "v", "w").select("model", value.alias("without"))
    full = consensus(points, [], "v", tolerance, floor).select(F.lit(constant).alias("constant"), value.alias("full"))
    models = points.where("model is not null").groupBy("model").agg(F.count("v").alias("held"))
    sides = models.join(alone, "model", "left").join(others, "model", "left").withColumn("constant", F.lit(constant)).join(full, "constant", "left")
    return sides.select("constant", "model", "full", F.when(F.col("held") == 0, F.col("full")).otherwise(F.col("without")).alias("without"), "alone")


def max_folds(points: DataFrame, constant: str) -> DataFrame:
    """Folds of a maximum-type constant, from one partial per model: no replication."""
    per = points.groupBy("model").agg(F.max("v").alias("own"))
    # Only one row per model is left; the two largest of them decide every fold.
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("own"), "model")
    top = per.withColumn("r", F.row_number().over(order)).filter("r <= 2").agg(
        F.max(F.when(F.col("r") == 1, F.col("model"))).alias("m1"), F.max(F.when(F.col("r") == 1, F.col("own"))).alias("v1"), F.max(F.when(F.col("r") == 2, F.col("own"))).alias("v2")
    ).withColumn("constant", F.lit(constant))
    joined = per.withColumn("constant", F.lit(constant)).join(top, "constant")
    without = F.when(F.col("model") == F.col("m1"), F.col("v2")).otherwise(F.col("v1"))
    return joined.select("constant", "model", half_even(F.col("v1")).alias("full"), half_even(without).alias("without"), half_even(F.col("own")).alias("alone"))


def with_error(folds: DataFrame) -> DataFrame:
    """Generalisation error in percent; null where a side is missing or the base is zero."""
    return folds.withColumn("error_pct", percent_error(F.col("without").cast("double"), F.col("alone").cast("double")))


def report(folds: DataFrame) -> DataFrame:
    """Per constant: evaluated folds, the worst of them, and the models it cannot be fitted without.

    One row per (constant, model) comes in, so the list is bounded by the models.
    """
    rows = with_error(folds)
    size = F.when(F.col("error_pct").isNotNull(), F.struct(F.abs("error_pct").alias("e"), F.col("model").alias("m")))
    bearing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("without").isNull(), F.col("model")))), ", ")
    return rows.groupBy("constant").agg(
        F.max("full").alias("full"), F.count("error_pct").alias("evaluated"), F.max_by("model", size).alias("worst_model"),
        F.max_by("error_pct", size).alias("worst_pct"), bearing.alias("load_bearing"),
    ).withColumn("evaluable", F.col("evaluated") > 0)
