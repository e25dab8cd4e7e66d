"""Benchmark scores before and after tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_available(metrics: Column, keys: list[str]) -> Column:
    """The first of ``keys`` that the metric map has a value for; null if none."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(k)) for k in keys])


def long_scores(results: DataFrame, family: str, keys: list[str]) -> DataFrame:
    """(keys..., bench, score): benchmark maps flattened and merged; of several families the last by name wins."""
    flat = results.select(*keys, F.col(family).alias("__f"), F.explode("scores").alias("bench", "score")).distinct()
    return flat.groupBy(*keys, "bench").agg(F.max_by("score", F.struct("__f", F.coalesce("score", F.lit(-1.0)))).alias("score"))


def deltas(scores: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """Scores with ``base_score`` and ``delta_pp``; null where either is missing."""
    b = base.select(*on, F.col("score").alias("base_score"))
    return scores.join(b, on, "left").withColumn("delta_pp", (F.col("score") - F.col("base_score")) * 100)


def band(delta: Column) -> Column:
    """Reading of a difference in percentage points."""
    return F.when(delta.isNull(), "N/A").when(F.abs(delta) < 1, "negligible").when(F.abs(delta) < 3, "moderate").otherwise("SIGNIFICANT")


def seed_summary(delta: DataFrame, probes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mean delta by (method, bench); and by method the mean and sample deviation over seeds of the mean without probes."""
    by_bench = delta.groupBy("method", "bench").agg(F.avg("delta_pp").alias("mean_delta"), F.count("delta_pp").alias("seeds"))
    per_seed = delta.where(~F.col("bench").isin(probes)).groupBy("method", "seed").agg(F.avg("delta_pp").alias("m"))
    overall = per_seed.groupBy("method").agg(F.avg("m").alias("mean_delta"), F.stddev_samp("m").alias("std_delta"), F.count("m").alias("seeds"))
    return by_bench, overall
