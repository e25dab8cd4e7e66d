"""Choice of checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(checkpoints: DataFrame) -> DataFrame:
    """(run, step): the saved steps nearest to a third, two thirds and all of each run's last step; ties go low."""
    last = checkpoints.groupBy("run").agg(F.max("step").alias("last"))
    part = lambda k: F.bround(F.col("last") * k / 3).cast("bigint")
    wanted = last.select("run", F.explode(F.array(part(1), part(2), F.col("last"))).alias("t"))
    near = checkpoints.select("run", "step").join(wanted, "run").groupBy("run", "t").agg(
        F.min_by("step", F.struct(F.abs(F.col("step") - F.col("t")), "step")).alias("step"))
    return near.select("run", "step").distinct()


def best(checkpoints: DataFrame) -> DataFrame:
    """(run, step, dev_f1) of the highest score; ties go to the earliest step, steps without a score are ignored."""
    scored = checkpoints.where(F.col("dev_f1").isNotNull() & ~F.isnan("dev_f1"))
    return scored.groupBy("run").agg(F.max_by("step", F.struct("dev_f1", -F.col("step"))).alias("step"), F.max("dev_f1").alias("dev_f1"))


def latest(checkpoints: DataFrame, complete: str) -> DataFrame:
    """(run, step): the last step marked complete."""
    return checkpoints.where(F.col(complete)).groupBy("run").agg(F.max("step").alias("step"))


def last_result(results: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys..., path): the result that sorts last by its path, of each group; null paths are no results."""
    return results.where(F.col(path).isNotNull()).groupBy(*keys).agg(F.max(path).alias(path))
