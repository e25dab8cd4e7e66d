"""Samples with given category shares.

Each category gets an acceptance probability from its target and its observed size, a little above what is needed;
records are accepted independently by a hash of their id; the counts are then corrected exactly, down by dropping the
largest hashes, up by taking the next ones. The correction ranks only the hash range in which the cut falls; there are
more ranges the more rows a category has, so it may hold any share of the rows. What was taken is counted in the sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import hash52
from tagloom.operators.skew import join_unique
from tagloom.plans.storage import stage

SPACE = float(1 << 52)
#: Rows of one hash range, about: the number of ranges follows from it.
RANGE_ROWS = 50_000


def proportional_sample(records: DataFrame, targets: DataFrame, id_col: str, cells: list[str], *, share_bp: str = "target_bp",
                        min_rows: str = "min_rows", one_in: int = 10, seed: str = "s", oversample: float = 1.1,
                        ranges: int = 256) -> tuple[DataFrame, DataFrame]:
    """The sample (id, cells...) and the report (cells..., wanted, supply, taken, deficit), one row per target.

    A sample of floor(distinct ids / one_in) records; a category is asked for max(min_rows, ceil(share * sample)). It
    gets min(wanted, supply) records (``taken``, counted in the sample): those with the smallest (hash, id). ``supply`` counts distinct ids with all
    category columns known; an id delivered several times counts once, an id delivered under several categories once
    in each. Null ids and rows with a null category are in no category; categories without a target are not drawn;
    targets without records are reported with supply 0. Targets must be distinct; a null share or minimum reads as 0.
    Other columns are ignored.
    """
    known = F.col("id").isNotNull()
    all_ids = records.select(F.col(id_col).alias("id"), *cells)
    size = all_ids.where(known).agg(F.count_distinct("id")).first()[0] // one_in
    for c in cells:
        known = known & F.col(c).isNotNull()
    drawn = stage(all_ids.where(known).distinct().withColumn("u", hash52(seed, F.col("id"))), "cells")

    wanted = targets.select(*cells, F.greatest(
        F.coalesce(F.col(min_rows).cast("bigint"), F.lit(0)),
        F.expr(f"(coalesce(cast({share_bp} as bigint), 0) * {size} + 9999) div 10000")).alias("wanted"))
    supply = drawn.groupBy(*cells).agg(F.count("*").alias("supply"))
    asked = (
        wanted.join(supply, cells, "left")
        .withColumn("supply", F.coalesce("supply", F.lit(0)))
        .withColumn("need", F.least("wanted", "supply"))
        # four standard deviations of a Poisson count on top of the factor: a second look is the exception
        .withColumn("p", F.least(F.lit(1.0), F.try_divide(F.col("need") * oversample + 4 * F.sqrt("need"), F.col("supply"))))
        .withColumn("inner", F.greatest(F.lit(ranges), F.expr(f"need div {RANGE_ROWS}")))
        .withColumn("outer", F.greatest(F.lit(ranges), F.expr(f"supply div {RANGE_ROWS}")))
    )
    asked = stage(asked, "asked")

    edge = F.col("p") * SPACE
    accepted = F.col("u") < edge
    inside = F.least(F.floor(F.col("u") / edge * F.col("inner")), F.col("inner") - 1)
    beyond = F.col("inner") + F.least(F.floor((F.col("u") - edge) / (SPACE - edge + 1) * F.col("outer")), F.col("outer") - 1)
    # a category may hold any share of the records
    placed = join_unique(drawn, asked.where("need > 0").select(*cells, "need", "p", "inner", "outer"), cells).select(
        "id", *cells, "u", "need", F.when(accepted, inside).otherwise(beyond).alias("bin"))
    upto = Window.partitionBy(*cells).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranged = (
        placed.groupBy(*cells, "bin").agg(F.count("*").alias("rows"), F.max("need").alias("need"))
        .withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
        .where(F.col("before") < F.col("need"))
        .select(*cells, "bin", "before", "rows")
    )
    near = placed.join(ranged, [*cells, "bin"])
    whole = near.where(F.col("before") + F.col("rows") <= F.col("need"))
    order = Window.partitionBy(*cells).orderBy("u", "id")
    cut = (
        near.where(F.col("before") + F.col("rows") > F.col("need"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("before") + F.col("rank") <= F.col("need"))
    )
    sample = stage(whole.select("id", *cells).unionByName(cut.select("id", *cells)), "sample")
    taken = sample.groupBy(*cells).agg(F.count("*").alias("taken"))
    report = asked.join(taken, cells, "left").withColumn("taken", F.coalesce("taken", F.lit(0))).select(
        *cells, "wanted", "supply", "taken", (F.col("wanted") - F.col("taken")).alias("deficit"))
    return sample, report
