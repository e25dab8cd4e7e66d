"""Span tables: by array functions for documents of usual length, by windows for tag tables of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import bio


def explode_spans(df: DataFrame, keys: list[str], tags: str, strict: bool = True) -> DataFrame:
    """(keys..., etype, s, e), one row per span."""
    return df.select(*keys, F.explode(bio.spans(F.col(tags), strict)).alias("x")).select(*keys, "x.etype", "x.s", "x.e")


def window_spans(tags: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """The same from a table (keys..., pos, tag): positions need not fit into one array."""
    order = Window.partitionBy(*keys).orderBy("pos")
    before = F.lag("tag").over(order)
    typed = F.col("tag").startswith("B-") | F.col("tag").startswith("I-")
    goes_on = F.col("tag").startswith("I-") & (before.startswith("B-") | before.startswith("I-")) & (bio.etype(F.col("tag")) == bio.etype(before))
    run = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = (
        tags.withColumn("__run", run).where(typed).groupBy(*keys, "__run")
        .agg(F.min_by("tag", "pos").alias("__first"), F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"))
    )
    if strict:
        found = found.where(F.col("__first").startswith("B-"))
    return found.select(*keys, bio.etype(F.col("__first")).alias("etype"), "s", "e")
