"""Joins to a table of unique keys of which a few may be very frequent on the other side."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], share: int = 2000, how: str = "inner") -> DataFrame:
    """Join (``how``: inner or left) of ``left`` to ``right``, whose ``keys`` are unique, with any number of ``left`` rows under one key.

    Keys are counted first, with map-side aggregation. A key that holds more than 1/``share`` of all rows is hot; there
    are at most ``share`` of them, so their rows of ``right`` are broadcast and their rows of ``left`` stay where they
    are. Only the rest is shuffled by key. Null keys join nothing; a left join keeps their rows, with nulls and without
    a shuffle. ``left`` is read again for each part: it should be a scan, such as a staged table.
    """
    some = left.dropna(subset=keys)
    counted = some.groupBy(*keys).agg(F.count("*").alias("__rows"))
    total, most = counted.agg(F.coalesce(F.sum("__rows"), F.lit(0)), F.coalesce(F.max("__rows"), F.lit(0))).first()
    if most * share <= total or total <= share:
        joined = some.join(right, keys, how)
    else:
        hot = F.broadcast(counted.where(F.col("__rows") * share > total).select(*keys))
        hot_right = F.broadcast(right.join(hot, keys, "left_semi"))
        few = (some.join(hot, keys, "left_semi") if how == "left" else some).join(hot_right, keys, how)
        joined = few.unionByName(some.join(hot, keys, "left_anti").join(right, keys, how))
    if how != "left":
        return joined
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name not in keys]
    alone = left.where(~reduce(and_, [F.col(k).isNotNull() for k in keys]))
    return joined.unionByName(alone.select("*", *lacking))
