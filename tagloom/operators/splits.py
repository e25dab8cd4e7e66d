"""Stratified splits that keep equal texts together, and their statistics."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import hash52
from tagloom.operators.ranking import running
from tagloom.operators.skew import join_unique
from tagloom.plans.storage import stage

SPLITS = ("train", "dev", "test")


def body_hash(tokens: Column) -> Column:
    """MD5 of the space-joined tokens: equal for equal surfaces, whatever their tags."""
    return F.md5(F.array_join(tokens, " "))


def stratified_split(docs: DataFrame, stratum: str, digest: str, *, seed: int = 42, dev: float = 0.15, test: float = 0.15,
                     bits: int | None = None) -> DataFrame:
    """``docs`` with a column ``split``: in each stratum, groups of equal ``digest`` fill train, then dev, then test.

    ``digest`` is a hash of the body (:func:`body_hash`). Groups come in the order of a seeded hash of it and are never
    divided, so a split may overshoot its target by a part of one group; test gets the rest. Targets are rounded half
    to even. A null stratum is one of its own; rows without digest are left out. The running totals are taken over hash
    ranges (``ranking.running``) and the result is joined back without shuffling hot groups (``skew.join_unique``), so
    neither a stratum nor a group of copies has to fit into one task. ``docs`` is read several times: pass a scan.
    """
    key = F.md5(F.concat_ws("|", F.col(digest), F.col(stratum).isNull().cast("string"), F.col(stratum).cast("string")))
    keyed = docs.where(F.col(digest).isNotNull()).withColumn("__g", key)
    groups = keyed.groupBy(F.col(stratum).alias("__s"), F.col(digest).alias("__h"), "__g").agg(F.count("*").alias("__size"))
    groups = stage(groups.withColumn("__o", hash52(str(seed), F.col("__h"))), "groups")
    n = groups.groupBy(F.col("__s").alias("__t")).agg(F.sum("__size").alias("__n"))
    ranked = running(groups, ["__s"], "__o", ["__h"], "__size", "__before", bits).join(n, F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    n_dev, n_test = F.bround(F.col("__n") * dev).cast("bigint"), F.bround(F.col("__n") * test).cast("bigint")
    ranked = stage(ranked.select("__s", "__g", "__size", "__before", n_dev.alias("__ndev"), (F.col("__before") < F.col("__n") - n_dev - n_test).alias("__first")), "ranked")
    taken = ranked.groupBy(F.col("__s").alias("__t")).agg(F.coalesce(F.sum(F.when(F.col("__first"), F.col("__size"))), F.lit(0)).alias("__train"))
    split = F.when(F.col("__first"), "train").when(F.col("__before") - F.col("__train") < F.col("__ndev"), "dev").otherwise("test")
    placed = stage(ranked.join(taken, F.col("__s").eqNullSafe(F.col("__t"))).select("__g", split.alias("split")), "placed")
    return join_unique(keyed, placed, ["__g"]).drop("__g")


def compat_split(groups: list[tuple[str, int]], seed: int = 42, dev: float = 0.15, test: float = 0.15) -> dict[str, str]:
    """The split of one stratum's (key, size) groups, in first-appearance order, under Python's own shuffle.

    For exact parity with runs that shuffled in Python; a driver-side helper for one small stratum.
    """
    order = list(groups)
    random.Random(seed).shuffle(order)
    n = sum(size for _, size in order)
    target = {"test": round(test * n), "dev": round(dev * n)}
    target["train"] = n - target["dev"] - target["test"]
    filled, out = {"train": 0, "dev": 0}, {}
    for key, size in order:
        where = next((s for s in ("train", "dev") if filled[s] < target[s]), "test")
        filled[where] = filled.get(where, 0) + size
        out[key] = where
    return out


def split_stats(assigned: DataFrame, stratum: str) -> DataFrame:
    """(stratum, train, dev, test, total), and the totals in a row with a null stratum."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    return assigned.where(F.col(stratum).isNotNull()).rollup(stratum).agg(*counts, F.count("*").alias("total"))


def record_counts(records: DataFrame) -> DataFrame:
    """(split, records, negatives, negative_share)."""
    return records.groupBy("split").agg(
        F.count("*").alias("records"), F.count_if("is_negative").alias("negatives"),
        F.try_divide(F.count_if("is_negative"), F.count("*")).alias("negative_share"))
