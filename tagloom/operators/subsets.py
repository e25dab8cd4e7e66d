"""Seeded samples, limits and demonstrations. The order is a hash of the key, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import hash52
from tagloom.operators.ranking import running


def sample_n(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement (all, if there are fewer); ``key`` is unique."""
    return running(df.withColumn("__h", hash52(seed, F.col(key))), [], "__h", [key], None, "__rank", below=n).drop("__h", "__rank")


def fraction(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """max(1, round half even (rows * share)) rows, with their place ``rank`` in the sampled order."""
    keep = df.agg(F.greatest(F.lit(1), F.bround(F.count("*") * share).cast("bigint"))).first()[0]
    return running(df.withColumn("__h", hash52(seed, F.col(key))), [], "__h", [key], None, "rank", below=keep).drop("__h")


def first_rows(df: DataFrame, idx: str, n: int) -> DataFrame:
    """Rows whose running number is below ``n``: deterministic, unlike a bare limit."""
    return df.where(F.col(idx) < n)


def demonstrations(records: DataFrame, keys: list[str], key: str, n: int, seed: str) -> DataFrame:
    """Up to ``n`` positive records of each group, with their ``place``; ranks are cut off before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(hash52(seed, F.col(key)), key)
    return records.where(~F.col("is_negative")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def demo_pool(demos: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., demos): the group's demonstrations as an array in order, at most n by construction."""
    entry = F.struct("place", "instruction", "input", "output")
    return demos.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("demos"))
