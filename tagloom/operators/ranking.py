"""Ranks and running totals of groups of any size.

``row_number() OVER (PARTITION BY k ORDER BY h)`` puts a whole group into one task. Here the order is a hash, so a
group falls into ``2**bits`` bins of consecutive hashes: bins are counted with map-side aggregation, their starting
offsets come from a window over that small table, and only rows of one bin are ever sorted together. The number of bins
grows with the table, so that a bin stays at about ``BIN_ROWS`` rows even if one group holds everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 52
BIN_ROWS = 100_000


def bits_for(rows: int, least: int = 10) -> int:
    """Leading bits that cut ``rows`` evenly hashed rows into bins of at most ``BIN_ROWS``."""
    return min(max(least, (max(rows, 1) // BIN_ROWS).bit_length()), HASH_BITS)


def hash_bin(order: str, bits: int):
    return F.shiftright(F.col(order), HASH_BITS - bits)


def running(df: DataFrame, keys: list[str], order: str, tie: list[str], value: str | None, out: str, bits: int | None = None,
            below: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the group (``value=None``: the number of them, so the rank from 0).

    With ``below`` only rows with ``out`` below it are kept; bins that lie beyond it are dropped before anything is shuffled.
    ``bits`` is taken from the number of rows unless given; it changes the cost only. ``df`` is read three times: pass a
    scan. ``order`` holds non-negative 52-bit hashes (``functions.text.hash52``), ``tie`` makes the order total. A null in
    ``value`` counts as 0. Null keys form a group of their own. An empty table gives an empty table.
    """
    if bits is None:
        bits = bits_for(df.count())
    amount = F.lit(1).cast("bigint") if value is None else F.coalesce(F.col(value).cast("bigint"), F.lit(0))
    binned = df.withColumn("__bin", hash_bin(order, bits))
    group = [F.col(k) for k in keys]
    before = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy(*keys, "__bin").agg(F.sum(amount).alias("__sum"))
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bin").alias("__obin"),
                F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    )
    if below is not None:
        offsets = offsets.where(F.col("__offset") < below)
    if not keys and bits <= 20:  # one row a bin: a table of a few megabytes at most
        offsets = F.broadcast(offsets)
    same = F.col("__bin") == F.col("__obin")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*group, "__bin").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        binned.join(offsets, same)
        .withColumn(out, F.col("__offset") + F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .drop("__bin", "__obin", "__offset", *[f"__k{i}" for i in range(len(keys))])
    )
    return ranked if below is None else ranked.where(F.col(out) < below)
