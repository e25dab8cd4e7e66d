"""Bootstrap intervals over additive counts.

Only count rows are resampled, never tag sequences. Two designs: drawing with replacement through an explicit table of
draws (the textbook design, for a bounded number of units), and Poisson weights, where every unit counts Poisson(1)
times in every iteration: one pass, no join, and a partial sum per task, for any number of units. All randomness is a
hash of seed, iteration and unit, so results do not depend on partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import hash52
from tagloom.operators.metrics import f1
from tagloom.operators.ranking import running
from tagloom.plans.storage import stage

#: 52-bit edges of the Poisson(1) distribution: a hash below edge k counts at most k times.
EDGES = [round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * (1 << 52)) for k in range(12)]


def numbered(units: DataFrame, key: str) -> DataFrame:
    """Units with ``k`` = 0, 1, ... in the order of a hash of their unique ``key``, ranked without a single-task window."""
    return running(units.withColumn("__o", hash52("unit", F.col(key))), [], "__o", [key], None, "k").drop("__o")


def draw_replicates(units: DataFrame, iterations: int, seed: str, models: list[str], most_draws: int = 4_000_000_000,
                    few_units: int = 500_000) -> DataFrame:
    """(it, tp_m, n_pred_m, n_gold_m ...): sums over n units drawn with replacement, for each iteration.

    ``units`` is (k, counts of every model), numbered from 0; all models see the same draws. Up to ``few_units`` units
    their counts are broadcast, and an iteration is summed where it is drawn; beyond, the draws are a table of
    iterations x n rows, joined to the units, with the same result. Beyond ``most_draws`` draws the units get Poisson
    weights instead (:func:`poisson_replicates`), whose cost does not shuffle with the number of iterations.
    """
    units = stage(units, "units")
    n = units.count()
    if 0 < n <= few_units:
        return _drawn_in_place(units, n, iterations, seed, models)
    if iterations * n > most_draws:
        return poisson_replicates(units, "k", iterations, seed, models)
    spark = units.sparkSession
    columns = [f"{c}_{m}" for m in models for c in ("tp", "n_pred", "n_gold")]
    draws = (
        spark.range(iterations * n)
        .select(F.expr(f"id div {max(n, 1)}").alias("it"), (F.col("id") % max(n, 1)).alias("turn"))
        .select("it", (hash52(seed, F.col("it"), F.col("turn")) % max(n, 1)).alias("k"))
        .groupBy("it", "k").agg(F.count("*").alias("times"))
    )
    return draws.join(units, "k").groupBy("it").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in columns])


def _hashes(heads: Iterable, tails: list[bytes]) -> np.ndarray:
    """52 bits of the MD5 of every head with every tail, in that order."""
    found = []
    for head in heads:
        for tail in tails:
            h = head.copy()
            h.update(tail)
            found.append(h.digest())
    return np.frombuffer(b"".join(found), ">u8")[::2].astype(np.uint64) >> np.uint64(12)


def _drawn_in_place(units: DataFrame, n: int, iterations: int, seed: str, models: list[str]) -> DataFrame:
    spark = units.sparkSession
    columns = [f"{c}_{m}" for m in models for c in ("tp", "n_pred", "n_gold")]
    rows = units.select("k", *columns).toPandas().sort_values("k")
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(rows[columns].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            its = batch.column("id").to_pylist()
            sums = np.zeros((len(its), len(columns)), np.int64)
            for row, it in enumerate(its):
                head = hashlib.md5(f"{seed}|{it}|".encode())
                times = np.zeros(n, np.int64)
                for at in range(0, n, 100_000):
                    drawn = _hashes([head], [b"%d" % turn for turn in range(at, min(n, at + 100_000))]) % np.uint64(n)
                    times += np.bincount(drawn.astype(np.int64), minlength=n)
                sums[row] = times @ counts
            yield pa.RecordBatch.from_arrays([pa.array(its, pa.int64())] + [pa.array(c) for c in sums.T], names=["it", *columns])

    tasks = max(1, min(iterations, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, iterations, 1, tasks).mapInArrow(run, "it bigint, " + ", ".join(f"{c} bigint" for c in columns))


def poisson_weight(h: Column) -> Column:
    """A Poisson(1) count from 13 hex digits of a hash (``functions.text.hash_hex``), as a column."""
    above = [F.when(h >= f"{e:013x}", 1).otherwise(0) for e in EDGES]
    return sum(above[1:], above[0])


def poisson_weights(keys: list[str], iterations: int, seed: str) -> np.ndarray:
    """(keys x iterations) Poisson(1) counts from 52 bits of the MD5 of seed, iteration and key."""
    heads = [hashlib.md5(f"{seed}|{it}|".encode()) for it in range(iterations)]
    h = _hashes(heads, [key.encode() for key in keys]).reshape(iterations, len(keys))
    return np.searchsorted(np.array(EDGES, np.uint64), h, side="right").astype(np.int64).T


def poisson_replicates(units: DataFrame, unit: str, iterations: int, seed: str, models: list[str]) -> DataFrame:
    """(it, tp_m, ...): every unit counted Poisson(1) times in each iteration.

    Each task keeps one sum per iteration and count and sends those alone, so what is shuffled does not depend on the
    number of units. A unit with a null key is left out.
    """
    columns = [f"{c}_{m}" for m in models for c in ("tp", "n_pred", "n_gold")]
    # the work is units times iterations: spread it, whatever the size of the count table
    spread = units.repartition(units.sparkSession.sparkContext.defaultParallelism, unit)
    kept = spread.select(F.col(unit).cast("string").alias("unit"), *[F.col(c).cast("bigint").alias(c) for c in columns]).where("unit is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((iterations, len(columns)), np.int64), False
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.int64)
                total += poisson_weights(part.column("unit").to_pylist(), iterations, seed).T @ counts
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(iterations))] + [pa.array(total[:, i]) for i in range(len(columns))], names=["it", *columns])

    partial = kept.mapInArrow(run, "it bigint, " + ", ".join(f"{c} bigint" for c in columns))
    return partial.groupBy("it").agg(*[F.sum(c).alias(c) for c in columns])


def replicate_f1(replicates: DataFrame, models: list[str]) -> DataFrame:
    """(it, f1_m ...)."""
    return replicates.select("it", *[_f1(m).alias(f"f1_{m}") for m in models])


def _f1(model: str) -> Column:
    two = 2 * F.col(f"tp_{model}")
    return F.coalesce(F.try_divide(two, F.col(f"n_pred_{model}") + F.col(f"n_gold_{model}")), F.lit(0.0))


def percentile_interval(replicates: DataFrame, value: Column) -> DataFrame:
    """(mean, lo, hi): 95 % by interpolated percentiles."""
    return replicates.agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"))


def order_interval(replicates: DataFrame, value: Column, iterations: int) -> DataFrame:
    """(mean, ci_lower, ci_upper): 95 % by order statistics of the sorted replicates, one value per iteration."""
    ordered = replicates.agg(F.avg(value).alias("mean"), F.sort_array(F.collect_list(value)).alias("v"))
    return ordered.select("mean", F.get("v", F.lit(int(0.025 * iterations))).alias("ci_lower"), F.get("v", F.lit(int(0.975 * iterations))).alias("ci_upper"))


def point_f1(counts: DataFrame) -> DataFrame:
    """(f1,) from summed counts."""
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "n_pred", "n_gold")]).select(f1().alias("f1"))
