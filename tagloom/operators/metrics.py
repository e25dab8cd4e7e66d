"""Span matching and the measures built on it.

Counts are additive: every measure is a sum of (tp, predicted, gold) over some rows, so a record is decoded once, without
a shuffle, and grouping aggregates three integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import bio


def match_counts(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred", strict: bool = True) -> DataFrame:
    """(keys..., tp, n_pred, n_gold) of every record."""
    g, p = bio.spans(F.col(gold), strict), bio.spans(F.col(pred), strict)
    return (
        df.select(*keys, g.alias("__g"), p.alias("__p"))
        .select(*keys, F.size(F.array_intersect("__g", "__p")).cast("bigint").alias("tp"),
                F.size("__p").cast("bigint").alias("n_pred"), F.size("__g").cast("bigint").alias("n_gold"))
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def precision() -> Column:
    return ratio(F.col("tp"), F.col("n_pred")).alias("precision")


def recall() -> Column:
    return ratio(F.col("tp"), F.col("n_gold")).alias("recall")


def f1(prefix: str = "") -> Column:
    return ratio(2 * F.col(f"{prefix}tp"), F.col(f"{prefix}n_pred") + F.col(f"{prefix}n_gold"))


def summed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the counts and the number of records by ``keys`` (none: one row over everything)."""
    return counts.groupBy(*keys).agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias("n_pred"),
        F.coalesce(F.sum("n_gold"), F.lit(0)).alias("n_gold"), F.count("*").alias("n_records"))


def scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., tp, fp, fn, support, precision, recall, f1, n_records)."""
    return summed(counts, keys).select(
        *keys, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"),
        F.col("n_gold").alias("support"), precision(), recall(), f1().alias("f1"), "n_records")


def both_modes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lenient and strict measures side by side, from one decoding of every record."""
    decoded = df.select(*keys, bio.runs(F.col("gold")).alias("__g"), bio.runs(F.col("pred")).alias("__p"))
    modes = ("default", "strict")
    rows = decoded.select(*keys, *[bio.of_runs(F.col(f"__{i}"), m == "strict").alias(f"{m}_{i}") for m in modes for i in "gp"])
    sums = [
        F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(f"{m}_{name}")
        for m in modes
        for name, c in (("tp", F.array_intersect(f"{m}_g", f"{m}_p")), ("n_pred", F.col(f"{m}_p")), ("n_gold", F.col(f"{m}_g")))
    ]
    a = rows.groupBy(*keys).agg(*sums, F.count("*").alias("n_records"))
    return a.select(
        *keys, f1("default_").alias("f1"), ratio(F.col("default_tp"), F.col("default_n_pred")).alias("precision"),
        ratio(F.col("default_tp"), F.col("default_n_gold")).alias("recall"), f1("strict_").alias("f1_strict"),
        ratio(F.col("strict_tp"), F.col("strict_n_pred")).alias("precision_strict"),
        ratio(F.col("strict_tp"), F.col("strict_n_gold")).alias("recall_strict"), "n_records")


def class_report(df: DataFrame) -> DataFrame:
    """Lenient measures per span type, and micro, macro and support-weighted averages as rows of their own.

    One pass over the records: the spans of both sides and their intersection are exploded together, and the averages are
    taken from the counts by type, one row each.
    """
    def marked(spans: Column, tp: int, pred: int, gold: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["etype"].alias("label"), *[
            F.lit(v).cast("bigint").alias(n) for n, v in (("tp", tp), ("n_pred", pred), ("n_gold", gold))]))

    both = df.select(bio.spans(F.col("gold"), False).alias("g"), bio.spans(F.col("pred"), False).alias("p"))
    each = both.select(F.inline(F.concat(
        marked(F.array_intersect("g", "p"), 1, 0, 0), marked(F.col("p"), 0, 1, 0), marked(F.col("g"), 0, 0, 1))))
    counts, names = ("tp", "n_pred", "n_gold"), ("precision", "recall", "f1")
    per = each.groupBy("label").agg(*[F.sum(c).alias(c) for c in counts])
    rows = per.select("label", *counts, precision(), recall(), f1().alias("f1"))
    # one row with everything the averages need, then one row an average
    whole = rows.agg(
        F.coalesce(F.collect_list(F.struct("label", *names, F.col("n_gold").alias("support"))), F.array()).alias("rows"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"macro_{m}") for m in names],
        *[ratio(F.sum(F.col(m) * F.col("n_gold")), F.sum("n_gold")).alias(f"weighted_{m}") for m in names])

    def average(label: str, of: dict[str, Column]) -> Column:
        return F.struct(F.lit(label).alias("label"), *[of[m].alias(m) for m in names], F.col("n_gold").alias("support"))

    return whole.select(F.inline(F.concat("rows", F.array(
        average("micro avg", {"precision": precision(), "recall": recall(), "f1": f1()}),
        *[average(f"{k} avg", {m: F.col(f"{k}_{m}") for m in names}) for k in ("macro", "weighted")]))))


def outcomes(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., exact, boundary, omission) of every record's gold spans.

    Boundary: not matched exactly, but a predicted span of the type overlaps. The overlap is tested inside the record,
    so no join of spans is needed.
    """
    g, p = F.col("__g"), F.col("__p")
    exact = F.size(F.array_intersect(g, p))
    touched = F.size(F.filter(F.array_except(g, p), lambda x: F.exists(
        p, lambda y: (y["etype"] == x["etype"]) & (y["s"] < x["e"]) & (y["e"] > x["s"]))))
    return (
        df.select(*keys, bio.spans(F.col("gold")).alias("__g"), bio.spans(F.col("pred")).alias("__p"))
        .select(*keys, exact.alias("exact"), touched.alias("boundary"), (F.size(g) - exact - touched).alias("omission"))
    )


def error_shares(counted: DataFrame, key: str) -> DataFrame:
    """Counts and shares by ``key``, and of everything in a row with a null key."""
    return (
        counted.where(F.col(key).isNotNull()).rollup(key)
        .agg(*[F.sum(c).alias(c) for c in ("exact", "boundary", "omission")])
        .withColumn("spans", F.col("exact") + F.col("boundary") + F.col("omission"))
        .select(key, "exact", "boundary", "omission", "spans", *[
            ratio(F.col(c), F.col("spans")).alias(f"{c}_share") for c in ("exact", "boundary", "omission")])
    )


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, support, f1_a, f1_b, delta) of two models' counts by ``key``; a key that only one has reads 0 in the other."""
    x = summed(a, [key]).select(key, f1().alias("f1_a"), F.col("n_gold").alias("support"))
    y = summed(b, [key]).select(F.col(key).alias("__k"), f1().alias("f1_b"), F.col("n_gold").alias("__support"))
    both = x.join(y, F.col(key).eqNullSafe(F.col("__k")), "full")
    return both.select(
        F.coalesce(key, "__k").alias(key), F.coalesce("support", "__support").alias("support"), F.coalesce("f1_a", F.lit(0.0)).alias("f1_a"),
        F.coalesce("f1_b", F.lit(0.0)).alias("f1_b"), (F.coalesce("f1_a", F.lit(0.0)) - F.coalesce("f1_b", F.lit(0.0))).alias("delta"))


def weighted_gap(compared: DataFrame) -> Column:
    """Aggregate: mean of delta weighted by support; 0 without support."""
    return ratio(F.sum(F.col("delta") * F.col("support")), F.sum("support"))
