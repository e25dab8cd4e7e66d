"""Whole tasks from files to files: building a data set, evaluating, comparing, benchmark and checkpoint reports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import forgetting, metrics, records, resample, selection, splits
from tagloom.plans.storage import stage
from tagloom.sources import conll
from tagloom.sources import records as io


def build_dataset(spark: SparkSession, corpus: str, out: str, seed: int = 42) -> dict[str, Any]:
    """Annotated files to split CoNLL files, instruction records by split, entity schema and split statistics."""
    docs = stage(conll.read_raw(spark, corpus).withColumn("body", splits.body_hash(F.col("tokens"))), "docs")
    schema = records.schema_by_act(docs)
    placed = stage(splits.stratified_split(docs, "act", "body", seed=seed).drop("body"), "placed")
    for name in splits.SPLITS:
        conll.write_split(placed.where(F.col("split") == name), f"{out}/conll/{name}", ["act", "publication", "seq"])
    recs = stage(records.fan_out(placed, schema, ["act", "publication", "split"]), "records")
    io.write_jsonl(recs, f"{out}/finetune", by_split=True)
    stats = {r["act"]: {k: r[k] for k in (*splits.SPLITS, "total")} for r in splits.split_stats(placed, "act").collect()}
    counts = {r["split"]: {"records": r["records"], "negatives": r["negatives"]} for r in splits.record_counts(recs).collect()}
    # The keys of the statistics file.
    summary = {
        "seed": seed, "ratios": {"train": 0.70, "dev": 0.15, "test": 0.15},
        "doc_counts_per_act": {a: s for a, s in sorted(stats.items(), key=lambda x: x[0] or "") if a is not None},
        "doc_totals": stats.get(None, {}), "finetune_record_counts": counts,
    }
    io.write_report({r["act"]: r["etypes"] for r in schema.orderBy("act").collect()}, f"{out}/entity_schema.json", spark)
    io.write_report(summary, f"{out}/split_stats.json", spark)
    return summary


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of a result document, one row each, with their place ``idx``."""
    return io.predictions(io.read_results(spark, path))


def evaluate(preds: DataFrame, model: str, split: str, iterations: int = 1000) -> dict[str, Any]:
    """The measures of a result document: overall, by act, by act and type, and the bootstrap interval.

    ``preds`` has idx, act, entity_type, gold and pred.
    """
    preds = stage(preds.select("idx", "act", "entity_type", "gold", "pred"), "predictions")
    overall = metrics.both_modes(preds, []).first().asDict()
    strict = {k: overall.pop(f"{k}_strict") for k in ("f1", "precision", "recall")}
    per_act = {r["act"]: r.asDict() for r in metrics.both_modes(preds, ["act"]).orderBy("act").collect()}
    per_entity = {f"{r['act']}/{r['entity_type']}": r.asDict() for r in metrics.both_modes(preds, ["act", "entity_type"]).orderBy("act", "entity_type").collect()}
    counted = metrics.match_counts(preds, ["idx"]).select("idx", *[F.col(c).alias(f"{c}_a") for c in ("tp", "n_pred", "n_gold")])
    drawn = resample.draw_replicates(resample.numbered(counted, "idx"), iterations, f"{model}|{split}", ["a"])
    interval = resample.order_interval(resample.replicate_f1(drawn, ["a"]), F.col("f1_a"), iterations).first()
    return {
        "model": model, "split": split, "metrics": overall | {"strict": strict, "report": io.report(metrics.class_report(preds), "label")},
        "per_act": per_act, "per_entity": per_entity, "bootstrap": interval.asDict() if interval else {},
    }


def _units(preds: DataFrame, model: str, unit: str) -> DataFrame:
    counted = metrics.match_counts(preds, [unit]).where(F.col(unit).isNotNull())
    return counted.groupBy(unit).agg(*[F.sum(c).alias(f"{c}_{model}") for c in ("tp", "n_pred", "n_gold")])


def compare(a: DataFrame, b: DataFrame, unit: str = "publication", iterations: int = 1000) -> dict[str, Any]:
    """Strict F1 of two models, the paired bootstrap interval of the difference, and the difference by act.

    Models are paired by ``unit``; a unit that only one of them has is an error.
    """
    x, y = stage(_units(a, "a", unit), "units-a"), stage(_units(b, "b", unit), "units-b")
    if not x.join(y, unit, "left_anti").isEmpty() or not y.join(x, unit, "left_anti").isEmpty():
        raise ValueError(f"the two models have different {unit}s")
    drawn = stage(resample.replicate_f1(resample.draw_replicates(resample.numbered(x.join(y, unit), unit), iterations, "compare", ["a", "b"]), ["a", "b"]), "replicates")
    ci = resample.percentile_interval(drawn, F.col("f1_a") - F.col("f1_b")).first()
    point = {m: resample.point_f1(t.toDF(unit, "tp", "n_pred", "n_gold")).first()["f1"] for m, t in (("a", x), ("b", y))}
    per_act = metrics.compare(metrics.match_counts(a, ["act"]), metrics.match_counts(b, ["act"]), "act")
    return {
        "f1_a": point["a"], "f1_b": point["b"], "delta_f1": point["a"] - point["b"],
        "bootstrap": {"ci_lower": ci["lo"], "ci_upper": ci["hi"], "h1_sustained": ci["lo"] is not None and ci["lo"] > 0},
        "per_act": io.report(per_act.orderBy("act"), "act"),
    }


def error_tables(a: DataFrame, b: DataFrame, key: str = "act") -> tuple[DataFrame, DataFrame]:
    """By ``key``, largest support first: both models' F1 and the first one's gold spans as exact, boundary, omission.
    And one row with the support-weighted gap."""
    both = metrics.compare(metrics.match_counts(a, [key]), metrics.match_counts(b, [key]), key)
    shares = metrics.error_shares(metrics.outcomes(a, [key]), key)
    return both.join(shares, key).orderBy(F.desc("support"), key), both.agg(metrics.weighted_gap(both).alias("gap"))


def benchmark_tables(results: DataFrame, base: str, probes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deltas with their reading, means by benchmark, and means and deviations over seeds, of all models against ``base``.

    ``results`` has model, seed, task_set and scores.
    """
    long = forgetting.long_scores(results, "task_set", ["model", "seed"])
    delta = forgetting.deltas(long.where(F.col("model") != base), long.where(F.col("model") == base), ["seed", "bench"]).withColumnRenamed("model", "method")
    return delta.withColumn("reading", forgetting.band(F.col("delta_pp"))), *forgetting.seed_summary(delta, probes)


def choose_checkpoints(listing: DataFrame) -> DataFrame:
    """(run, step, dev_f1): the best of each run's candidate steps."""
    listing = stage(listing, "checkpoints")
    return selection.best(listing.join(selection.candidates(listing), ["run", "step"], "left_semi"))
