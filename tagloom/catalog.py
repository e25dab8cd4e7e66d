"""The named queries over the tables of a data folder. ``tagloom.oracle`` has SQL with the same results.

Deliveries are cleaned first: a prediction or a document that came several times counts once, and acts, types and
publications are compared without their spelling variants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import catalog_sources
from tagloom.functions import bio, prompts, tokens
from tagloom.functions.text import act_key, hash52, label_key, pub_key, split_key
from tagloom.operators import features, forgetting, metrics, predict, ranking, records, resample, selection, spans, splits, subsets
from tagloom.oracle import SQL as ORACLE
from tagloom.plans.storage import stage
from tagloom.sources import conll, resume
from tagloom.sources.tables import table

KEY = ["act", "entity_type"]
PROBES = ["probe_vies"]
GROUP_F1 = 0.9


# cleaned tables -------------------------------------------------------------------------------------------------------


def _publication() -> Column:
    """Of several spellings of a record's publication the largest number, as digits of any length."""
    key = pub_key(F.col("publication"))
    return F.max(F.when(key.isNotNull(), F.struct(F.length(key), key.alias("key"))))["key"]


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """One row per idx; ``pub`` is the publication to compare and join by, ``publication`` its number."""
    t = table(spark, d, "predictions").where(F.col("idx").isNotNull())
    return t.groupBy("idx").agg(
        _publication().alias("pub"), F.max(act_key(F.col("act"))).alias("act"),
        F.max(label_key(F.col("entity_type"))).alias("entity_type"), F.max("is_negative").alias("is_negative"),
        F.min("gold").alias("gold"), F.min("pred").alias("pred"), F.max("gen").alias("gen")).withColumn("publication", F.col("pub").try_cast("bigint"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """One row per act_id of the annotated documents."""
    t = table(spark, d, "act_documents").where(F.col("act_id").isNotNull())
    return t.groupBy("act_id").agg(
        F.max(act_key(F.col("act"))).alias("act"), _publication().alias("pub"), F.min(F.struct("tokens", "tags")).alias("m")).select(
        "act_id", "act", "pub", F.col("pub").try_cast("bigint").alias("publication"), "m.tokens", "m.tags")


def instructions(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """One row per record_id of the instruction records, or of those in ``only``."""
    t = table(spark, d, "gner_records").where(F.col("record_id").isNotNull())
    if only is not None:
        t = t.join(only.select("record_id"), "record_id", "left_semi")
    return t.groupBy("record_id").agg(
        F.max("act_id").alias("act_id"), F.max(act_key(F.col("act"))).alias("act"), F.max(label_key(F.col("entity_type"))).alias("entity_type"),
        _publication().try_cast("bigint").alias("publication"), F.max("is_negative").alias("is_negative"),
        F.max(split_key(F.col("split"))).alias("split"), F.max("instruction").alias("instruction"),
        F.max("instruction_fmt").alias("instruction_fmt"), F.max("input").alias("input"), F.max("output").alias("output"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("pub", "act", "act_id", F.col("tags").alias("labels"))


def _second_model(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of a document-level model, sliced to the records of the first: its labels are the document tags."""
    asked = stage(predictions(spark, d).drop("pred", "gen"), "asked")
    return predict.slice_documents(asked, _labels(spark, d), ["pub", "act"], "act_id")


def _pair(spark: SparkSession, d: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    return metrics.match_counts(predictions(spark, d), keys), metrics.match_counts(_second_model(spark, d), keys)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Averages and percentiles depend on the order of summation in their last digits: six places are compared."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# spans and measures ---------------------------------------------------------------------------------------------------


def span_decode_strict(spark, d):
    p = predictions(spark, d)
    sides = [spans.explode_spans(p, ["idx"], c).withColumn("side", F.lit(c)) for c in ("gold", "pred")]
    return sides[0].unionByName(sides[1])


def span_decode_lenient(spark, d):
    p = predictions(spark, d)
    sides = [spans.explode_spans(p, ["idx"], c, strict=False).withColumn("side", F.lit(c)) for c in ("gold", "pred")]
    return sides[0].unionByName(sides[1])


def span_decode_window(spark, d):
    tags = documents(spark, d).select("act_id", F.posexplode("tags").alias("pos", "tag"))
    return spans.window_spans(tags, ["act_id"])


def ner_f1_overall(spark, d):
    return metrics.both_modes(predictions(spark, d), [])


def ner_f1_by_act(spark, d):
    return metrics.both_modes(predictions(spark, d), ["act"])


def ner_f1_by_entity(spark, d):
    return metrics.both_modes(predictions(spark, d), KEY)


def ner_class_report(spark, d):
    return _rounded(metrics.class_report(predictions(spark, d)), "precision", "recall", "f1")


def ner_counts_by_act_support(spark, d):
    return metrics.scores(metrics.match_counts(predictions(spark, d), ["act"]), ["act"]).orderBy(F.desc("support"), "act")


def ner_counts_by_type_support(spark, d):
    return metrics.scores(metrics.match_counts(predictions(spark, d), ["entity_type"]), ["entity_type"]).orderBy(F.desc("support"), "entity_type")


def ner_error_decomposition(spark, d):
    return metrics.error_shares(metrics.outcomes(predictions(spark, d), ["act"]), "act")


def _template_types(spark, d):
    scored = metrics.scores(metrics.match_counts(predictions(spark, d), ["entity_type"]), ["entity_type"])
    return scored.where((F.col("f1") > GROUP_F1) & (F.col("support") > 0))


def ner_template_types(spark, d):
    return _template_types(spark, d).select("entity_type", "f1", "support")


def ner_error_decomposition_subset(spark, d):
    chosen = predictions(spark, d).join(_template_types(spark, d).select("entity_type"), "entity_type", "left_semi")
    return metrics.error_shares(metrics.outcomes(chosen, ["entity_type"]), "entity_type")


def ner_compare_delta(spark, d):
    return metrics.compare(*_pair(spark, d, ["act"]), "act")


def ner_weighted_gap(spark, d):
    both = metrics.compare(*_pair(spark, d, ["entity_type"]), "entity_type")
    grouped = both.withColumn("type_group", F.when(F.col("f1_a") > GROUP_F1, "template").otherwise("free-form"))
    return _rounded(grouped.groupBy("type_group").agg(
        F.count("*").alias("types"), F.sum("support").alias("support"), metrics.weighted_gap(both).alias("gap")), "gap")


# documents and resampling ---------------------------------------------------------------------------------------------


def _doc_counts(spark, d):
    counted = metrics.match_counts(predictions(spark, d), ["publication", "idx"])
    return counted.where(F.col("publication").isNotNull()).groupBy("publication").agg(
        F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"), F.min("idx").alias("first_idx"))


def doc_counts(spark, d):
    return _doc_counts(spark, d)


def doc_order(spark, d):
    """Documents in order of first appearance: the rank of their smallest idx."""
    docs = predictions(spark, d).where(F.col("publication").isNotNull()).groupBy("publication").agg(F.min("idx").alias("first_idx"))
    docs = stage(docs, "docs").withColumn("o", F.shiftleft("first_idx", 20))
    return ranking.running(docs, [], "o", ["publication"], None, "place", bits=16).select("publication", "first_idx", "place")


def _units(spark, d, unit):
    a, b = _pair(spark, d, [unit])
    sums = lambda t, m: t.where(F.col(unit).isNotNull()).groupBy(unit).agg(*[F.sum(c).alias(f"{c}_{m}") for c in ("tp", "n_pred", "n_gold")])
    return stage(sums(a, "a").join(sums(b, "b"), unit), "units")


def _replicates(spark, d, iterations):
    units = resample.numbered(_units(spark, d, "publication"), "publication")
    return resample.replicate_f1(resample.draw_replicates(units, iterations, "boot", ["a", "b"]), ["a", "b"])


def bootstrap_cluster_ci(spark, d, iterations=200):
    return _rounded(resample.percentile_interval(_replicates(spark, d, iterations), F.col("f1_a")), "mean", "lo", "hi")


def bootstrap_paired_delta(spark, d, iterations=200):
    ci = resample.percentile_interval(_replicates(spark, d, iterations), F.col("f1_a") - F.col("f1_b"))
    return _rounded(ci.withColumn("supported", F.col("lo") > 0), "mean", "lo", "hi")


def bootstrap_record_ci(spark, d, iterations=200):
    counted = stage(metrics.match_counts(predictions(spark, d), ["idx"]).select("idx", *[F.col(c).alias(f"{c}_a") for c in ("tp", "n_pred", "n_gold")]), "counts")
    drawn = resample.draw_replicates(resample.numbered(counted, "idx"), iterations, "record", ["a"])
    return _rounded(resample.order_interval(resample.replicate_f1(drawn, ["a"]), F.col("f1_a"), iterations), "mean", "ci_lower", "ci_upper")


def bootstrap_record_delta(spark, d, iterations=200):
    """Paired record bootstrap of two models: mean and interval of the difference, and whether it is all positive."""
    units = resample.numbered(_units(spark, d, "idx"), "idx")
    drawn = resample.replicate_f1(resample.draw_replicates(units, iterations, "record", ["a", "b"]), ["a", "b"])
    ci = resample.order_interval(drawn, F.col("f1_a") - F.col("f1_b"), iterations)
    return _rounded(ci.withColumn("supported", F.col("ci_lower") > 0), "mean", "ci_lower", "ci_upper")


def bootstrap_poisson_ci(spark, d, iterations=200):
    drawn = resample.poisson_replicates(_units(spark, d, "idx"), "idx", iterations, "poisson", ["a", "b"])
    return _rounded(resample.percentile_interval(resample.replicate_f1(drawn, ["a", "b"]), F.col("f1_a") - F.col("f1_b")), "mean", "lo", "hi")


# The same with the reference's 1,000 replicates; 200 are what the SQL of the names above fixes.


def bootstrap_cluster_ci_1000(spark, d):
    return bootstrap_cluster_ci(spark, d, 1000)


def bootstrap_paired_delta_1000(spark, d):
    return bootstrap_paired_delta(spark, d, 1000)


def bootstrap_record_ci_1000(spark, d):
    return bootstrap_record_ci(spark, d, 1000)


def bootstrap_record_delta_1000(spark, d):
    return bootstrap_record_delta(spark, d, 1000)


def bootstrap_poisson_ci_1000(spark, d):
    return bootstrap_poisson_ci(spark, d, 1000)


# data set building ----------------------------------------------------------------------------------------------------


def _split(spark, d):
    docs = documents(spark, d).where(F.col("act").isNotNull()).select("act_id", "act", splits.body_hash(F.col("tokens")).alias("body"))
    return splits.stratified_split(stage(docs, "bodies"), "act", "body")


def split_stratified(spark, d):
    return _split(spark, d).select("act_id", "act", "split")


def split_stats(spark, d):
    return splits.split_stats(_split(spark, d), "act")


def record_counts(spark, d):
    return _rounded(splits.record_counts(instructions(spark, d)), "negative_share")


def duplicate_bodies(spark, d):
    """Groups of documents of one act with equal text."""
    docs = documents(spark, d).where(F.col("act").isNotNull()).select("act", "act_id", splits.body_hash(F.col("tokens")).alias("body"))
    return docs.groupBy("act", "body").agg(F.count("*").alias("docs"), F.min("act_id").alias("first_act_id")).where("docs > 1")


def entity_schema_by_act(spark, d):
    return records.schema_by_act(documents(spark, d).where(F.col("act").isNotNull()))


def _schema(spark, d):
    return table(spark, d, "entity_schema").select(act_key(F.col("act")).alias("act"), "etypes")


def gner_records(spark, d):
    return records.fan_out(documents(spark, d), _schema(spark, d), ["act_id", "act", "publication"])


def conll_render(spark, d):
    return conll.render(documents(spark, d).withColumn("publication", F.col("publication").cast("string"))).select("act_id", "text")


# predictions ----------------------------------------------------------------------------------------------------------


def parse_inline_bio(spark, d):
    text = instructions(spark, d).select("record_id", F.col("output").alias("t"))
    return text.select("record_id", bio.parse_inline_tokens(F.col("t")).alias("tokens"), bio.parse_inline(F.col("t")).alias("labels"))


def parse_inline_bio_align(spark, d):
    """Labels of the generated text by the gold length, and how many of them differ from the stored prediction."""
    made = predict.parse_generated(predictions(spark, d).where("gen is not null").withColumn("n", F.size("gold")), "gen", "n", "parsed")
    same = F.size(F.filter(F.zip_with("parsed", "pred", lambda a, b: a == b), lambda x: x))
    return made.select("idx", "n", "parsed", (F.col("n") - same).alias("differing"))


def slice_to_entity_join(spark, d):
    return _second_model(spark, d).select("idx", "pred", "matched")


def slice_unmatched(spark, d):
    return predict.unmatched(_second_model(spark, d))


# subsets --------------------------------------------------------------------------------------------------------------


def few_shot_demos(spark, d):
    train = instructions(spark, d).where("split = 'train' and act is not null and entity_type is not null")
    return subsets.demonstrations(train, KEY, "record_id", 3, "demo").select(*KEY, "place", "record_id")


def sample_fixed_n(spark, d):
    return subsets.sample_n(stage(predictions(spark, d).select("idx", "act", "entity_type"), "ids"), "idx", 200, "sample")


def train_fraction(spark, d):
    train = stage(instructions(spark, d).where("split = 'train'").select("record_id"), "train")
    return subsets.fraction(train, "record_id", 0.25, "fraction")


def limit_prefix(spark, d):
    return subsets.first_rows(predictions(spark, d).select("idx", "entity_type"), "idx", 1000)


# benchmarks and checkpoints -------------------------------------------------------------------------------------------


def _scores(spark, d):
    long = forgetting.long_scores(table(spark, d, "benchmark_results"), "task_set", ["model", "tag"])
    return long.withColumn("seed", F.regexp_extract("tag", "_s([0-9]+)$", 1).cast("int"))


def _deltas(spark, d):
    s = _scores(spark, d)
    base = s.where("model = 'base'").select("seed", "bench", "score")
    return forgetting.deltas(s.where("model <> 'base'"), base, ["seed", "bench"]).select(
        F.col("model").alias("method"), "seed", "bench", "score", "base_score", "delta_pp")


def benchmark_scores(spark, d):
    return _scores(spark, d).select("model", "tag", "seed", "bench", "score")


def benchmark_first_metric(spark, d):
    """The first available of two metrics of every result."""
    t = table(spark, d, "benchmark_results")
    return t.select("tag", "task_set", forgetting.first_available(F.col("scores"), ["logica_b", "historia"]).alias("score")).distinct()


def forgetting_delta(spark, d):
    return _rounded(_deltas(spark, d).withColumn("reading", forgetting.band(F.col("delta_pp"))), "delta_pp")


def forgetting_bench_summary(spark, d):
    return _rounded(forgetting.seed_summary(_deltas(spark, d), PROBES)[0], "mean_delta")


def forgetting_seed_summary(spark, d):
    return _rounded(forgetting.seed_summary(_deltas(spark, d), PROBES)[1], "mean_delta", "std_delta")


def run_registry_files(spark, d):
    """Registered result files by run, and whether scores of that run and family were read."""
    have = table(spark, d, "benchmark_results").select("model", "tag", F.col("task_set").alias("family")).distinct()
    runs = table(spark, d, "run_registry").withColumn("tag", F.concat_ws("_s", "method", F.col("seed").cast("string")))
    return runs.join(have.withColumn("found", F.lit(True)), ["tag", "family"], "left").select(
        "method", "seed", "family", "path", F.coalesce("found", F.lit(False)).alias("found"))


def checkpoint_candidates(spark, d):
    return selection.candidates(table(spark, d, "checkpoints"))


def checkpoint_argmax(spark, d):
    c = table(spark, d, "checkpoints")
    return selection.best(c.join(selection.candidates(c), ["run", "step"], "left_semi"))


# prompts --------------------------------------------------------------------------------------------------------------


def _prompted(spark, d, only=None):
    r = instructions(spark, d, only)
    return r.withColumn("query", prompts.content(F.coalesce("instruction_fmt", "instruction", F.lit("")), F.coalesce("input", F.lit(""))))


def chat_render(spark, d):
    q = _prompted(spark, d)
    return q.select("record_id", prompts.chat(F.array(prompts.message("user", F.col("query")))).alias("prompt"),
                    prompts.training_text(F.coalesce("instruction_fmt", "instruction", F.lit("")), F.coalesce("input", F.lit("")), F.coalesce("output", F.lit(""))).alias("training_text"))


def teacher_prompt(spark, d):
    return _prompted(spark, d).select("record_id", prompts.teacher(F.col("query"), F.coalesce("output", F.lit(""))).alias("teacher_prompt"))


def few_shot_prompt(spark, d):
    """Prompts of the dev and test records with up to two demonstrations of their act and type.

    Demonstrations are chosen by narrow columns; texts are read for the chosen few and for the asked records alone.
    """
    t = table(spark, d, "gner_records").where(F.col("record_id").isNotNull())
    texts = ("instruction", "input", "output")
    narrow = t.groupBy("record_id").agg(
        F.max(act_key(F.col("act"))).alias("act"), F.max(label_key(F.col("entity_type"))).alias("entity_type"), F.max(split_key(F.col("split"))).alias("split"),
        F.max("is_negative").alias("is_negative"), *[F.max(F.col(c).isNotNull()).alias(c) for c in texts])
    chosen = stage(subsets.demonstrations(
        narrow.where("split = 'train' and act is not null and entity_type is not null and instruction and input and output"),
        KEY, "record_id", 2, "demo").select("record_id", "place"), "demos")
    shown = _prompted(spark, d, chosen).join(chosen, "record_id")
    pool = subsets.demo_pool(shown, KEY)
    asked = _prompted(spark, d).where("split in ('dev', 'test')").select("record_id", *KEY, "query").join(pool, KEY, "left")
    messages = prompts.few_shot(F.col("demos"), F.col("query"))
    return asked.select("record_id", F.size(messages).alias("messages"), F.md5(prompts.keep_end(prompts.chat(messages), prompts.budget(2))).alias("prompt_md5"))


# features -------------------------------------------------------------------------------------------------------------


def token_features(spark, d):
    return features.token_features(documents(spark, d), ["act_id"])


def word_shape(spark, d):
    words = features.positions(documents(spark, d), ["act_id"]).groupBy("token").agg(F.count("*").alias("n"))
    w = F.col("token")
    return words.select("token", "n", tokens.shape(w).alias("shape"), tokens.is_upper(w).alias("isupper"), tokens.has_digit(w).alias("hasdigit"))


def label_vocab(spark, d):
    return features.label_vocabulary(documents(spark, d))


def label_encode(spark, d):
    docs = documents(spark, d)
    vocab = features.label_vocabulary(docs).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "label"))), lambda x: x["label"]).alias("v"))
    return docs.withColumn("v", vocab.scalar()).select("act_id", bio.encode(F.col("tags"), F.col("v")).alias("ids"))


# resume ---------------------------------------------------------------------------------------------------------------


def _done(spark, d):
    return predictions(spark, d).where(hash52("done", F.col("idx")) % 4 > 0)


def resume_todo(spark, d):
    """Dev and test records without a finished prediction, when a part of the log is there."""
    asked = instructions(spark, d).where("split in ('dev', 'test')").select(F.col("record_id").alias("idx"), "split")
    return resume.todo(asked, _done(spark, d), ["idx"])


def completeness_gate(spark, d):
    asked = instructions(spark, d).where("split in ('dev', 'test')").select(F.col("record_id").alias("idx"), "split")
    left = resume.todo(asked, _done(spark, d), ["idx"]).groupBy("split").agg(F.count("*").alias("missing"))
    return asked.groupBy("split").agg(F.count("*").alias("asked")).join(left, "split", "left").select(
        "split", "asked", F.coalesce("missing", F.lit(0)).alias("missing"), F.col("missing").isNull().alias("complete"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        span_decode_strict, span_decode_lenient, span_decode_window, ner_f1_overall, ner_f1_by_act, ner_f1_by_entity, ner_class_report,
        ner_counts_by_act_support, ner_counts_by_type_support, ner_error_decomposition, ner_template_types, ner_error_decomposition_subset,
        ner_compare_delta, ner_weighted_gap, doc_counts, doc_order, bootstrap_cluster_ci, bootstrap_paired_delta, bootstrap_record_ci,
        bootstrap_record_delta, bootstrap_poisson_ci, bootstrap_cluster_ci_1000, bootstrap_paired_delta_1000, bootstrap_record_ci_1000,
        bootstrap_record_delta_1000, bootstrap_poisson_ci_1000, split_stratified, split_stats, record_counts, duplicate_bodies, entity_schema_by_act, gner_records, conll_render,
        parse_inline_bio, parse_inline_bio_align, slice_to_entity_join, slice_unmatched, few_shot_demos, sample_fixed_n, train_fraction,
        limit_prefix, benchmark_scores, benchmark_first_metric, forgetting_delta, forgetting_bench_summary, forgetting_seed_summary,
        run_registry_files, checkpoint_candidates, checkpoint_argmax, chat_render, teacher_prompt, few_shot_prompt, token_features, word_shape,
        label_vocab, label_encode, resume_todo, completeness_gate)
} | catalog_sources.QUERIES
SQL = ORACLE | catalog_sources.SQL
