"""The queries of the nine problems over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import act_key, chars, label_key, pub_key, pub_no, source_key, split_key
from tagloom.llm import abuse, chunking, grouped_split, leakage, mixing, neardup, overlap, packing, sampling
from tagloom.operators.skew import join_unique
from tagloom.plans.storage import stage
from tagloom.sources.tables import table

CELL = ["act", "entity_type", "is_negative"]
#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = "/opt/tokenizers"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gner_records")


# 1 -------------------------------------------------------------------------------------------------------------------


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records = _records(spark, d).select(
        "record_id", act_key(F.col("act")).alias("act"), label_key(F.col("entity_type")).alias("entity_type"),
        F.col("is_negative").cast("int").alias("is_negative"))
    return sampling.proportional_sample(records, table(spark, d, "sample_targets"), "record_id", CELL)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = _sample(spark, d)
    return report.where("deficit > 0").select(*CELL)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1]


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0].withColumnRenamed("id", "record_id")


# 2 -------------------------------------------------------------------------------------------------------------------


def _limit(spark: SparkSession, d: str, purpose: str, field: str) -> tuple[int, int]:
    row = table(spark, d, "size_limits").where((F.col("purpose") == purpose) & (F.col("field") == field)).first()
    return row["max_chars"], row["overlap_chars"]


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    capacity, _ = _limit(spark, d, "container", "input+output")
    items = _records(spark, d).select("record_id", (chars(F.col("input")) + chars(F.col("output"))).alias("size"))
    return packing.pack(items, "record_id", "size", capacity), capacity


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    packed, _ = _packed(spark, d)
    return packed.where("piece_no = 1").select(F.col("id").alias("record_id"))


def p2_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0].withColumnRenamed("id", "record_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(*_packed(spark, d))


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """What any right packing has: every record whole, nothing above the capacity, only overlong records divided."""
    packed, capacity = _packed(spark, d)
    packed = stage(packed, "packed")
    boxes = packed.groupBy("container").agg(F.sum("size").alias("used"))
    ids = packed.groupBy("id").agg(F.count("*").alias("pieces"), F.sum("size").alias("size"), F.max(F.col("start") + F.col("size")).alias("stop"))
    over = boxes.where(F.col("used") > capacity).agg(F.count("*").alias("over_capacity"))
    return ids.agg(F.count("*").alias("records"), F.sum("size").alias("chars"), F.count_if(F.col("pieces") > 1).alias("divided"),
                   F.count_if(F.col("size") != F.col("stop")).alias("torn")).withColumn("over_capacity", over.scalar())


# 3 -------------------------------------------------------------------------------------------------------------------


def _splits(spark: SparkSession, d: str) -> grouped_split.GroupedSplit:
    ratios = {r["split"]: r["ratio_bp"] for r in table(spark, d, "split_ratios").collect()}
    rows = _records(spark, d).select("act_id", pub_key(F.col("publication")).alias("publication"), split_key(F.col("split")).alias("split"))
    return grouped_split.grouped_split(rows, "act_id", "publication", ratios, current="split")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Longer ids than a bigint holds are kept together like all others, but can't be told in this column."""
    return _splits(spark, d).keys.where("now_in = 2").select(F.col("key").try_cast("bigint").alias("pub_no")).where("pub_no is not null")


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).assignment.select(F.col("id").alias("act_id"), F.col("root").alias("group_id"), "split")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Acts, groups and share by split."""
    made = _splits(spark, d).assignment
    by = made.groupBy("split").agg(F.count("*").alias("acts"), F.count_distinct("root").alias("groups"))
    every = made.agg(F.count("*").alias("n")).first()[0]
    return by.withColumn("share_bp", F.round(F.col("acts") * 10_000 / every).cast("bigint") if every else F.lit(0).cast("bigint"))


def p3_check(spark: SparkSession, d: str) -> DataFrame:
    """Acts placed, and publications found in several splits afterwards."""
    made = stage(_splits(spark, d).assignment, "assignment")
    told = _records(spark, d).select(F.col("act_id").alias("id"), pub_key(F.col("publication")).alias("publication")).where("publication is not null")
    apart = told.join(made, "id").groupBy("publication").agg(F.count_distinct("split").alias("splits")).where("splits > 1")
    return made.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("acts")).withColumn(
        "publications_apart", apart.agg(F.count("*").alias("n")).scalar())


# 4 -------------------------------------------------------------------------------------------------------------------


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    fields = [F.struct(F.lit(f).alias("field"), F.col(f).alias("text"), F.lit(most).alias("max_chars"), F.lit(over).alias("overlap_chars"))
              for f in ("input", "output") for most, over in [_limit(spark, d, "piece", f)]]
    over_long = F.filter(F.array(*fields), lambda x: F.char_length(x["text"]) > x["max_chars"])
    # a redelivered record has the same text: one of its over-long rows is cut
    long = (
        _records(spark, d).where(F.col("record_id").isNotNull()).select("record_id", "ingested_at", F.inline(over_long))
        .groupBy("record_id", "field", "max_chars", "overlap_chars").agg(F.max_by("text", F.struct("ingested_at", "text")).alias("text"))
    )
    return chunking.split_oversized(long, ["record_id", "field"], "text", "max_chars", "overlap_chars").select(
        "record_id", "piece_no", "start", "stop", "piece", "field")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("piece_no = 0").select("record_id", "field")


def p4_check(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the pieces give when they are put together without their overlaps, and whether the pieces fit."""
    limits = table(spark, d, "size_limits").where("purpose = 'piece'").select("field", "max_chars", "overlap_chars")
    cut = p4_pieces(spark, d).join(limits, "field")
    whole = cut.groupBy("record_id", "field").agg(
        F.sort_array(F.collect_list(F.struct("piece_no", "start", "stop", "piece"))).alias("p"), F.max(F.char_length("piece") - F.col("max_chars")).alias("over"))
    before = lambda i: F.coalesce(F.get("p", i - 1)["stop"], F.lit(0))
    text = F.array_join(F.transform("p", lambda x, i: F.substring(x["piece"], before(i) - x["start"] + 1, F.lit(1 << 30))), "")
    return whole.select("record_id", "field", F.md5(text).alias("text_md5"), (F.col("over") <= 0).alias("fits"))


# 5 and 6 -------------------------------------------------------------------------------------------------------------


def _acts(spark: SparkSession, d: str) -> DataFrame:
    """(act_id, text, split): one row per act; its text is the first record's that has any letter or digit."""
    r = _records(spark, d)
    text = F.when(F.col("input").rlike(r"[\p{L}\p{N}]"), F.col("input"))
    return (
        r.where(F.col("act_id").isNotNull()).groupBy("act_id")
        .agg(F.min_by(text, F.when(text.isNotNull(), F.col("record_id"))).alias("text"), F.max(split_key(F.col("split"))).alias("split"))
    )


def _overlap(spark: SparkSession, d: str, containment: float | None = None) -> overlap.Overlap:
    return overlap.find_overlap(_acts(spark, d), "act_id", "text", "split", k=3, threshold=0.5, containment=containment)


def p5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).expand()


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per act of dev or test that is met in train, with the number of acts met."""
    return _overlap(spark, d).records()


def p5_contained(spark: SparkSession, d: str) -> DataFrame:
    """The same with acts four fifths of which stand in an act of train, however long that is."""
    return _overlap(spark, d, 0.8).records()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    met = p5_overlaps(spark, d)
    return met.select(F.least("eval_id", "train_id").alias("act_id_a"), F.greatest("eval_id", "train_id").alias("act_id_b"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    origin = _records(spark, d).groupBy(F.col("act_id").alias("eval_id")).agg(F.max(pub_no(F.col("publication"))).alias("publication"))
    return overlap.overlap_report(p5_records(spark, d), origin)


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return neardup.near_duplicates(_acts(spark, d), "act_id", "text", k=3, threshold=0.5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    both = neardup.expand(*_near(spark, d))
    return both.select(F.col("a").alias("act_id_a"), F.col("b").alias("act_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per act with at least three words: its group and its number of similar classes."""
    member, pairs, balls = _near(spark, d)
    edges, links = neardup.links(pairs, balls)
    labels, _ = grouped_split.spanning_forest(edges)
    known = links.join(labels.withColumnRenamed("v", "rep"), "rep", "full")
    # a class may hold any share of the acts
    return join_unique(stage(member, "member"), known, ["rep"], how="left").select(
        F.col("id").alias("act_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p6_components(spark: SparkSession, d: str) -> DataFrame:
    """The groups named by their smallest act, and the number of different texts that each act's text is similar to."""
    made = stage(p6_groups(spark, d), "groups")
    first = made.groupBy("group_id").agg(F.min("act_id").alias("first_act_id"))
    return join_unique(made, first, ["group_id"]).select("act_id", "first_act_id", "links")


# 7 -------------------------------------------------------------------------------------------------------------------


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("exact_words >= 12").select("doc_id", "item_id")


def p7_exact(spark: SparkSession, d: str) -> DataFrame:
    """The longest equal run of every document and item that have twelve equal words in a row."""
    return p7_leaks(spark, d).where("exact_words >= 12").select("doc_id", "item_id", "exact_words")


# 8 -------------------------------------------------------------------------------------------------------------------


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), source_key(F.col("source")).alias("source"), "text")


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_weights").withColumn("source", source_key(F.col("source")))


def _mixed_words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    count = F.regexp_count("text", F.lit(r"[^ \t\r\n]+"))
    return mixing.mix(_sources(spark, d).select("id", "source", count.alias("size")), _weights(spark, d), block_units=512)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_words(spark, d)[1].where("short and reached <= wanted").select("source")


def p8_word_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_words(spark, d)[1]


def p8_word_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_words(spark, d)[0].withColumnRenamed("id", "doc_id")


def _mixed_tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pattern = _pattern()
    sized = mixing.token_sizes(_sources(spark, d), "id", "text", ["source"], f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", pattern)
    return mixing.mix(sized, _weights(spark, d), block_units=1024)


def _pattern() -> str:
    import runpy

    return runpy.run_path(f"{TOKENIZERS}/__init__.py")["PATTERN"]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_tokens(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_tokens(spark, d)[1]


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Slots with more than a block or several sources, sources used more often than allowed, and documents used twice in a turn."""
    made, _ = _mixed_tokens(spark, d)
    units = F.sum(F.col("stop") - F.col("start"))
    slots = made.groupBy("slot").agg(units.alias("units"), F.count_distinct("source").alias("sources"))
    turns = made.groupBy("source").agg(F.max("turn").alias("turn")).join(_weights(spark, d), "source")
    twice = made.groupBy("source", "turn", "id").agg(units.alias("units"), (F.max("stop") - F.min("start")).alias("span")).where("units > span")
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    return spark.range(1).select(
        count(slots.where("units > 1024 or sources > 1")).alias("bad_slots"), count(turns.where("turn >= max_repeats")).alias("over_repeats"),
        count(twice).alias("repeated_in_turn"))


# 9 -------------------------------------------------------------------------------------------------------------------


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("score >= 1").select("doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("source", source_key(F.col("source")))
    return abuse.rates(abuse.score_documents(docs, "doc_id", "text", ["source"]), "source")


def p9_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Documents by reviewers' verdict and the grammar's: a document's verdict is that of most of its reviews."""
    said = table(spark, d, "review_labels").where(F.col("abusive").isNotNull()).groupBy("doc_id").agg(F.avg("abusive").alias("a"))
    return (
        p9_scores(spark, d).join(said.where("a <> 0.5"), "doc_id")
        .groupBy((F.col("a") > 0.5).cast("int").alias("reviewed"), (F.col("score") >= 1).cast("int").alias("scored"))
        .agg(F.count("*").alias("documents"))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_report, p1_sample, p2_found, p2_containers, p2_report, p2_check, p3_found, p3_split, p3_report, p3_check,
              p4_found, p4_pieces, p4_check,
              p5_found, p5_overlaps, p5_records, p5_contained, p5_report, p6_found, p6_groups, p6_components, p7_found, p7_leaks, p7_exact, p8_found, p8_word_report,
              p8_word_mix, p8_mix, p8_report, p8_check, p9_found,
              p9_scores, p9_report, p9_agreement)
}
