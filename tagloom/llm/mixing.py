"""A mix of sources with target shares, from a low-discrepancy schedule.

The documents of each source are put in hash order and cut into blocks of equally many units (tokens or words). Slot n
of the schedule takes the point frac(n * golden ratio), computed in whole numbers, through the cumulative weights to a
source; the slot's rank among its source's slots picks the block. After its last document a source starts over, at most
``max_repeats`` times in all; slots beyond that stay empty and are reported as shortfall.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import hash52
from tagloom.operators.ranking import HASH_BITS, running
from tagloom.plans.storage import stage

#: 2**32 divided by the golden ratio, rounded to an odd number.
GOLDEN = 2654435769
POINTS = 1 << 32
#: Points are told apart by pieces of this length first.
PIECE = 1 << 20
#: The largest vocabulary file that is broadcast.
MOST_BYTES = 64 << 20


def token_sizes(df: DataFrame, id_col: str, text_col: str, carry: list[str], ranks_file: str, pattern: str) -> DataFrame:
    """(id, carry..., size): tokens of each text in a byte-level BPE vocabulary; null and empty texts have 0.

    ``ranks_file`` holds base64 token and rank by line, ``pattern`` is the vocabulary's splitting pattern. The driver reads
    the file and broadcasts it (up to ``MOST_BYTES``), so executors need no copy. Strings of special tokens are ordinary text.
    """
    if os.path.getsize(ranks_file) > MOST_BYTES:
        raise ValueError(f"a vocabulary of more than {MOST_BYTES} bytes")
    with open(ranks_file, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    kept = df.select(F.col(id_col).alias("id"), *carry, F.col(text_col).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_file, pattern, shared.value)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            sizes = [sum(len(encoder.encode_ordinary(p)) for p in _parts(t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + [pa.array(sizes, pa.int64())], names=[f.name for f in fields] + ["size"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(run, f"{schema}, size bigint")


_BETWEEN = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def _parts(text: str, most: int = 1_000_000) -> Iterator[str]:
    """A long text in parts, cut before a single space between letters: there a token ends in any case."""
    start = 0
    while len(text) - start > most:
        cut = _BETWEEN.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


_ENCODERS: dict = {}


def _encoder(ranks_file: str, pattern: str, content: bytes | None = None):
    """One encoder per worker process and vocabulary; ``content`` is that of the file, where it isn't at hand."""
    if (ranks_file, pattern) not in _ENCODERS:
        import base64

        import tiktoken

        if content is None:
            with open(ranks_file, "rb") as file:
                content = file.read()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        _ENCODERS[ranks_file, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[ranks_file, pattern]


def mix(sized: DataFrame, weights: DataFrame, *, block_units: int, total: int | None = None, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The mix (slot, source, turn, id, start, stop) and the report, one row per weighted source.

    ``sized`` is (id, source, size), one row per document; ``weights`` is (source, target_bp, max_repeats), one row
    per source. [start, stop) are the units of the document that stand in the slot, ``turn`` counts the repeats. The
    mix is meant to have ``total`` units (default: all units of documents with a source), in slots of ``block_units``. Report columns: source, target_bp, max_repeats, units,
    allowed (units * max_repeats), wanted, reached (counted in the mix), share_bp (of the mix), short: whether even all
    allowed repeats fall short of the target. There may be any number of weighted sources.

    Documents with null source belong to none; sources without a weight are not drawn but count in the total; null or
    non-positive sizes hold no units; a weighted source without documents is reported with 0 units; null ids are kept
    as ids. Repeated rows are documents of their own. An empty table gives an empty mix and a full report.
    """
    docs = stage(
        sized.where(F.col("source").isNotNull()).select("id", "source", F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"))
        .where(F.col("size") >= 0).withColumn("h", hash52(seed, F.coalesce(F.col("id").cast("string"), F.lit("")))), "sized")
    units = docs.groupBy("source").agg(F.sum("size").alias("units"))
    plan = stage(
        weights.select("source", F.coalesce("target_bp", F.lit(0)).cast("bigint").alias("target_bp"),
                       F.coalesce("max_repeats", F.lit(0)).cast("bigint").alias("max_repeats"))
        .join(units, "source", "left").withColumn("units", F.coalesce("units", F.lit(0))), "plan")
    everything = docs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    goal = everything if total is None else total
    slots = -(-goal // block_units)

    # each source's stretch of the points, cut at fixed places, so that slots find it by an equal piece of their point
    scale = max(plan.agg(F.coalesce(F.sum("target_bp"), F.lit(0))).first()[0], 10_000)
    upto = F.sum("target_bp").over(Window.orderBy("source"))  # over the table of settings, one row per weighted source
    stretch = plan.withColumn("upto", upto).select(
        "source", F.expr(f"(upto - target_bp) * {POINTS} div {scale}").alias("low"), F.expr(f"upto * {POINTS} div {scale}").alias("high"))
    stretch = stretch.where("low < high").withColumn("piece", F.explode(F.expr(f"sequence(low div {PIECE}, (high - 1) div {PIECE})")))
    stretch = stage(stretch, "stretches")
    spark = sized.sparkSession
    point = (F.col("n") * GOLDEN) % POINTS
    n = spark.range(slots).select(F.col("id").alias("n"), point.alias("point"), (F.expr(f"id * {GOLDEN} % {POINTS} div {PIECE}")).alias("piece"))
    slot = stage(n.join(stretch, "piece").where("low <= point and point < high").select("n", "source"), "slots")
    # slot numbers in the leading bits, so that the ranking is by slot
    shift = HASH_BITS - max(slots, 1).bit_length()
    ranked = running(slot.withColumn("order", F.shiftleft("n", shift)), ["source"], "order", [], None, "rank")

    taken = ranked.groupBy("source").agg(F.count("*").alias("slots"))
    offer = plan.join(taken, "source", "left").withColumn("slots", F.coalesce("slots", F.lit(0))).withColumns({
        "allowed": F.col("units") * F.col("max_repeats"),
        "most": F.least(F.col("slots") * block_units, F.col("units") * F.col("max_repeats"))})

    # the source's documents one after the other, over and over: a slot of rank r takes units [r, r + 1) * block_units
    placed = running(docs.where(F.col("size") > 0), ["source"], "h", ["id"], "size", "begin")
    using = offer.where(F.col("most") > 0).select("source", "units", "most", F.expr("(most - 1) div units").alias("last_turn"))
    first = F.col("turn") * F.col("units") + F.col("begin")
    stop = F.least(F.col("first") + F.col("size"), F.col("most"))
    block = F.col("rank") * block_units
    parts = (
        placed.join(using, "source")
        .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_turn"))))
        .withColumn("first", first).withColumn("stop", stop).where(F.col("first") < F.col("stop"))
        .withColumn("rank", F.explode(F.expr(f"sequence(first div {block_units}, (stop - 1) div {block_units})")))
        .select("source", "rank", "turn", "id", F.greatest(block - F.col("first"), F.lit(0)).alias("start"),
                (F.least(block + block_units, F.col("stop")) - F.col("first")).alias("stop"))
    )
    mixed = stage(ranked.select("source", "rank", F.col("n").alias("slot")).join(parts.hint("merge"), ["source", "rank"]).select(
        "slot", "source", "turn", "id", "start", "stop"), "mix")
    reached = mixed.groupBy("source").agg(F.sum(F.col("stop") - F.col("start")).alias("reached"))
    report = offer.join(reached, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).select(
        "source", "target_bp", "max_repeats", "units", "allowed", F.expr(f"target_bp * {goal} div 10000").alias("wanted"), "reached",
        (F.col("units").cast("decimal(38,0)") * F.col("max_repeats") * 10_000 < F.col("target_bp").cast("decimal(38,0)") * goal).alias("short"))
    every = F.sum("reached").over(Window.partitionBy(F.lit(0)))  # over the report: one row per weighted source
    report = report.withColumn("share_bp", F.coalesce(F.round(F.try_divide(F.col("reached") * 10_000, every)), F.lit(0)).cast("bigint"))
    return mixed, report

