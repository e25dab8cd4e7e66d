"""Texts as sets of hashed word sequences, and groups of texts with equal sets.

Shared by the near-duplicate groups and the overlap between splits. Exact copies are taken together before any
search: only one representative of each class of equal sets is compared, and its members are joined back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import textvec
from tagloom.operators.skew import join_unique
from tagloom.plans.storage import stage


def text_sets(df: DataFrame, id_col: str, text_col: str, k: int, carry: list[str] = ()) -> DataFrame:
    """(id, carry..., n, k1, k2, sh): the text's distinct ``k``-word sequences as sorted 64-bit hashes.

    ``k1`` and ``k2`` are 128 bits over the whole set, equal for equal sets. Texts with fewer than ``k`` words, null
    and empty ones are left out. ``id`` must be unique and not null.
    """
    kept = df.select(F.col(id_col).alias("id"), *carry, F.col(text_col).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = textvec.word_hashes(batch.column("__text").to_pylist())
            for a, b in textvec.slices(counts, 200_000):
                off = textvec.offsets(counts)
                sh, n = textvec.shingles(words[off[a] : off[b]], counts[a:b], k)
                rows = np.flatnonzero(n > 0)
                if not len(rows):
                    continue
                n = n[rows]
                starts = textvec.offsets(n)
                k1 = np.add.reduceat(textvec.mix(sh + np.uint64(7)), starts[:-1])
                k2 = np.add.reduceat(textvec.mix(sh ^ np.uint64(0x5DEECE66D)), starts[:-1])
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(sh.view(np.int64)))
                some = batch.slice(a, b - a).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [some.column(f.name) for f in fields]
                    + [pa.array(n.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists],
                    names=[f.name for f in fields] + ["n", "k1", "k2", "sh"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(run, f"{schema}, n int, k1 bigint, k2 bigint, sh array<bigint>")


def classes(sets: DataFrame, *aggs) -> DataFrame:
    """(rep, k1, k2, copies, aggs...): one row per class of equal sets, as a table; ``rep`` is its smallest id."""
    return stage(sets.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *aggs), "classes")


def members(sets: DataFrame, cls: DataFrame, *carry: str) -> DataFrame:
    """(id, rep, carry...): which class each text is in; a class may hold any share of the texts."""
    return join_unique(sets.select("id", "k1", "k2", *carry), cls.select("k1", "k2", "rep"), ["k1", "k2"]).drop("k1", "k2")


#: Of so few pairs the ids are broadcast, and only the sets they name are shuffled.
FEW_PAIRS = 1_000_000


def verify(pairs: DataFrame, sets: DataFrame, hot_left: bool = False) -> DataFrame:
    """(a, b, na, nb, common) of candidate pairs of ids, counted on the whole sets; ``hot_left``: a few ``a`` stand in most pairs."""
    pairs = stage(pairs.select("a", "b"), "candidates")
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if pairs.count() <= FEW_PAIRS:
        sets = sets.join(F.broadcast(named), "id", "left_semi")
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sh").alias("__sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sh").alias("__sb"))
    return (
        (join_unique(pairs, left, ["a"], share=200) if hot_left else pairs.join(left, "a")).join(right, "b")
        .select("a", "b", "na", "nb", F.size(F.array_intersect("__sa", "__sb")).alias("common"))
    )


def at_least(threshold: float, na, nb, common):
    """Whether common / (na + nb - common) >= threshold, in whole numbers: no rounding decides a case."""
    scaled = round(threshold * 1_000_000)
    return common.cast("bigint") * 1_000_000 >= (na + nb - common).cast("bigint") * scaled


def sizes_allow(threshold: float, na, nb):
    """Whether two sets of these sizes can have the similarity at all."""
    scaled = round(threshold * 1_000_000)
    return (na.cast("bigint") * 1_000_000 >= nb * scaled) & (nb.cast("bigint") * 1_000_000 >= na * scaled)
