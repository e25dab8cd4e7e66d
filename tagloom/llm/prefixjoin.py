"""Exact candidate search for set similarity: an inverted index over the rarest elements of each set.

Sets of similarity >= s share at least ceil(s * n) elements of either, so in any fixed order of all elements they share
at least ``hits`` of the first n - ceil(s * n) + hits of them. Putting frequent elements last keeps the index lists
short. The order takes the frequencies of the most frequent elements only (a bounded list); any order is exact, so that
bound changes the work and never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import bitmap, textvec
from tagloom.llm.textsets import sizes_allow

_LOW = 0x7FFFFFFF


def frequent_elements(sets: DataFrame, most: int = 200_000, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent elements (31 bits of each) and their counts over all sets, sorted by element."""
    short = sets.select(F.explode("sh").alias("e")).select(F.col("e").bitwiseAND(_LOW).cast("int").alias("e"))
    top = (
        short.groupBy("e").agg(F.count("*").alias("c")).where(F.col("c") >= least)
        .orderBy(F.desc("c"), "e").limit(most)
    ).toPandas()
    e = top["e"].to_numpy(np.int32)
    order = np.argsort(e)
    return e[order], top["c"].to_numpy(np.int64)[order]


#: Entries of one element that are joined in one piece; longer lists are cut into pieces that meet each other piece by piece.
PIECE = 20_000


def prefixes(sets: DataFrame, threshold: float, hits: int, frequent: tuple[np.ndarray, np.ndarray], carry: list[str] = ()) -> DataFrame:
    """(e, pieces, id, n, carry...): the index entries of each set; ``pieces`` is into how many pieces the element's list is cut."""
    scaled = round(threshold * 1_000_000)
    return _entries(sets, frequent, carry, lambda counts: counts - -(-counts * scaled // 1_000_000) + hits)


def all_entries(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], among: np.ndarray) -> DataFrame:
    """(e, pieces, id, n): every element of each set that may be in the filter ``among`` (:mod:`bitmap`)."""
    return _entries(sets, frequent, [], lambda counts: counts, among)


def _entries(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], carry: list[str], most: Callable[[np.ndarray], np.ndarray],
             among: np.ndarray | None = None) -> DataFrame:
    kept = sets.select("id", "n", *carry, "sh")
    fields = [f for f in kept.schema.fields if f.name != "sh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, freq = frequent
        for batch in batches:
            lists = batch.column("sh")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = lists.flatten().to_numpy().view(np.uint64)
            doc = np.repeat(np.arange(len(counts)), counts)
            if among is not None:
                maybe = bitmap.test(among, h)
                h, doc = h[maybe], doc[maybe]
                counts = np.bincount(doc, minlength=len(counts))
            rank = np.zeros(len(h), np.int64)
            if len(known) and len(h):
                low = (h & np.uint64(_LOW)).astype(np.int32)
                at = np.minimum(np.searchsorted(known, low), len(known) - 1)
                rank = np.where(known[at] == low, freq[at], 0)
            order = np.lexsort((h, rank, doc))
            h, doc, rank = h[order], doc[order], rank[order]
            place = np.arange(len(h)) - textvec.offsets(counts)[doc]
            keep = place < most(counts)[doc]
            take = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[keep].view(np.int64)), pa.array((rank[keep] // PIECE + 1).astype(np.int32))] + [batch.column(f.name).take(take) for f in fields],
                names=["e", "pieces"] + [f.name for f in fields])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(run, f"e bigint, pieces int, {schema}")


def _pieces(index: DataFrame, mine: str, other: str) -> DataFrame:
    """Every entry with its own piece, once for each piece of the other side."""
    own = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    return index.withColumn(mine, own).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))


def shared_prefixes(left: DataFrame, right: DataFrame, threshold: float, hits: int, same_side: bool, apart: str | None = None,
                    contained: bool = False, cut: bool = True) -> DataFrame:
    """(a, b) that share ``hits`` index entries and whose sizes allow the similarity; not those with the same ``apart``.

    Sets smaller than ``hits`` can share fewer entries; for them all their shared entries are asked for instead. With
    ``contained`` the threshold is the share of the left set that the right one holds. With ``cut``, lists of more than
    ``PIECE`` entries are cut into pieces on both sides, so that no task joins a whole list of a frequent element.
    """
    keys = ["e"]
    if cut:
        left, right, keys = _pieces(left, "p", "q"), _pieces(right, "q", "p"), ["e", "p", "q"]
    x, y = left.alias("x"), right.alias("y")
    scaled = round(threshold * 1_000_000)
    need = f"({'x.n' if contained else 'least(x.n, y.n)'} * {scaled}L + 999999L) div 1000000L"
    sizes = F.col("y.n").cast("bigint") * 1_000_000 >= F.col("x.n") * scaled if contained else sizes_allow(threshold, F.col("x.n"), F.col("y.n"))
    order = F.col("x.id") < F.col("y.id") if same_side else F.col("x.id") != F.col("y.id")
    if apart:
        order = order & (F.col(f"x.{apart}") != F.col(f"y.{apart}"))
    for k in keys:
        order = order & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    return (
        x.join(y, sizes & order)
        .groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .agg(F.count("*").alias("got"), F.max(F.expr(need)).alias("need"))
        .where(F.col("got") >= F.least(F.lit(hits), F.col("need")))
        .select("a", "b")
    )


def has_long_lists(frequent: tuple[np.ndarray, np.ndarray]) -> bool:
    return bool(len(frequent[1])) and int(frequent[1].max()) >= PIECE


def prefix_pairs(sets: DataFrame, threshold: float, hits: int = 4, apart: str | None = None) -> DataFrame:
    """Candidate pairs (a, b), a < b, among ``sets``: every pair at the threshold is among them, but for those with
    the same value of the column ``apart`` (never null), if one is named."""
    frequent = frequent_elements(sets)
    index = prefixes(sets, threshold, hits, frequent, [apart] if apart else [])
    return shared_prefixes(index, index, threshold, hits, same_side=True, apart=apart, cut=has_long_lists(frequent))
