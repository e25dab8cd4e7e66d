"""Near-duplicate texts: a MinHash LSH forest with exact verification.

Each of ``trees`` tries names a text by ``DEPTH`` MinHash values, ten bits each, so a label is one integer and sorted labels
are the trie. The labels are sorted once, by ranges of (tree, label), and a text stays in a trie only where a neighbour in
sorted order shares the shortest prefix that may ever be asked for. The search starts at whole labels. Texts under one
prefix meet, every pair met is verified on the whole sets, and the similarities of the verified pairs tell how many pairs
like them the prefix length must have missed; while the recall measured so is below the target, the prefixes of all tries
are shortened to the longest length at which such pairs would be met, and what meets anew is verified. ``plan_forest`` bounds the shortening: at its depth even a pair
of exactly the threshold is met with the target probability.

Only classes of equal sets take part. A prefix with more than ``bucket`` classes is not paired up: its members are gathered
into balls of sets that are similar by the triangle inequality, and the rest of their pairs is searched by an exact prefix
filter, which loses no pair, so no cap drops a candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm import textsets, textvec
from tagloom.llm.prefixjoin import prefix_pairs
from tagloom.operators.skew import join_unique
from tagloom.plans.storage import stage

#: Values of a whole label, and bits of each. Two different values are equal in these bits once in 1,024 times; such chance
#: meetings are verified like all others.
DEPTH, BITS = 6, 10


@dataclass(frozen=True)
class Forest:
    depth: int
    trees: int
    recall: float


def met(similarity: float, depth: int, trees: int) -> float:
    """Probability that a pair shares a prefix of ``depth`` values in one of the tries."""
    return 1 - (1 - similarity**depth) ** trees


def plan_forest(threshold: float, recall: float, max_depth: int = DEPTH, most_trees: int = 80) -> Forest:
    """The longest prefix at which ``most_trees`` tries reach the recall for a pair of exactly the threshold, and how many
    tries that takes. The search starts at ``max_depth`` and never goes below this depth."""
    for depth in range(max_depth, 0, -1):
        hit = threshold**depth
        trees = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if trees <= most_trees:
            return Forest(depth, trees, met(threshold, depth, trees))
    raise ValueError("no prefix length reaches the target recall with so few trees")


def labels(sets: DataFrame, trees: int, seed: int = 5) -> DataFrame:
    """(id, n, labels): the label of each set in every trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = textvec.constants(DEPTH * trees, seed)
        b = textvec.constants(DEPTH * trees, seed + 1)
        for batch in batches:
            lists = batch.column("sh")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy().view(np.uint64)
            off = textvec.offsets(counts)
            for lo, hi in textvec.slices(counts, 40_000):
                h, starts = flat[off[lo] : off[hi]], off[lo:hi] - off[lo]
                out = np.zeros((hi - lo, trees), np.int64)
                for t in range(trees):
                    for d in range(t * DEPTH, t * DEPTH + DEPTH):
                        low = np.minimum.reduceat(textvec.mix_light(h * a[d] + b[d]), starts)
                        out[:, t] = (out[:, t] << BITS) | (textvec.mix(low) >> np.uint64(64 - BITS)).astype(np.int64)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * trees, pa.int32()), pa.array(out.ravel()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), rows], names=["id", "n", "labels"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "n", "sh").mapInArrow(run, f"id {kind}, n int, labels array<bigint>")


def tries(labelled: DataFrame, least: int) -> DataFrame:
    """(tree, label, id, n) of the rows that may share ``least`` values with another, in sorted order.

    Ranges are cut by id too, so texts of one label may lie in several. A row stays if a neighbour of its batch shares the
    prefix; the first and last row of a batch stay in any case, since their neighbours are not seen.
    """
    rest = BITS * (DEPTH - least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, prefix = (batch.column(c).to_numpy() for c in ("tree", "label"))
            prefix = prefix >> rest
            like = (tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1])
            keep = np.r_[True, like] | np.r_[like, True]
            yield batch.filter(pa.array(keep))

    rows = labelled.select(F.posexplode("labels").alias("tree", "label"), "id", "n")
    ordered = rows.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label")
    return ordered.mapInArrow(run, ordered.schema)


def similar_pairs(reps: DataFrame, sets: DataFrame, threshold: float, recall: float, bucket: int, **plan) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, na, nb, common) of representatives with similarity >= threshold, a < b; and balls (id, ball).

    Representatives in one ball are all similar to each other; their pairs are not listed. One minus the similarity is a
    metric, so two sets that are both within half the allowed distance of the same centre are within all of it. Balls
    are made under crowded prefixes only.
    """
    forest = plan_forest(threshold, recall, **plan)
    rows = stage(tries(stage(labels(reps, forest.trees), "labels"), forest.depth), "tries")
    links = textsets.at_least(threshold, F.col("na"), F.col("nb"), F.col("common"))
    tested = reps.select(F.col("id").alias("a"), F.col("id").alias("b"), *[F.col("n").alias(c) for c in ("na", "nb", "common")]).limit(0)
    depth = DEPTH
    while True:
        under = rows.withColumn("prefix", F.shiftright("label", BITS * (DEPTH - depth)))
        size = stage(under.groupBy("tree", "prefix").agg(F.count("*").alias("size")).where("size > 1"), "prefixes")
        small = join_unique(under, size.where(F.col("size") <= bucket), ["tree", "prefix"])
        anew = _meeting(small, threshold).join(tested, ["a", "b"], "left_anti")
        tested = tested.unionByName(stage(textsets.verify(anew, sets), "tested"))
        needed = shorten(tested.where(links), threshold, depth, forest, recall)
        if needed == depth:
            break
        depth = needed
    crowded = join_unique(under, size.where(F.col("size") > bucket), ["tree", "prefix"])
    found = tested.where(links)
    balls = reps.select("id", F.col("id").alias("ball")).limit(0)
    if not size.where(F.col("size") > bucket).isEmpty():
        crowded = stage(crowded.select(F.xxhash64("tree", "prefix").alias("label"), "id"), "crowded")
        balls = stage(_balls(crowded, sets, threshold), "balls")
        exact = prefix_pairs(reps.join(balls, "id"), threshold, apart="ball").join(tested, ["a", "b"], "left_anti")
        of_a, of_b = (balls.select(F.col("id").alias(c), F.col("ball").alias(f"ball_{c}")) for c in "ab")
        apart = ~F.col("ball_a").eqNullSafe(F.col("ball_b")) | F.col("ball_a").isNull()
        found = found.unionByName(textsets.verify(exact, sets).where(links))
        found = found.join(of_a, "a", "left").join(of_b, "b", "left").where(apart).select(*tested.columns)
    # a table of the links alone: whoever reads it twice does not search twice
    return stage(found, "pairs"), balls


def _meeting(small: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of texts under one prefix whose sizes allow the similarity; no prefix has many texts."""
    x, y = small.alias("x"), small.alias("y")
    same = (F.col("x.tree") == F.col("y.tree")) & (F.col("x.prefix") == F.col("y.prefix")) & (F.col("x.id") < F.col("y.id"))
    return x.join(y, same & textsets.sizes_allow(threshold, F.col("x.n"), F.col("y.n"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def shorten(found: DataFrame, threshold: float, depth: int, forest: Forest, recall: float) -> int:
    """The depth to go on with: ``depth`` itself if the recall measured on the verified pairs reaches the target.

    A pair of similarity s is met with probability p(s), so each one found at ``depth`` stands for 1 / p(s) there are, of
    which p'(s) / p(s) are met at a shorter prefix. Where even the threshold is met often this is a fair estimate; where
    it isn't, pairs at the threshold might not show at all, so such a depth never is the last.
    """
    s = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))

    def p(d: int) -> Column:
        return 1 - F.pow(1 - F.pow(s, F.lit(d)), F.lit(forest.trees))

    depths = range(depth, forest.depth, -1)
    there, *seen = found.agg(F.sum(1 / p(depth)), *[F.sum(p(d) / p(depth)) for d in depths]).first()
    for d, n in zip(depths, seen):
        if met(threshold, d, forest.trees) >= 0.9 and (not there or n / there >= recall):
            return d
    return forest.depth


def _balls(crowded: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id, ball) of all members of crowded neighbourhoods; a member too far from its centre is a ball of its own.

    The centre of a neighbourhood is the member that is in most crowded ones; each member takes the centre it met most.
    """
    crowded = crowded.select("label", "id")
    known = crowded.join(crowded.groupBy("id").agg(F.count("*").alias("met")), "id")
    centre = known.groupBy("label").agg(F.max(F.struct("met", "id")).alias("c")).select("label", F.col("c.id").alias("centre"))
    voted = join_unique(crowded, centre, ["label"]).groupBy("id", "centre").agg(F.count("*").alias("votes"))
    star = stage(voted.groupBy("id").agg(F.max(F.struct("votes", "centre")).alias("c")).select("id", F.col("c.centre").alias("centre")), "star")
    spokes = star.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))
    # half the distance, rounded down
    close = textsets.verify(spokes, sets, hot_left=True).where(
        textsets.at_least((1 + threshold) / 2 + 1e-6, F.col("na"), F.col("nb"), F.col("common")))
    return star.select("id").join(close.select(F.col("b").alias("id"), F.col("a").alias("ball")), "id", "left").select(
        "id", F.coalesce("ball", "id").alias("ball"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, *, k: int = 5, threshold: float = 0.8,
                    recall: float = 0.9999, bucket: int = 64, **plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership (id, rep); pairs (a, b, na, nb, common) of class representatives at the threshold; balls (id, ball).

    One row per id with at least ``k`` words; texts with equal sets of ``k``-word sequences share a ``rep``. ``id``
    must be unique; rows with null id, null or empty text, or fewer than ``k`` words are in no class and no pair.
    Repeated texts are one class. An empty table gives two empty tables. Other columns of ``df`` are ignored,
    whatever their names. Pairs within a class are not listed: they follow from the membership.
    """
    sets = stage(textsets.text_sets(df.where(F.col(id_col).isNotNull()), id_col, text_col, k), "sets")
    cls = textsets.classes(sets)
    reps = sets.join(cls.select(F.col("rep").alias("id")), "id", "left_semi")
    return textsets.members(sets, cls), *similar_pairs(reps, sets, threshold, recall, bucket, **plan)


def links(pairs: DataFrame, balls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that connect all similar representatives, and (rep, links): how many others each is similar to."""
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(balls.where("id <> ball").select(F.col("ball").alias("u"), F.col("id").alias("v")))
    mates = balls.join(balls.groupBy("ball").agg((F.count("*") - 1).alias("links")), "ball").select(F.col("id").alias("rep"), "links")
    listed = pairs.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("bigint").alias("links"))
    return edges, listed.unionByName(mates).groupBy("rep").agg(F.sum("links").alias("links"))


def expand(member: DataFrame, pairs: DataFrame, balls: DataFrame) -> DataFrame:
    """All pairs of ids (a < b): those between similar classes, in one ball or listed, and those within one class.

    Only for results that must name every pair; the number of rows is the size of that result, not of a search.
    """
    left, right = member.select(F.col("id").alias("i"), F.col("rep").alias("a")), member.select(F.col("id").alias("j"), F.col("rep").alias("b"))
    x, y = balls.alias("x"), balls.alias("y")
    mates = x.join(y, (F.col("x.ball") == F.col("y.ball")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    across = pairs.select("a", "b").unionByName(mates).join(left, "a").join(right, "b")
    within = left.join(right, (F.col("a") == F.col("b")) & (F.col("i") < F.col("j")))
    both = across.select("i", "j").unionByName(within.select("i", "j"))
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
