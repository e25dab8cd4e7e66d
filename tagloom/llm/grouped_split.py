"""Train, dev and test splits that keep related records together.

Items and the keys they share form a bipartite graph. Borůvka rounds pick the least edge of every component and
contract along it; the picked edges are the spanning forest, written as a table, and its roots are the groups. Roots
are banded by size. The few roots that hold a fixed share of everything are dealt one by one to the split furthest
below its target; all others are dealt systematically within their band, by a fixed cycle of slots.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import hash52
from tagloom.operators.ranking import running
from tagloom.operators.skew import join_unique
from tagloom.plans.storage import drop_staged, stage


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (v, root) of all end points and the forest (u, v) of picked edges, both persisted.

    ``edges`` has columns u and v (bigint), in any order and number; self-loops and rows with a null are ignored.
    Each round at least halves the components that still have an outgoing edge, so there are at most log2 of them.
    """
    def lightest(e: DataFrame) -> DataFrame:
        return e.groupBy("c", "d").agg(F.min(F.struct("w", "u", "v")).alias("e"))

    clean = edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now = stage(clean.select(F.col("u").alias("c"), F.col("v").alias("d"), F.struct(F.xxhash64("u", "v").alias("w"), "u", "v").alias("e")), "edges")
    labels = stage(now.select(F.explode(F.array("c", "d")).alias("v")).distinct().select("v", F.col("v").alias("root")), "labels")
    forest = None
    while not now.isEmpty():
        # the least edge of every component, ordered by (weight, ends): a strict order, so no cycle is longer than two
        both = now.unionByName(now.select(F.col("d").alias("c"), F.col("c").alias("d"), "e"))
        picked = stage(both.groupBy("c").agg(F.min(F.struct("e.w", "e.u", "e.v", "d")).alias("m"))
                       .select("c", F.col("m.d").alias("p"), F.col("m.u").alias("u"), F.col("m.v").alias("v")), "picked")
        step = picked.select("u", "v").distinct()
        forest = step if forest is None else forest.unionByName(step)
        # two components that picked each other: the smaller name is the root
        up = picked.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        parent = stage(picked.select("c", "p").join(up, "p").select(
            "c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")), "parent")
        while True:  # pointer doubling: the depth halves each time
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            doubled = stage(join_unique(parent, up, ["p"]).select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "parent")
            drop_staged(parent)
            parent = doubled.select("c", "p")
            if doubled.where("moved").isEmpty():
                break
        to = parent.select("c", F.col("p").alias("r"))
        old = labels
        named = stage(labels.select("root").distinct().join(to, F.col("root") == F.col("c"), "left").select("root", F.coalesce("r", "root").alias("r")), "named")
        labels = stage(join_unique(labels, named, ["root"]).select("v", F.col("r").alias("root")), "labels")
        drop_staged(old)
        before = now
        half = stage(join_unique(now, to, ["c"]).select(F.col("r").alias("c"), F.col("d").alias("__d"), "e"), "half")
        moved = (
            join_unique(half, to.select(F.col("c").alias("__d"), F.col("r").alias("d")), ["__d"]).where(F.col("c") != F.col("d"))
            .select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d"), "e.w", "e.u", "e.v")
        )
        now = stage(lightest(moved), "edges")
        for done in (before, half, named):
            drop_staged(done)
    if forest is None:
        forest = clean.select("u", "v")
    return labels, forest


def cycle(ratios: dict[str, float], slots: int) -> list[str]:
    """``slots`` turns, each given to the split that is furthest behind its ratio: an even interleaving."""
    given, out, total = dict.fromkeys(ratios, 0), [], sum(ratios.values())
    for n in range(1, slots + 1):
        best = max(ratios, key=lambda s: (ratios[s] * n / total - given[s], s))
        given[best] += 1
        out.append(best)
    return out


@dataclass
class GroupedSplit:
    assignment: DataFrame
    """(id, root, split)"""
    forest: DataFrame
    """(u, v): the spanning forest's edges"""
    pair: DataFrame
    """(id, kind, key, rows, lo, hi, u, v): every id with every key, and the first and last of the splits its rows stand in now"""
    labels: DataFrame
    """(v, root): the component of every end point"""
    roots: DataFrame
    """(root, split)"""

    @cached_property
    def keys(self) -> DataFrame:
        """(kind, key, root, split, now_in): each shared key, its group, the split of that, and in how many its rows stand now.

        A key's rows all lie in its component: where a component stands in one split only, so do all its keys.
        """
        named = stage(
            self.pair.where(F.col("key").isNotNull()).groupBy("kind", "key", "v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .join(self.labels, "v").select("kind", "key", "root", "lo", "hi"), "keys")
        spread = named.groupBy("root").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
        apart = (F.col("first") < F.col("last")) & (F.col("lo") < F.col("hi"))
        return join_unique(named, self.roots.join(spread, "root"), ["root"]).select(
            "kind", "key", "root", "split", F.when(F.col("lo").isNull(), 0).when(apart, 2).otherwise(1).alias("now_in"))


def grouped_split(df: DataFrame, id_col: str, key_col: str | list[str], ratios: dict[str, int], *, current: str | None = None,
                  seed: str = "split", big: int = 2000, slots: int = 1000) -> GroupedSplit:
    """Assign every id to a split so that ids connected through shared keys are never separated.

    Rows are (id, key, current split); an id may stand in many rows and with several keys, which then are connected.
    With a list of key columns (author, source, entity) each is a kind of keys of its own; keys are compared as text.
    Weights are row counts. Rows with a null id are ignored; rows with a null key connect nothing, and an id with
    only such rows is a group of its own; a null ``current`` is not counted. Splits without a positive ratio get
    nothing. Groups of more than 1/``big`` of all rows (at most ``big`` of them) are dealt one by one, largest first.
    An empty table gives empty results; other columns are ignored.
    """
    now = F.col(current) if current else F.lit(None).cast("string")
    kinds = [key_col] if isinstance(key_col, str) else list(key_col)
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in kinds])
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), named.alias("keys"), now.alias("now"))
    rows = rows.select("id", F.explode("keys").alias("k"), "now").select("id", "k.kind", "k.key", "now")
    pair = (
        rows.groupBy("id", "kind", "key")
        .agg(F.count("*").alias("rows"), F.min(F.when(F.col("key").isNotNull(), F.col("now"))).alias("lo"),
             F.max(F.when(F.col("key").isNotNull(), F.col("now"))).alias("hi"))
        .withColumns({"u": F.xxhash64(F.lit("item"), "id"), "v": F.xxhash64(F.lit("key"), "kind", "key")})
    )
    pair = stage(pair, "links")
    labels, forest = spanning_forest(pair.where(F.col("key").isNotNull()).select("u", "v"))

    # every kind of keys has all rows of an id
    ids = pair.groupBy("id", "u", "kind").agg(F.sum("rows").alias("rows")).groupBy("id", "u").agg(F.max("rows").alias("rows"))
    item = (  # both sides have one row per id
        ids.join(labels.select(F.col("v").alias("u"), "root"), "u", "left")
        .select("id", F.coalesce("root", "u").alias("root"), "rows")
    )
    item = stage(item, "items")
    groups = item.groupBy("root").agg(F.sum("rows").alias("rows"))
    total = item.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    # at most `big` groups can each hold more than total / big rows
    wanted = {s: r for s, r in sorted(ratios.items()) if r > 0}
    need = {s: total * r / sum(wanted.values()) for s, r in wanted.items()}
    is_big = F.col("rows") * big > total
    giants = [(r["rows"], r["root"]) for r in groups.where(is_big).collect()]
    dealt = []
    queue = [(-need[s], s) for s in need]
    heapq.heapify(queue)
    for size, root in sorted(giants, key=lambda g: (-g[0], g[1])):
        lack, s = heapq.heappop(queue)
        dealt.append((root, s))
        heapq.heappush(queue, (lack + size, s))
    left = {s: max(-lack, 0.0) for lack, s in queue}
    turns = cycle(left if sum(left.values()) > 0 else dict(wanted), slots)

    small = groups.where(~is_big).select(
        "root", F.floor(F.log2("rows")).cast("int").alias("band"), hash52(seed, F.col("root")).alias("h"))
    ranked = running(small, ["band"], "h", ["root"], None, "rank")
    # each band starts the cycle elsewhere, so that short bands do not all favour its first turns
    turn = F.pmod(F.col("rank") + F.col("band") * (slots * 38 // 100 + 1), F.lit(slots)).cast("int") + 1
    by_root = ranked.select("root", F.element_at(F.array(*map(F.lit, turns)), turn).alias("split"))
    if dealt:
        by_root = by_root.unionByName(df.sparkSession.createDataFrame(dealt, "root bigint, split string"))
    roots = stage(by_root, "roots")
    assignment = join_unique(item, roots, ["root"]).select("id", "root", "split")
    return GroupedSplit(assignment, forest, pair, labels, roots)
