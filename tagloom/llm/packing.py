"""Items packed into containers of fixed capacity by a grouping genetic algorithm.

A gene is a whole container. Crossover injects well-filled containers of one parent into the other, drops the
containers there that hold an injected item twice, and puts the displaced items back by best fit. Items are dealt by
hash into blocks of a bounded size; each block evolves on several islands, which hand their best solution to the next
island between rounds. A block is a row, an island of it a part of a task's work: no step sees more than a block.

Every block leaves some containers part-filled. These are dealt to new blocks, whole and from many old ones together, and
evolve again from the solution they come with: so containers migrate between blocks, and what one block lacks to fill a
container another one may have.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.plans.storage import stage

_SHIFT = 1 << 20


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, rest: list[int], capacity: int) -> int:
    """Put ``items`` (in the given order) into the fullest containers that take them; returns the number of containers.

    ``rest`` is the free room of the containers so far; ``bins`` gets the container of each item.
    """
    free = sorted(r * _SHIFT + b for b, r in enumerate(rest))
    n = len(rest)
    for item, size in zip(items.tolist(), sizes[items].tolist()):
        at = bisect_left(free, size * _SHIFT)
        if at == len(free):
            b, room = n, capacity
            n += 1
        else:
            room, b = divmod(free.pop(at), _SHIFT)
        bins[item] = b
        if room > size:
            insort(free, (room - size) * _SHIFT + b)
    return n


def swap_in(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, rest: list[int]) -> np.ndarray:
    """Exchange placed items for larger free ones that fit better; returns the items that are free afterwards.

    Every exchange fills a container further and leaves a smaller item free, which is easier to place.
    """
    free = sorted(zip(sizes[items].tolist(), items.tolist()))
    keys = [f[0] for f in free]
    placed = np.flatnonzero(bins >= 0)
    placed = placed[np.asarray(rest, np.int64)[bins[placed]] > 0] if len(free) else placed[:0]
    for item, b, size in zip(placed.tolist(), bins[placed].tolist(), sizes[placed].tolist()):
        room = rest[b]
        if not room:
            continue
        at = bisect_right(keys, size + room) - 1
        if at >= 0 and keys[at] > size:
            larger, other = free.pop(at)
            keys.pop(at)
            bins[other], bins[item] = b, -1
            rest[b] = room + size - larger
            back = bisect_left(keys, size)
            free.insert(back, (size, item))
            keys.insert(back, size)
    return np.array([i for _, i in reversed(free)], dtype=np.int64)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the containers: full containers beside an empty one beat two half-full ones."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return float((fill * fill).sum() / len(fill)) if len(fill) else 1.0


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child: well-filled containers of ``a`` whole, the containers of ``b`` they leave intact, the rest by best fit."""
    fill_a, fill_b = np.bincount(a, weights=sizes), np.bincount(b, weights=sizes)
    good = np.flatnonzero(fill_a >= np.median(fill_a))
    inject = np.zeros(len(fill_a), bool)
    inject[good[rng.random(len(good)) < 0.7]] = True
    injected = inject[a]
    broken = np.zeros(len(fill_b), bool)
    broken[b[injected]] = True
    intact = np.flatnonzero(~broken)
    if len(intact) > 3:  # mutation: the emptiest containers are dissolved
        broken[intact[np.argpartition(fill_b[intact], 3)[:3]]] = True
    kept = ~injected & ~broken[b]
    child = np.full(len(sizes), -1, np.int32)
    new_a, new_b = np.cumsum(inject) - 1, np.cumsum(~broken) - 1
    n_a = int(inject.sum())
    child[injected] = new_a[a[injected]]
    child[kept] = n_a + new_b[b[kept]]
    # an intact container of b may hold nothing but items that were injected; it can't: then it would be broken
    rest = (capacity - np.concatenate([fill_a[inject], fill_b[~broken]])).astype(np.int64).tolist()
    best_fit(sizes, swap_in(sizes, np.flatnonzero(child < 0), child, rest), child, rest, capacity)
    return child


def evolve(sizes: np.ndarray, capacity: int, given: list[np.ndarray], seed: int, population: int, generations: int) -> np.ndarray:
    """The best solution after some generations on one island; ``sizes`` fall, ``given`` are solutions to start from."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    pool = [(fitness(sizes, s, capacity), s) for s in given]
    while len(pool) < population:
        order = np.arange(len(sizes)) if not pool else np.argsort(-sizes * rng.uniform(0.8, 1.2, len(sizes)), kind="stable")
        bins = np.empty(len(sizes), np.int32)
        best_fit(sizes, order, bins, [], capacity)
        pool.append((fitness(sizes, bins, capacity), bins))
    for _ in range(generations):
        pool = list({round(s[0], 12): s for s in pool}.values())  # solutions of equal fitness are near copies: one stays
        pool.sort(key=lambda s: -s[0])
        if not len(sizes) or int(pool[0][1].max()) + 1 == least:
            break
        pool = pool[: max(2, population // 2)]
        made = []
        for _ in range(population - population // 2):
            i, j = rng.integers(len(pool), size=2)
            child = crossover(sizes, pool[i][1], pool[j][1], capacity, rng)
            made.append((fitness(sizes, child, capacity), child))
        pool += made
    return max(pool, key=lambda s: s[0])[1]


_ENTRY = "array<struct<less:bigint,id:{kind},piece_no:int,start:bigint,box:bigint>>"


def _evolved(block: DataFrame, blocks: int, capacity: int, islands: int, rounds: int, population: int, generations: int) -> DataFrame:
    """(block, bin, entries, used): the containers of each block's best solution.

    ``block`` is (block, entries) with the entries in falling size; ``box`` of an entry is the container it comes in, if any.
    """
    block = stage(block, "blocks")
    # the cost is in the islands, not in bytes: a few of them a task, however small the table
    tasks = max(1, min(blocks * islands, max(block.sparkSession.sparkContext.defaultParallelism, blocks * islands // 32)))

    def island(frames: Iterator[pd.DataFrame], last_round: bool, turn: int) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for b, i, sizes, given in zip(frame["block"], frame["island"], frame["sizes"], frame["given"]):
                sizes = np.asarray(sizes, np.int64)
                start = [] if given is None else [np.unique(g, return_inverse=True)[1].astype(np.int32) for g in given]
                # migrants come in no fixed order: fix it, so that a repeated task gives the same result
                start.sort(key=lambda s: s.tobytes())
                best = evolve(sizes, capacity, start, (int(b) * islands + int(i)) * 31 + turn, population, generations)
                score = fitness(sizes, best, capacity)
                for to in {i} if last_round else {i, (i + 1) % islands}:
                    rows.append((b, to, sizes, best, score))
            yield pd.DataFrame(rows, columns=["block", "island", "sizes", "bins", "score"])

    came = F.when(F.exists("entries", lambda e: e["box"].isNotNull()), F.array(F.transform("entries", lambda e: e["box"])))
    state = block.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                         F.transform("entries", lambda e: (-e["less"]).cast("int")).alias("sizes"),
                         came.alias("given")).repartition(tasks, "block", "island")
    for turn in range(rounds):
        final = turn == rounds - 1
        evolved = state.mapInPandas(
            lambda frames, final=final, turn=turn: island(frames, final, turn),
            "block int, island int, sizes array<int>, bins array<int>, score double")
        if not final:
            state = evolved.repartition(tasks, "block", "island").groupBy("block", "island").agg(
                F.any_value("sizes").alias("sizes"), F.collect_list("bins").alias("given"))
    best = evolved.groupBy("block").agg(F.max_by("bins", F.struct("score", -F.col("island"))).alias("bins"))
    placed = block.join(best, "block").select("block", F.explode(F.arrays_zip("entries", "bins")).alias("z"))
    return placed.groupBy("block", F.col("z.bins").alias("bin")).agg(
        F.sort_array(F.collect_list("z.entries")).alias("entries"), (-F.sum("z.entries.less")).alias("used"))


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, *, block_items: int = 800, islands: int = 3,
         rounds: int = 2, population: int = 6, generations: int = 10, spare: float = 0.005) -> DataFrame:
    """(id, piece_no, start, size, container): which container each item, or piece of one, is put into.

    An item larger than ``capacity`` is cut into full pieces and a remainder, and nothing else is cut; ``start`` is the
    piece's place in the item. Full pieces are containers of their own. Null and non-positive sizes and null ids are
    left out; of an id given several times the largest size counts; ties are broken by id. An empty table gives an
    empty result. Other columns are ignored. Containers with more than the share ``spare`` of room evolve a second time.
    Containers are named by pass, block and number, full pieces by item.
    """
    kind = items.schema[id_col].dataType.simpleString()
    whole = (
        items.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("size"))
        .where(F.col("id").isNotNull() & (F.col("size") > 0)).groupBy("id").agg(F.max("size").alias("size"))
    )
    whole = stage(whole, "items")
    rest = F.expr(f"(size - 1) % {capacity} + 1")
    last = whole.select("id", ((F.col("size") - rest) / capacity).cast("int").alias("piece_no"),
                        (F.col("size") - rest).alias("start"), rest.cast("bigint").alias("size"))
    full = (
        whole.where(F.col("size") > capacity)
        .select("id", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {capacity} - 1 as int)"))).alias("piece_no"))
        .select("id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("size"),
                F.concat(F.lit("f"), F.col("id").cast("string"), F.lit("."), F.col("piece_no").cast("string")).alias("container"))
    )
    how = (capacity, islands, rounds, population, generations)
    entries = F.sort_array(F.collect_list("entry")).cast(_ENTRY.format(kind=kind)).alias("entries")
    blocks = max(1, -(-last.count() // block_items))
    dealt = last.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        F.struct((-F.col("size")).alias("less"), "id", "piece_no", "start", F.lit(None).cast("bigint").alias("box")).alias("entry"))
    first = stage(_evolved(dealt.groupBy("block").agg(entries), blocks, *how), "first")
    roomy = (F.col("used") < capacity * (1 - spare)) if blocks > 1 else F.lit(False)
    count = first.where(roomy).agg(F.coalesce(F.sum(F.size("entries")), F.lit(0))).first()[0]
    blocks = max(1, -(-count // block_items))
    box = F.col("block").cast("bigint") * (1 << 31) + F.col("bin")
    again = first.where(roomy).select(F.pmod(F.xxhash64(box), F.lit(blocks)).cast("int").alias("block"), box.alias("box"), F.explode("entries").alias("e")).select(
        "block", F.struct("e.less", "e.id", "e.piece_no", "e.start", "box").alias("entry"))
    second = _evolved(again.groupBy("block").agg(entries), blocks, *how)

    def named(boxes: DataFrame, turn: str) -> DataFrame:
        return boxes.select(
            F.explode("entries").alias("e"),
            F.concat(F.lit(turn), F.col("block").cast("string"), F.lit("."), F.col("bin").cast("string")).alias("container")
        ).select("e.id", "e.piece_no", "e.start", (-F.col("e.less")).alias("size"), "container")

    return named(first.where(~roomy), "a").unionByName(named(second, "b")).unionByName(full)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, items, pieces, used, room, fill, least_containers): one row on the whole packing."""
    boxes = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("pieces"), F.count_if(F.col("start") == 0).alias("items"))
    return boxes.agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("pieces").alias("pieces"), F.sum("used").alias("used"),
        (F.count("*") * capacity - F.sum("used")).alias("room"), F.try_divide(F.sum("used"), F.count("*") * capacity).alias("fill"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"))
