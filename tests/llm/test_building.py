"""Sampling, packing, splitting, cutting and mixing: invariants, exactness and edge cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import chunking, grouped_split, mixing, packing, sampling

CELLS = ["act", "kind"]


def sample_tables(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaaaaab"), rng.choice(["x", "y", None])) for i in range(3000)]
    rows += rows[:200] + [(None, "a", "x"), (5000, None, "x"), (5001, "c", "x")]
    records = spark.createDataFrame([(*r, "own", 9) for r in rows], "rid long, act string, kind string, wanted string, bin int")
    targets = spark.createDataFrame([("a", "x", 4000, 0), ("b", "x", 3000, 0), ("b", "y", 10, 25), ("c", "x", 0, 7), ("z", "z", 100, 0), ("a", "y", None, None)],
                                    "act string, kind string, target_bp int, min_rows int")
    return rows, records, targets


@pytest.mark.parametrize(("oversample", "ranges"), [(1.1, 256), (0.2, 4), (5.0, 1)])
def test_sample_is_exact(spark, oversample, ranges):
    rows, records, targets = sample_tables(spark)
    sample, report = sampling.proportional_sample(records, targets, "rid", CELLS, oversample=oversample, ranges=ranges)
    supply = Counter((a, k) for _, a, k in set(r for r in rows if None not in r))
    n = len({i for i, _, _ in rows if i is not None}) // 10
    got = {(r.act, r.kind): r for r in report.collect()}
    assert len(got) == 6
    for key, (bp, least) in {("a", "x"): (4000, 0), ("b", "x"): (3000, 0), ("b", "y"): (10, 25), ("c", "x"): (0, 7), ("z", "z"): (100, 0), ("a", "y"): (0, 0)}.items():
        wanted = max(least, -(-bp * n // 10000))
        assert (got[key].wanted, got[key].supply) == (wanted, supply[key])
        assert (got[key].taken, got[key].deficit) == (min(wanted, supply[key]), max(0, wanted - supply[key]))
    drawn = sample.collect()
    assert Counter((r.act, r.kind) for r in drawn) == Counter({k: r.taken for k, r in got.items()})
    assert len({r.id for r in drawn}) == len(drawn)
    again = sampling.proportional_sample(records.repartition(7), targets, "rid", CELLS)[0]
    assert {r.id for r in again.collect()} == {r.id for r in drawn}, "neither partitioning nor the oversampling changes the sample"


def test_sample_of_nothing(spark):
    _, records, targets = sample_tables(spark)
    sample, report = sampling.proportional_sample(records.limit(0), targets, "rid", CELLS)
    assert sample.count() == 0 and {r.supply for r in report.collect()} == {0}
    sample, report = sampling.proportional_sample(records, targets.limit(0), "rid", CELLS)
    assert (sample.count(), report.count()) == (0, 0)


def check_packing(rows, capacity, got):
    want = defaultdict(int)
    for i, s in rows:
        if i is not None and (s or 0) > 0:
            want[i] = max(want[i], s)
    pieces = defaultdict(list)
    fill = Counter()
    for r in got:
        pieces[r.id].append((r.piece_no, r.start, r.size))
        fill[r.container] += r.size
    assert set(pieces) == set(want)
    for i, ps in pieces.items():
        ps.sort()
        assert [p[0] for p in ps] == list(range(len(ps))) and ps[0][1] == 0
        assert all(a[1] + a[2] == b[1] for a, b in zip(ps, ps[1:])) and ps[-1][1] + ps[-1][2] == want[i]
        assert len(ps) == -(-want[i] // capacity), "only what exceeds the capacity is divided"
    assert max(fill.values(), default=0) <= capacity
    return fill


def test_packing_is_tight_and_whole(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.choice([300, 500, 900, 1500, 2600]) * rng.uniform(0.5, 1.5))) for i in range(900)]
    rows += [(1000, 4000), (1001, 4001), (1002, 20_000), (1003, 0), (1004, None), (None, 50), (1005, -3), (7, 10), (1006, 1)]
    df = spark.createDataFrame([(i, s, "b", 1) for i, s in rows], "rid long, chars long, container string, block int")
    packed = packing.pack(df, "rid", "chars", 4000, block_items=300)
    got = packed.collect()
    fill = check_packing(rows, 4000, got)
    report = packing.packing_report(packed, 4000).first()
    assert (report.containers, report.used) == (len(fill), sum(fill.values()))
    assert report.containers <= 1.03 * report.least_containers + 3
    same = packing.pack(df.repartition(5), "rid", "chars", 4000, block_items=300).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, got))


def test_packing_edges(spark):
    df = spark.createDataFrame([], "i long, s int")
    assert packing.pack(df, "i", "s", 10).count() == 0
    assert packing.packing_report(packing.pack(df, "i", "s", 10), 10).first().fill is None
    ties = spark.createDataFrame([(i, 5) for i in range(11)], "i long, s int")
    assert len({r.container for r in packing.pack(ties, "i", "s", 10).collect()}) == 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=2, max_size=60), st.integers(0, 5))
def test_crossover_keeps_a_packing(sizes, seed):
    sizes = np.sort(np.array(sizes))[::-1]
    rng = np.random.default_rng(seed)
    parents = []
    for _ in range(2):
        bins = np.empty(len(sizes), np.int32)
        packing.best_fit(sizes, rng.permutation(len(sizes)), bins, [], 100)
        parents.append(bins)
    child = packing.crossover(sizes, *parents, 100, rng)
    fill = np.bincount(child, weights=sizes)
    assert child.min() >= 0 and fill.max() <= 100 and fill.min() > 0


def test_genetic_search_improves_on_best_fit():
    rng = np.random.default_rng(0)
    gained = 0
    for seed in range(6):
        sizes = np.sort(rng.integers(200, 2200, 300))[::-1]
        start = np.empty(len(sizes), np.int32)
        packing.best_fit(sizes, np.arange(len(sizes)), start, [], 4000)
        best = packing.evolve(sizes, 4000, [], seed, 6, 12)
        assert packing.fitness(sizes, best, 4000) >= packing.fitness(sizes, start, 4000)
        gained += packing.fitness(sizes, best, 4000) > packing.fitness(sizes, start, 4000)
    assert gained


RATIOS = {"train": 7000, "dev": 1500, "test": 1500}


def components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, k, _ in rows:
        if i is not None:
            find(("i", i))
            if k is not None:
                parent[find(("i", i))] = find(("k", k))
    return {i: find(("i", i)) for i, _, _ in rows if i is not None}


def test_grouped_split_keeps_components_together(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([f"k{rng.randrange(300)}", "hot", None]) if rng.random() < 0.25 else f"k{rng.randrange(300)}", rng.choice(["train", "dev", None])) for i in range(900)]
    rows += [(i, f"k{rng.randrange(300)}", "train") for i in range(0, 900, 90)] + [(None, "k1", "dev"), (2000, None, "test"), (2000, None, "test")]
    rows += [(3000 + i, f"chain{i // 2}", None) for i in range(40)] + [(3000 + i, f"chain{(i + 1) // 2}", None) for i in range(40)]  # a path
    df = spark.createDataFrame([(*r, 0) for r in rows], "i long, k string, s string, root int")
    made = grouped_split.grouped_split(df, "i", "k", RATIOS, current="s")
    got = {r.id: (r.root, r.split) for r in made.assignment.collect()}
    comp = components(rows)
    assert set(got) == set(comp) and made.assignment.count() == len(got)
    by_root = defaultdict(set)
    for i, (root, _) in got.items():
        by_root[comp[i]].add(root)
    assert all(len(r) == 1 for r in by_root.values()) and len({next(iter(r)) for r in by_root.values()}) == len(by_root)
    assert all(len({got[i][1] for i in got if got[i][0] == root}) == 1 for root in {r for r, _ in got.values()})
    now = defaultdict(set)
    for i, k, s in rows:
        if i is not None and k is not None and s is not None:
            now[k].add(s)
    keys = {r.key: r.now_in for r in made.keys.collect()}
    assert {k for k, n in keys.items() if n == 2} == {k for k, s in now.items() if len(s) > 1}
    vertices = len({("i", i) for i, k, _ in rows if i is not None and k is not None} | {("k", k) for i, k, _ in rows if i is not None and k is not None})
    trees = len({comp[i] for i, k, _ in rows if i is not None and k is not None})
    assert made.forest.distinct().count() == vertices - trees, "a spanning forest has one edge less than vertices in each tree"


def test_split_shares_come_close(spark):
    rows = [(i, f"k{i // (1 + i % 4)}", None) for i in range(4000)]
    made = grouped_split.grouped_split(spark.createDataFrame(rows, "i long, k string, s string"), "i", "k", RATIOS)
    share = {r.split: r["count"] / 4000 for r in made.assignment.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["dev"] - 0.15) < 0.02 and abs(share["test"] - 0.15) < 0.02


def test_split_edges(spark):
    df = spark.createDataFrame([], "i long, k string, s string")
    made = grouped_split.grouped_split(df, "i", "k", RATIOS, current="s")
    assert (made.assignment.count(), made.keys.count(), made.forest.count()) == (0, 0, 0)
    one = spark.createDataFrame([(1, None, None)], "i long, k string, s string")
    assert grouped_split.grouped_split(one, "i", "k", {"all": 1, "none": 0}).assignment.first().split == "all"


def test_cycle_is_even():
    turns = grouped_split.cycle({"train": 7, "dev": 1.5, "test": 1.5}, 20)
    assert Counter(turns) == {"train": 14, "dev": 3, "test": 3}
    for n in range(1, 21):
        assert abs(turns[:n].count("train") - 0.7 * n) <= 1


TEXT = st.text("ab .,;\n\n!(O)IB-xé́", max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(5, 60), st.data())
def test_pieces_cover_the_text(text, limit, data):
    over = data.draw(st.integers(0, limit - 1))
    got = chunking.pieces(text, limit, over)
    assert all(b - a <= limit for a, b in got)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (_, end), (start, _) in zip(got, got[1:]):
        assert end - start == min(over, end)
    if len(text) <= limit:
        assert len(got) == 1


def test_cuts_prefer_strong_boundaries():
    sentence = "Um dois três quatro cinco. "
    text = sentence * 12
    assert all(text[:b].endswith(". ") for _, b in chunking.pieces(text, 150, 20)[:-1])
    tagged = " ".join(f"t{i}(B-nome) u{i}(I-nome) v{i}(O)" for i in range(60))
    for _, b in chunking.pieces(tagged, 300, 10)[:-1]:
        assert "(I-" not in tagged[b : b + 10].split(" ")[0], "an entity is not cut"
    assert len(chunking.pieces("x" * 1000, 100, 10)) >= 11


def test_split_oversized_rows(spark):
    rows = [(1, "f", "a b. " * 100), (2, "f", None), (3, "f", ""), (4, "f", "x" * 50), (1, "f", "a b. " * 100), (5, "g", "y" * 200_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "rid long, field string, text string, piece int, start int")
    got = chunking.split_oversized(df, ["rid", "field"], "text", 50, 5).collect()
    assert {r.rid for r in got} == {1, 5}
    full = dict((r[0], r[2]) for r in rows)
    assert all(r.piece == full[r.rid][r.start : r.stop] and len(r.piece) <= 50 for r in got)
    assert chunking.split_oversized(df.limit(0), ["rid"], "text", 50, 5).count() == 0
    with pytest.raises(ValueError):
        chunking.split_oversized(df, ["rid"], "text", 50, 50)


def mixed(spark, sized, weights, **kw):
    s = spark.createDataFrame(sized, "id long, source string, size long")
    w = spark.createDataFrame(weights, "source string, target_bp int, max_repeats int")
    rows, report = mixing.mix(s, w, **kw)
    return rows.collect(), {r.source: r for r in report.collect()}


def test_mix_reaches_its_shares(spark):
    rng = random.Random(8)
    sized = [(i, rng.choice("aaaaab"), rng.randrange(1, 400)) for i in range(800)] + [(900, "c", 50), (901, None, 10_000), (902, "d", 70), (903, "a", None), (904, "a", 0)]
    rows, report = mixed(spark, sized, [("a", 5000, 1), ("b", 3000, 2), ("c", 1000, 3), ("e", 1000, 4)], block_units=100)
    total = sum(s or 0 for _, k, s in sized if k is not None)
    units = Counter()
    for _, k, s in sized:
        units[k] += s or 0
    reached, slots, copies = Counter(), defaultdict(int), Counter()
    size = {i: s for i, _, s in sized}
    for r in rows:
        assert 0 <= r.start < r.stop <= size[r.id]
        reached[r.source] += r.stop - r.start
        slots[r.slot] += r.stop - r.start
        copies[r.id, r.turn] += r.stop - r.start
    assert all(n <= size[i] for (i, _), n in copies.items()), "no unit twice in a turn"
    assert max(slots.values()) <= 100 and sum(v < 100 for v in slots.values()) <= 4
    for s, (bp, repeats) in {"a": (5000, 1), "b": (3000, 2), "c": (1000, 3), "e": (1000, 4)}.items():
        r = report[s]
        assert (r.units, r.allowed, r.reached) == (units[s], units[s] * repeats, reached[s])
        assert r.short == (units[s] * repeats * 10_000 < bp * total)
        if not r.short:
            assert abs(r.reached - r.wanted) <= 300
        else:
            assert r.reached == r.allowed
    assert max(r.turn for r in rows if r.source == "c") == 2
    assert "d" not in report and not any(r.source == "d" for r in rows)


def test_mix_edges(spark):
    rows, report = mixed(spark, [], [("a", 10_000, 1)], block_units=10)
    assert rows == [] and (report["a"].units, report["a"].short, report["a"].share_bp) == (0, False, 0)
    rows, report = mixed(spark, [(1, "a", 5)], [], block_units=10)
    assert rows == [] and report == {}
    rows, report = mixed(spark, [(1, "a", 5), (1, "a", 5), (None, "a", 3)], [("a", 10_000, 2)], block_units=4, total=26)
    assert sum(r.stop - r.start for r in rows) == 26 and report["a"].reached == 26


def test_parts_have_the_tokens_of_the_whole():
    import runpy

    encoder = mixing._encoder("/opt/tokenizers/byte_bpe_multi_50k.tiktoken", runpy.run_path("/opt/tokenizers/__init__.py")["PATTERN"])
    text = "Às vezes, a  reunião 12 durou\n\tmuito mais do que se pensava... é? " * 30
    parts = list(mixing._parts(text, 50))
    assert len(parts) > 10 and "".join(parts) == text
    assert sum(len(encoder.encode_ordinary(p)) for p in parts) == len(encoder.encode_ordinary(text))


def test_token_sizes(spark):
    import runpy

    pattern = runpy.run_path("/opt/tokenizers/__init__.py")["PATTERN"]
    df = spark.createDataFrame([(1, "olá mundo"), (2, None), (3, ""), (4, "<|endoftext|>")], "id long, text string")
    got = {r.id: r.size for r in mixing.token_sizes(df, "id", "text", [], "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", pattern).collect()}
    assert got[2] == got[3] == 0 and got[1] >= 2 and got[4] > 1
    assert mixing.token_sizes(df.withColumn("k", F.lit("x")), "id", "text", ["k"], "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", pattern).columns == ["id", "k", "size"]


def test_any_number_of_sources(spark):
    rng = random.Random(3)
    sized = [(i, f"s{i % 3000:04d}", rng.randrange(50, 150)) for i in range(6000)]
    rows, report = mixed(spark, sized, [(f"s{i:04d}", 1 + i % 5, 2) for i in range(3000)] + [("none", 7, 1)], block_units=10)
    assert len(report) == 3001 and sum(r.reached for r in report.values()) == sum(r.stop - r.start for r in rows)
    assert abs(sum(r.reached for r in report.values()) / sum(r.wanted for r in report.values() if not r.short) - 1) < 0.3
    got = Counter()
    for r in rows:
        got[r.source] += r.stop - r.start
    assert all(report[s].reached == got[s] for s in report)


def test_long_publication_ids_stay_together(spark):
    """Ids of 25 digits link like short ones, however they are spelled, and are told apart in all digits."""
    from tagloom.functions.text import pub_key

    same, other = "7" * 25, "7" * 24 + "8"
    rows = [(i, f"n. 00{same}" if i % 2 else same, "train" if i % 3 else "dev") for i in range(30)] + [(100 + i, other, "train") for i in range(5)]
    df = spark.createDataFrame(rows, "i long, p string, s string").withColumn("k", pub_key(F.col("p")))
    made = grouped_split.grouped_split(df, "i", "k", RATIOS, current="s")
    split = {r.id: (r.root, r.split) for r in made.assignment.collect()}
    assert len({split[i] for i in range(30)}) == 1 and split[0][0] != split[100][0]
    assert {(r.key, r.now_in) for r in made.keys.collect()} == {(same, 2), (other, 1)}
    assert {r.split for r in made.keys.collect() if r.key == same} == {split[0][1]}


def test_several_kinds_of_keys(spark):
    rows = [(1, "a", "x", 5), (2, "a", "y", 6), (3, "b", "y", 7), (4, "x", "z", 8), (5, None, None, None), (5, None, None, None)]
    df = spark.createDataFrame(rows, "i long, author string, source string, entity int")
    root = {r.id: r.root for r in grouped_split.grouped_split(df, "i", ["author", "source", "entity"], RATIOS).assignment.collect()}
    assert root[1] == root[2] == root[3] and len({root[1], root[4], root[5]}) == 3, "equal names of two kinds are not one key"


def test_packing_beats_best_fit(spark):
    """Containers against best fit of all items in falling order, on several blocks: the search pays."""
    rng = random.Random(5)
    sizes = [rng.randrange(900, 2200) for _ in range(2500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, s long")
    packed = packing.pack(df, "i", "s", 4000, block_items=400)
    check_packing(list(enumerate(sizes)), 4000, packed.collect())
    got = packing.packing_report(packed, 4000).first()
    falling, bins = np.sort(np.array(sizes))[::-1], np.empty(len(sizes), np.int32)
    plain = packing.best_fit(falling, np.arange(len(sizes)), bins, [], 4000)
    assert got.least_containers <= got.containers < plain
    once = packing.packing_report(packing.pack(df, "i", "s", 4000, block_items=400, spare=1.0), 4000).first()
    assert got.containers <= once.containers, "a second pass over part-filled containers loses nothing"


def test_islands_have_tasks_of_their_own(spark):
    df = spark.range(2000).select("id", (F.col("id") % 900 + 100).alias("s"))
    dealt = df.select((F.col("id") % 5).cast("int").alias("block"), F.struct((-F.col("s")).alias("less"), "id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("box")).alias("e"))
    block = dealt.groupBy("block").agg(F.sort_array(F.collect_list("e")).alias("entries"))
    made = packing._evolved(block, 5, 4000, 3, 2, 4, 2)
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().toString()
    assert made.agg(F.sum(F.size("entries"))).first()[0] == 2000 and made.agg(F.max("used")).first()[0] <= 4000


def test_sample_of_one_huge_cell(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANGE_ROWS", 20)
    records = spark.range(40_000).select(F.col("id").alias("rid"), F.lit("a").alias("act"), F.lit("x").alias("kind"))
    targets = spark.createDataFrame([("a", "x", 9000, 0)], "act string, kind string, target_bp int, min_rows int")
    sample, report = sampling.proportional_sample(records, targets, "rid", CELLS)
    assert sample.count() == sample.distinct().count() == report.first().taken == 3600


def test_limits_by_row(spark):
    rows = [(1, "a b. " * 40, 50, 5), (2, "a b. " * 40, 500, 5), (3, "c d. " * 40, 80, 0), (4, "c d. " * 40, None, 0), (5, None, 10, 1)]
    df = spark.createDataFrame(rows, "rid long, text string, most int, over int")
    got = chunking.split_oversized(df, ["rid"], "text", "most", "over").collect()
    assert {r.rid for r in got} == {1, 3} and all(len(r.piece) <= {1: 50, 3: 80}[r.rid] for r in got)
    one = chunking.split_oversized(df.where("rid = 1"), ["rid"], "text", 50, 5).collect()
    assert sorted(r.piece_no for r in one) == sorted(r.piece_no for r in got if r.rid == 1)
    with pytest.raises(Exception, match="overlap"):
        chunking.split_oversized(df.withColumn("over", F.col("most")), ["rid"], "text", "most", "over").collect()
