"""Near-duplicates, overlap between splits and leaks of evaluation texts, against brute force."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import leakage, neardup, overlap, prefixjoin, textsets, textvec


def words(text):
    low = unicodedata.normalize("NFD", (text or "").lower())
    return re.findall("[a-z0-9]+", "".join(c for c in low if unicodedata.category(c) != "Mn"))


def grams(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def similar(rows, k, threshold):
    sets = {i: grams(t, k) for i, t in rows if i is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2)
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def corpus(seed, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 25, 60]))] for _ in range(n // 3)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            kind, at = rng.randrange(3), rng.randrange(len(w))
            if kind == 0:
                w[at] = rng.choice(vocabulary)
            elif kind == 1:
                w.insert(at, rng.choice(vocabulary))
            elif len(w) > 3:
                w.pop(at)
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "um dois"), (n + 3, "Úm dois TRÊS, quátro!"), (n + 4, "um  dois três quatro"), (None, "um dois tres quatro")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("aÁ é1-\n'ºḰ", max_size=30)), max_size=8))
def test_word_hashes_follow_the_word_rule(texts):
    h, counts = textvec.word_hashes(texts)
    want = [words(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    for i, j in itertools.combinations(range(len(flat)), 2):
        assert (h[i] == h[j]) == (flat[i] == flat[j])


def test_long_texts_are_hashed_in_parts(monkeypatch):
    texts = ["um dois, três " * 50, None, "x" * 90, "", "A-b " * 40]
    whole = textvec.word_hashes(texts)
    monkeypatch.setattr(textvec, "_CHUNK_CHARS", 17)
    for a, b in zip(whole, textvec.word_hashes(texts)):
        assert a.tolist() == b.tolist()


def test_shingles_are_distinct_sorted_and_stay_inside_a_text():
    texts = ["a b c a b c", "", "a b", "c a b"]
    h, n = textvec.shingles(*textvec.word_hashes(texts), 3)
    assert n.tolist() == [3, 0, 0, 1]
    assert len(set(h[:3].tolist()) & set(h[3:].tolist())) == 1 and np.all(h[:2] < h[1:3])
    assert textvec.shingles(*textvec.word_hashes([]), 3)[1].tolist() == []


@pytest.mark.parametrize(("k", "threshold", "bucket"), [(3, 0.5, 64), (3, 0.5, 2), (5, 0.8, 64)])
def test_near_duplicates_equal_brute_force(spark, k, threshold, bucket):
    rows = corpus(k)
    df = spark.createDataFrame([(i, t, "other", 1.5) for i, t in rows], "id long, text string, n string, sh double")  # clashing extra columns
    member, pairs, balls = neardup.near_duplicates(df, "id", "text", k=k, threshold=threshold, bucket=bucket, recall=0.999999, most_trees=400)
    got = [tuple(r) for r in neardup.expand(member, pairs, balls).collect()]
    assert len(got) == len(set(got))
    assert set(got) == similar(rows, k, threshold)
    reps = {r.id: r.rep for r in member.collect()}
    assert set(reps) == {i for i, t in rows if i is not None and grams(t, k)}
    assert all(grams(dict(rows)[i], k) == grams(dict(rows)[r], k) for i, r in reps.items())


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, text string")
    member, pairs, balls = neardup.near_duplicates(empty, "id", "text")
    assert (member.count(), pairs.count(), balls.count()) == (0, 0, 0)


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.5), (5, 0.8)])
def test_a_crowd_of_near_copies(spark, k, threshold):
    """A third of the texts are variants of one text: balls, the exact search and the rest together lose nothing."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 7])):
            w[rng.randrange(70)] = f"z{rng.randrange(500)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, t) for i, t in corpus(3, 60) if i is not None and t]
    df = spark.createDataFrame(rows, "id long, text string")
    member, pairs, balls = neardup.near_duplicates(df, "id", "text", k=k, threshold=threshold, bucket=8, recall=0.999999, most_trees=400)
    got = [tuple(r) for r in neardup.expand(member, pairs, balls).collect()]
    want = similar(rows, k, threshold)
    assert len(got) == len(set(got)) and set(got) == want
    assert balls.groupBy("ball").count().where("count > 5").count() > 0
    assert pairs.count() < len(want) / 2, "pairs inside a ball are not listed"
    reps = {r.id: r.rep for r in member.collect()}
    edges, links = neardup.links(pairs, balls)
    counted = {r.rep: r.links for r in links.collect() if r.links}
    real = {}
    for a, b in {(reps[a], reps[b]) for a, b in want if reps[a] != reps[b]}:
        real.setdefault(a, set()).add(b), real.setdefault(b, set()).add(a)
    assert counted == {r: len(o) for r, o in real.items()}
    assert all((min(e), max(e)) in want for e in edges.collect())


def test_forest_plan_reaches_its_recall():
    for threshold in (0.3, 0.5, 0.8):
        f = neardup.plan_forest(threshold, 0.999)
        assert 1 - (1 - threshold**f.depth) ** f.trees >= 0.999 and f.trees <= 160
    with pytest.raises(ValueError):
        neardup.plan_forest(0.01, 0.999, most_trees=3)


@pytest.mark.parametrize(("threshold", "hits"), [(0.5, 1), (0.5, 4), (0.8, 2), (0.3, 3)])
def test_prefix_search_loses_no_pair(spark, threshold, hits):
    rows = corpus(11)
    sets = textsets.text_sets(spark.createDataFrame(rows, "id long, text string").where("id is not null"), "id", "text", 3)
    found = textsets.verify(prefixjoin.prefix_pairs(sets, threshold, hits), sets)
    got = {(r.a, r.b) for r in found.where(textsets.at_least(threshold, *map(F.col, ("na", "nb", "common")))).collect()}
    assert got == similar(rows, 3, threshold)


def test_split_overlap_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, t, rng.choice(["train", "dev", "test", None, "other"])) for i, t in corpus(4, 90)]
    df = spark.createDataFrame(rows, "id long, text string, split string")
    split = {i: s for i, _, s in rows}
    got = {(r.eval_id, r.train_id): r for r in overlap.split_overlap(df, "id", "text", "split", k=3, threshold=0.5).collect()}
    near = {(a, b) for a, b in similar([(i, t) for i, t, _ in rows], 3, 0.5)}
    want = {(a, b) for x in near for a, b in (x, x[::-1]) if split[b] == "train" and split[a] in ("dev", "test")}
    assert set(got) == want and want
    text = {i: t for i, t, _ in rows}
    for (a, b), r in got.items():
        x, y = grams(text[a], 3), grams(text[b], 3)
        assert r.similarity == pytest.approx(len(x & y) / len(x | y)) and r.containment == pytest.approx(len(x & y) / len(x)) and r.eval_split == split[a]
    origin = spark.createDataFrame([(i, i % 5 or None) for i in split if i is not None], "eval_id long, publication long")
    report = overlap.overlap_report(overlap.split_overlap(df, "id", "text", "split", k=3, threshold=0.5), origin).collect()
    assert sum(r.pairs for r in report) == len(want)
    assert overlap.split_overlap(df.limit(0), "id", "text", "split").count() == 0


def runs(text, item, n=12):
    a, b = words(text), words(item)
    return bool({tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)})


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_leaks_equal_brute_force(spark, block_words):
    rng = random.Random(9)
    vocabulary = [f"p{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(8)] + [(50, None), (51, ""), (52, "curto demais"), (53, None)]
    items.append((60, items[0][1]))  # repeated under another id
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        src = rng.choice(items[:8])[1].split()
        n, at = rng.randrange(8, 20), rng.randrange(10)
        w[5:5] = src[at : at + n]
        docs.append((i, " ".join(w).replace("p1", "P1")))
    docs += [(100, None), (101, ""), (102, items[1][1] * 1), (None, items[2][1])]
    corpus_df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    got = leakage.leaks(corpus_df, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    want = {(d, i) for d, t in docs for i, x in items if t and x and runs(t, x)}
    assert {(r.doc_id, r.item_id) for r in got if r.exact_words >= 12} == want and want
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)


def test_leaks_tolerate_replaced_words(spark):
    item = " ".join(f"q{i}" for i in range(30))
    changed = [f"q{i}" if i not in (7, 15, 22) else "xx" for i in range(30)]
    df = spark.createDataFrame([(1, "antes " + " ".join(changed) + " depois")], "doc_id long, text string")
    r = leakage.leaks(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(x.exact_words, x.overlap_words, x.replaced) for x in r] == [(7, 30, 3)]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaks(df, empty).count() == 0 and leakage.leaks(df.limit(0), empty).count() == 0


def test_chance_matches_around_a_run_do_not_hide_it(spark):
    item = " ".join(f"q{i}" for i in range(90))
    for run in (range(30, 42), range(0, 12), range(78, 90)):
        text = " ".join(f"q{i}" if i in run or i % 3 == 0 else f"x{i}" for i in range(90))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        r = leakage.leaks(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
        assert len(r) == 1 and r[0].exact_words >= 12 and 4 * r[0].replaced <= r[0].overlap_words


def test_masks_are_met_by_every_exact_run():
    assert all(len(m) == leakage.SPAN and m[0] == m[-1] == "1" for m in leakage.MASKS)
    assert len({m.count("1") for m in leakage.MASKS}) == 1


def test_marks_of_every_plane_are_dropped():
    h, counts = textvec.word_hashes(["ab\U000E0100cd", "abcd", "ab́cd", "ab‍cd", "ÁÇ–x", "ac x"])
    assert counts.tolist() == [1, 1, 1, 2, 2, 2] and h[0] == h[1] == h[2] and h[5] == h[7]


def test_shipped_forest_reaches_its_recall(spark):
    """Many pairs right at the threshold, with the parameters the queries use: the measured recall is near one."""
    rng = random.Random(12)
    rows = []
    for g in range(260):
        base = [f"g{g}w{i}" for i in range(60)]
        rows.append((len(rows), " ".join(base)))
        for changes in (3, 5, 6, 7):
            w = list(base)
            for at in rng.sample(range(4, 56), changes):
                w[at] = f"x{len(rows)}y{at}"
            rows.append((len(rows), " ".join(w)))
    want = set()
    for g in range(0, len(rows), 5):
        want |= similar(rows[g : g + 5], 3, 0.5)
    got = {tuple(r) for r in neardup.expand(*neardup.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", k=3, threshold=0.5)).collect()}
    assert len(want) > 800 and got <= want and len(got) >= 0.999 * len(want)


def test_prefixes_are_shortened_by_what_is_found(spark):
    f = neardup.plan_forest(0.5, 0.9999)
    pairs = lambda common: spark.createDataFrame([(100, 100, common)] * 50, "na int, nb int, common int")
    assert neardup.shorten(pairs(99), 0.5, neardup.DEPTH, f, 0.9999) > f.depth, "like pairs are met by long prefixes"
    assert neardup.shorten(pairs(67), 0.5, neardup.DEPTH, f, 0.9999) == f.depth, "pairs at the threshold need short ones"
    assert neardup.shorten(pairs(67), 0.5, f.depth, f, 0.9999) == f.depth
    assert neardup.shorten(pairs(67).limit(0), 0.5, f.depth, f, 0.9999) == f.depth


@pytest.mark.parametrize("piece", [2, 7])
def test_long_lists_are_joined_in_pieces(spark, monkeypatch, piece):
    """A sentence that stands in every text: its lists are cut, on both sides, and no pair is lost or told twice."""
    rows = [(i, f"{t or ''} frase que esta em todos os textos") for i, t in corpus(11, 60) if i is not None]
    sets = textsets.text_sets(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3)
    frequent = prefixjoin.frequent_elements(sets, least=1)
    monkeypatch.setattr(prefixjoin, "PIECE", piece)
    index = prefixjoin.prefixes(sets, 0.3, 3, frequent)
    assert prefixjoin.has_long_lists(frequent) and index.agg(F.max("pieces")).first()[0] > 60 // piece - 2
    cut, whole = ({tuple(r) for r in prefixjoin.shared_prefixes(index, index, 0.3, 3, same_side=True, cut=c).collect()} for c in (True, False))
    assert cut == whole and len(cut) > 20


def test_contained_records_are_met(spark):
    """An evaluation record whole inside a far longer training record, and the classes with their members."""
    short, other = " ".join(f"s{i}" for i in range(40)), " ".join(f"o{i}" for i in range(40))
    long = " ".join(f"l{i}" for i in range(180)) + " " + short + " " + " ".join(f"m{i}" for i in range(180))
    rows = [(1, short, "test"), (2, long, "train"), (3, long, "train"), (4, other, "dev"), (5, other, "train"), (6, short, "dev"), (7, None, "test"), (8, "", "train")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, text string, split string, rep int, a string")
    made = overlap.find_overlap(df, "id", "text", "split")
    pairs = made.pairs.collect()
    assert {(r.a, r.b, r.evals, r.trains) for r in pairs} == {(1, 2, 2, 2), (4, 4, 1, 1)}
    assert {r.a: round(r.containment, 6) for r in pairs} == {1: 1.0, 4: 1.0} and next(r.similarity for r in pairs if r.a == 1) < 0.2
    assert {(r.eval_id, r.pairs, r.copies) for r in made.records().collect()} == {(1, 2, 0), (6, 2, 0), (4, 1, 1)}
    assert {(r.eval_id, r.train_id) for r in made.expand().collect()} == {(1, 2), (1, 3), (6, 2), (6, 3), (4, 5)}
    assert overlap.find_overlap(df, "id", "text", "split", containment=None).pairs.count() == 1
    assert overlap.find_overlap(df.limit(0), "id", "text", "split").records().count() == 0


def test_containment_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i, t in corpus(9, 90):
        if i is not None and t:
            rows.append((i, t + (" " + " ".join(f"z{rng.randrange(900)}" for _ in range(60)) if i % 3 == 0 else ""), "train" if i % 3 == 0 else rng.choice(["dev", "test"])))
    df = spark.createDataFrame(rows, "id long, text string, split string")
    got = {(r.eval_id, r.train_id) for r in overlap.split_overlap(df, "id", "text", "split", k=3, threshold=0.5, containment=0.6).collect()}
    sets = {i: (grams(t, 3), s) for i, t, s in rows}
    want = {(a, b) for a, (x, s) in sets.items() for b, (y, u) in sets.items()
            if s != "train" and u == "train" and x and y and (len(x & y) >= 0.6 * len(x) or len(x & y) >= 0.5 * len(x | y))}
    assert got == want and len(want) > 20


def test_a_filter_lets_all_its_hashes_pass(spark):
    from tagloom.llm import bitmap

    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(x),) for x in h[:2000]] + [(None,)], "e bigint")
    words = bitmap.build(df, "e", 16)
    passed = bitmap.test(words, h.view(np.uint64))
    assert passed[:2000].all() and passed[2000:].mean() < 0.1
    assert not bitmap.test(bitmap.build(df.limit(0), "e", 16), h.view(np.uint64)).any()
