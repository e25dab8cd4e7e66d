"""Every accepted stretch meets a mask."""

import pytest

from tagloom.llm import leakage


def test_no_accepted_stretch_misses_all_masks():
    """All strings of equal (1) and replaced (0) words that meet no mask, by their last 12 places: none is ever accepted."""
    masks = [int(m, 2) for m in leakage.MASKS]
    todo, seen = [(1, 1, 1, 1, 0)], set()  # last places, span up to 12, count, highest count, replaced words in a row
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        bits, span, count, best, gap = state
        assert not (bits & 1 and span >= leakage.SPAN and count >= best), bin(bits)
        best, span = max(best, count) if bits & 1 else best, min(span + 1, leakage.SPAN)
        for bit, c in ((1, count + 1), (0, count - 3)):
            new = ((bits << 1) | bit) & 0xFFF
            if c > 0 and (bit or gap < 2) and not any(new & m == m for m in masks):
                todo.append((new, span, c, best, 0 if bit else gap + 1))
    assert len(seen) > 100


@pytest.mark.parametrize("phase", range(5))
def test_every_fifth_word_replaced(spark, phase):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    text = " ".join("outro" + w if i % 5 == phase else w for i, w in enumerate(words))
    df = spark.createDataFrame([(1, "antes " + text + " depois"), (2, "nada disso")], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.exact_words) for r in leakage.leaks(df, items).collect()]
    assert got == [(1, 5, 4)]


def _leaks(spark, docs, items, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): tuple(r)[2:] for r in leakage.leaks(df, spark.createDataFrame(items, "item_id long, text string"), **how).collect()}


@pytest.mark.parametrize("block_words", [1_000_000, 10])
def test_short_items_are_found_whole(spark, block_words):
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in (3, 4, 5, 8, 11)]
    docs = [(n, f"antes de tudo {t.upper()} e depois") for n, t in items] + [(100, " ".join(items[3][1].split()[:-1])), (101, items[4][1]), (102, None), (None, items[2][1])]
    got = _leaks(spark, docs, items, block_words=block_words)
    assert got == {(5, 5): (5, 5, 0), (8, 8): (8, 8, 0), (11, 11): (11, 11, 0), (101, 11): (11, 11, 0), (None, 5): (5, 5, 0)}


@pytest.mark.parametrize("block_words", [1_000_000, 10])
@pytest.mark.parametrize(("change", "want"), [
    (lambda w: w[:10] + ["novo"] + w[10:], (10, 20, 1)), (lambda w: w[:10] + w[11:], (10, 20, 1)), (lambda w: w[:9] + ["x", "y"] + w[9:], (11, 20, 2)),
    (lambda w: w[:8] + ["x"] + w[8:12] + ["y"] + w[12:], (8, 20, 2)), (lambda w: w[:8] + ["x"] * 3 + w[8:16], None), (lambda w: w[:11], None),
])
def test_words_inserted_or_left_out(spark, block_words, change, want):
    item = [f"q{chr(97 + i)}" for i in range(20)]
    got = _leaks(spark, [(1, " ".join(["antes", *change(item), "depois"]))], [(7, " ".join(item))], block_words=block_words)
    assert got == ({(1, 7): want} if want else {})


def test_joined_seeds_find_what_the_broadcast_index_finds(spark):
    import random

    rng = random.Random(4)
    stock = [f"s{i}" for i in range(14)]
    items = [(i, " ".join([f"v{rng.randrange(300)}" for _ in range(25)] + stock * (i % 3 == 0))) for i in range(30)] + [(40, items_text := "a b c d e f g"), (41, items_text), (42, None), (None, "")]
    docs = []
    for i in range(80):
        w = [f"v{rng.randrange(300)}" for _ in range(rng.randrange(60))]
        src = rng.choice(items[:30])[1].split()
        at = rng.randrange(10)
        w[3:3] = [x if rng.random() < 0.9 else "zz" for x in src[at : at + rng.randrange(5, 30)]] + (stock if i % 2 else [])
        docs.append((i, " ".join(w)))
    docs += [(90, docs[3][1]), (91, "A, b. C d e f G!"), (92, ""), (93, None), (None, docs[5][1])]
    one, two = _leaks(spark, docs, items), _leaks(spark, docs, items, block_words=50)
    assert one == two and (91, 40) in one and (91, 41) in one and len(one) > 100
