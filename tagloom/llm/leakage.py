"""Evaluation passages inside a large corpus, found by spaced seeds.

A mask fixes which of ``SPAN`` consecutive words are hashed and ignores the others, so a window still meets its
counterpart when a word at an ignored position was replaced. The masks' hashes of the evaluation items form an index;
each corpus text is scanned against it in one pass. One more seed of ``RUN`` words in a row finds the parts of a passage
into which words were inserted, and items shorter than ``SPAN`` words are seeds as a whole. Around the hits of a text and
an item the two are compared word by word: runs of equal words are chained over replaced, inserted and left-out words.

Up to ``block_words`` item words, the index is broadcast (a bound on bytes, checked before anything is collected) and
nothing is shuffled. With more, both sides' seeds are joined by hash: the corpus' seeds first pass a filter of fixed size,
so that only those which some item may have are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm import bitmap, textvec
from tagloom.operators.skew import join_unique
from tagloom.plans.storage import stage

#: Fixed masks of 12 words: 1 is hashed, 0 ignored. An unchanged run of 12 words meets all of them. Every stretch of 12 words
#: or more that ``compare`` accepts (gap of at most 2) meets one at least; tests/llm/test_leakage_whole.py searches them all.
MASKS = ("111011011011", "110110111101", "101111001111",
         "111101010111", "111011011101", "111111101001", "111001110111", "101100111111",
         "111101110011", "111001111101", "111110110011", "100111101111", "101011011111")
SPAN = 12


#: Words in a row of the seed beside the masks, and the fewest words of an item that can be found as a whole.
RUN, LEAST = 8, 5
#: A replaced, inserted or left-out word takes this many equal words from a stretch.
COST = 3
#: About so many items of one seed are listed together.
CHUNK = 1000
#: Words scanned together.
CACHED = 40_000


def seeds(words: np.ndarray, counts: np.ndarray, lengths: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask, the run and each of the whole lengths: the seed hash at every window start, and the starts that do
    not reach over the end of their text."""
    c = textvec.constants(SPAN, 23)
    ends, n = np.repeat(np.cumsum(counts), counts), len(words)
    times = [words * c[i] for i in range(SPAN)]

    def inside(span: int) -> np.ndarray:
        m = max(n - span + 1, 0)
        return np.flatnonzero(np.arange(m) + span <= ends[:m])

    def row(span: int) -> np.ndarray:
        m = max(n - span + 1, 0)
        h = times[0][:m].copy()
        for i in range(1, span if m else 0):
            h += times[i][i : i + m]
        return h

    m, starts, whole = max(n - SPAN + 1, 0), inside(SPAN), row(SPAN)
    for mask in MASKS:
        h = whole.copy()
        for i in [i for i, x in enumerate(mask) if x == "0" and m > 0]:
            h -= times[i][i : i + m]
        yield h[starts], starts
    for span in (RUN, *lengths):
        starts = inside(span)
        yield row(span)[starts] + np.uint64(span), starts


def short_lengths(counts: np.ndarray) -> tuple[int, ...]:
    """The lengths of items that are looked for as a whole."""
    return tuple(n for n in range(LEAST, SPAN) if n in set(counts.tolist()))


def _kinds(words: np.ndarray, counts: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The items' own seeds: as :func:`seeds`, but a whole length only of the items that have it."""
    last = len(MASKS) + 1
    whole = np.repeat(counts, counts)
    for i, (h, starts) in enumerate(seeds(words, counts, lengths)):
        if i >= last:
            mine = whole[starts] == lengths[i - last]
            h, starts = h[mine], starts[mine]
        yield h, starts


class Index:
    """The seeds of some items, sorted, with a bit table in front of the search."""

    BITS = 22

    def __init__(self, item_ids: list, texts: list[str | None]):
        self.words, self.counts = textvec.word_hashes(texts)
        self.offsets = textvec.offsets(self.counts)
        self.ids = item_ids
        self.lengths = short_lengths(self.counts)
        self.tables = []
        for h, at in _kinds(self.words, self.counts, self.lengths):
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], at[order].astype(np.int32)))
        self._mark()

    def _mark(self) -> None:
        self.bits = []
        for h, _ in self.tables:
            bits = np.zeros(1 << self.BITS, bool)
            bits[(textvec.mix_light(h) >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.bits.append(bits)

    def __getstate__(self) -> dict:
        """The bit tables are made anew where the index arrives: they are far larger than a small index."""
        return {k: v for k, v in self.__dict__.items() if k != "bits"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._mark()

    def scan(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct rows (text, item, shift) of all hits in order; shift is word position in the batch minus that in the index.

        A few texts at a time, so that the arrays stay in the processor's cache.
        """
        off = textvec.offsets(counts)
        parts = [self._scan(words[off[a] : off[b]], counts[a:b]) + np.array([a, 0, off[a]]) for a, b in textvec.slices(counts, CACHED)]
        return np.concatenate(parts) if parts else np.empty((0, 3), np.int64)

    def _scan(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        doc, found = np.repeat(np.arange(len(counts)), counts), []
        for (h, at), bits, (mine, starts) in zip(self.tables, self.bits, seeds(words, counts, self.lengths)):
            if not len(h):
                continue
            maybe = np.flatnonzero(bits[(textvec.mix_light(mine) >> np.uint64(64 - self.BITS)).astype(np.int64)])
            mine, starts = mine[maybe], starts[maybe]
            lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            times = hi - lo
            if not times.any():
                continue
            here = np.repeat(starts, times)
            entry = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            place = at[entry].astype(np.int64)
            item = np.searchsorted(self.offsets, place, "right") - 1
            found.append(np.unique(np.stack([doc[here], item, here - place], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def compare(item: np.ndarray, text: np.ndarray, shifts: np.ndarray, gap: int) -> tuple[int, int, int]:
    """Longest exact run, item words of the best chained stretch, and the words lost in it.

    ``shifts`` are the places of hits in the text minus those in the item; shifts up to ``gap`` beside them are looked at
    too. Runs of equal words are chained where they follow one another in both with at most ``gap`` words between. An
    equal word counts one, a word replaced, inserted or left out takes ``COST``, so at least three quarters of a stretch
    are equal. The best has the highest count, then the most words.
    """
    near = sorted({s + d for s in shifts.tolist() for d in range(-gap, gap + 1)})
    own = set(shifts.tolist())
    runs = []
    for shift in near:
        lo, hi = max(0, -shift), min(len(item), len(text) - shift)
        if hi <= lo:
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, item[lo:hi] == text[lo + shift : hi + shift], False]))
        for s, e in zip((edge[::2] + lo).tolist(), (edge[1::2] + lo).tolist()):
            if shift in own or e - s > COST:  # beside a hit, chance matches of few words are no part of a passage
                runs.append((s, e, shift))
    runs.sort()
    exact, best = 0, (0, 0, 0)
    ends: dict[tuple[int, int], tuple[int, int, int]] = {}  # by end in item and text: count, start in the item, words lost
    for s, e, shift in runs:
        exact = max(exact, e - s)
        count, start, lost = 0, s, 0
        for i in range(gap + 1):  # words of the item between
            for t in range(gap + 1):  # words of the text between
                if (i or t) and (before := ends.get((s - i, s + shift - t))) is not None and before[0] - COST * max(i, t) > count:
                    count, start, lost = before[0] - COST * max(i, t), before[1], before[2] + max(i, t)
        state = (count + e - s, start, lost)
        if state > ends.get((e, e + shift), (0, 0, 0)):
            ends[e, e + shift] = state
        best = max(best, (state[0], e - start, -lost))
    return exact, best[1], -best[2]


def _accepted(exact: int, span: int, words: int) -> bool:
    """Whether an overlap counts: ``SPAN`` words of the item or, for a shorter item, all of it."""
    return span >= SPAN or (LEAST <= words < SPAN and exact == words)


def leaks(corpus: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", gap: int = 2, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, exact_words, overlap_words, replaced): every text that meets an item, with its best overlap.

    ``exact_words`` is the longest run of words common to both; ``overlap_words`` the item's words in the longest common
    stretch in which at most ``gap`` words in a row and a quarter of all are replaced, inserted or left out, ``replaced``
    the number of those. Rows are kept from 12 overlapping words on; an item of 5 to 11 words is found where it stands
    whole and unchanged, one of fewer words never. A passage with insertions is found if one of its parts has 8 words in
    a row or meets a mask. Null or empty texts meet nothing; items repeated under another id are all reported; rows with
    null id keep the null; other columns are ignored. Without items or texts the result is empty.
    """
    spark = corpus.sparkSession
    wanted = items.where(F.col(item_text_col).isNotNull()).select(
        F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    kind, doc_kind = wanted.schema["item_id"].dataType, corpus.schema[id_col].dataType
    texts = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    result = f"doc_id {doc_kind.simpleString()}, item_id {kind.simpleString()}, exact_words int, overlap_words int, replaced int"
    # every word has a letter and a separator at least, so half the characters bound the words
    if wanted.agg(F.coalesce(F.sum(F.char_length("text") / 2 + 1), F.lit(0.0))).first()[0] > block_words:
        return _joined(texts, wanted, gap, result)
    rows = wanted.collect()
    shared = spark.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows]))
    item_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            words, counts = textvec.word_hashes(batch.column("text").to_pylist())
            off, docs, hit, found = textvec.offsets(counts), [], [], []
            met = index.scan(words, counts)
            cuts = np.flatnonzero(np.r_[True, (met[1:, :2] != met[:-1, :2]).any(axis=1)]) if len(met) else []
            for group in np.split(met, cuts[1:]) if len(met) else []:
                d, i = int(group[0, 0]), int(group[0, 1])
                at = index.offsets[i]
                got = compare(index.words[at : index.offsets[i + 1]], words[off[d] : off[d + 1]], group[:, 2] + at - off[d], gap)
                if _accepted(got[0], got[1], int(index.counts[i])):
                    docs.append(d), hit.append(i), found.append(got)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array([index.ids[i] for i in hit], item_type),
                *[pa.array([f[c] for f in found], pa.int32()) for c in range(3)],
            ], names=["doc_id", "item_id", "exact_words", "overlap_words", "replaced"])

    return texts.mapInArrow(run, result)


def _emit(lengths: tuple[int, ...], among: np.ndarray | None, own: bool):
    """Rows (seed, key, place) of all seeds of the texts in a batch with columns key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = textvec.word_hashes(batch.column("text").to_pylist())
            off, doc = textvec.offsets(counts), np.repeat(np.arange(len(counts)), counts)
            for i, (h, at) in enumerate((_kinds if own else seeds)(words, counts, lengths)):
                h = textvec.mix(h + np.uint64(i))
                if among is not None:
                    some = bitmap.test(among, h)
                    h, at = h[some], at[some]
                d = doc[at] if len(at) else at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch.column("key").take(pa.array(d)), pa.array((at - off[d]).astype(np.int32))], names=["seed", "key", "place"])

    return run


def _joined(texts: DataFrame, items: DataFrame, gap: int, result: str) -> DataFrame:
    """The same with both sides partitioned by seed; equal texts are compared once and equal items too."""
    hashed = [F.xxhash64("text"), F.hash("text").cast("string"), F.char_length("text")]
    key = F.concat_ws(".", *[h.cast("string") for h in hashed])
    corpus, wanted = stage(texts.withColumn("key", key), "corpus"), stage(items.withColumn("key", key), "items")
    one = wanted.groupBy("key").agg(F.any_value("text").alias("text"))
    sizes = [r[0] for r in one.mapInArrow(_lengths, "n int").where(F.col("n").between(LEAST, SPAN - 1)).distinct().collect()]  # at most seven
    lengths = tuple(sorted(sizes))
    index = stage(one.mapInArrow(_emit(lengths, None, True), "seed bigint, key string, place int"), "seeds")
    among = bitmap.build(index, "seed")
    mine = stage(corpus.select("key", "text").mapInArrow(_emit(lengths, among, False), "seed bigint, key string, place int"), "hits")
    # a seed of stock phrases may stand in any share of the items or the corpus: its items are listed in chunks of bounded
    # length, and its corpus rows stay where they are
    chunks = stage(index.groupBy("seed").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks")
    lists = join_unique(index, chunks, ["seed"]).groupBy("seed", F.pmod(F.xxhash64("key", "place"), F.col("chunks")).alias("chunk")).agg(
        F.collect_list(F.struct(F.col("key").alias("item"), F.col("place").alias("at"))).alias("entries"))
    each = stage(join_unique(mine, chunks, ["seed"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - F.lit(1).cast("bigint")))), "asked")
    met = join_unique(each, lists, ["seed", "chunk"]).select("key", "place", F.explode("entries").alias("e"))
    pairs = met.select("key", F.col("e.item").alias("item"), (F.col("place") - F.col("e.at")).alias("shift")).groupBy("key", "item").agg(
        F.collect_set("shift").alias("shifts"))
    unique = corpus.groupBy("key").agg(F.any_value("text").alias("text"))
    both = pairs.join(one.select(F.col("key").alias("item"), F.col("text").alias("item_text")), "item").join(unique, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for r, (shifts, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shifts", "item_text", "text")))):
                (x, _), (y, _) = textvec.word_hashes([a]), textvec.word_hashes([b])
                got = compare(x, y, np.array(shifts), gap)
                if _accepted(got[0], got[1], len(x)):
                    keep.append(r), found.append(got)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(take), batch.column("item").take(take), *[pa.array([f[c] for f in found], pa.int32()) for c in range(3)]],
                names=["key", "item", "exact_words", "overlap_words", "replaced"])

    compared = stage(both.select("key", "item", "shifts", "item_text", "text").mapInArrow(
        run, "key string, item string, exact_words int, overlap_words int, replaced int"), "compared")
    named = compared.join(wanted.select(F.col("key").alias("item"), "item_id"), "item")
    return corpus.select("doc_id", "key").join(named, "key").select(*[c.split()[0] for c in result.split(", ")])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(textvec.word_hashes(batch.column("text").to_pylist())[1].astype(np.int32))], names=["n"])
