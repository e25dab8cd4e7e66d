"""The same or nearly the same text on both sides of a split.

Evaluation records are indexed by their word n-gram hashes, partitioned by hash; training records are scanned against
the index, hits are counted by pair, and each pair with enough hits is verified on the whole sets: containment of the
evaluation record in the training record, and their similarity. Entries are limited to the n-grams that any pair at the
threshold must share (``prefixjoin``), which is exact. An evaluation record inside a longer training record shares few of
its rarest n-grams with the training record's rarest ones, so for containment the evaluation side is limited alone, and
training n-grams that no evaluation record has are dropped by a filter of fixed size before anything is shuffled. Records
with equal n-gram sets are scanned once, as a class, and the result is kept as pairs of classes with their members beside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import bitmap, textsets
from tagloom.llm.prefixjoin import all_entries, frequent_elements, has_long_lists, prefixes, shared_prefixes
from tagloom.operators.skew import join_unique
from tagloom.plans.storage import stage


@dataclass
class Overlap:
    pairs: DataFrame
    """(a, b, similarity, containment, evals, trains): classes of the evaluation and the training side, and their members"""
    member: DataFrame
    """(id, rep, split): the class of every record"""
    train: str

    def records(self) -> DataFrame:
        """(eval_id, eval_split, pairs, copies, similarity, containment): one row per evaluation record that is met.

        ``pairs`` counts the training records met, ``copies`` those with an equal set; the others are the highest met.
        """
        by = self.pairs.groupBy(F.col("a").alias("rep")).agg(
            F.sum("trains").alias("pairs"), F.coalesce(F.sum(F.when(F.col("similarity") == 1, F.col("trains"))), F.lit(0)).alias("copies"),
            F.max("similarity").alias("similarity"), F.max("containment").alias("containment"))
        evals = self.member.where(F.col("split") != self.train)
        return join_unique(evals, by, ["rep"]).select(F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), "pairs", "copies", "similarity", "containment")

    def expand(self) -> DataFrame:
        """(eval_id, train_id, eval_split, similarity, containment): all pairs of records, as many as the result has."""
        is_train = F.col("split") == self.train
        left = self.member.where(~is_train).select(F.col("id").alias("eval_id"), F.col("rep").alias("a"), F.col("split").alias("eval_split"))
        right = self.member.where(is_train).select(F.col("id").alias("train_id"), F.col("rep").alias("b"))
        return self.pairs.join(left, "a").join(right, "b").select("eval_id", "train_id", "eval_split", "similarity", "containment")


def find_overlap(df: DataFrame, id_col: str, text_col: str, split_col: str, *, k: int = 5, threshold: float = 0.8,
                 containment: float | None = 0.8, train: str = "train", evals: tuple[str, ...] = ("dev", "test"), hits: int = 4) -> Overlap:
    """Evaluation records met in training: similarity >= ``threshold`` or, unless None, containment >= ``containment``.

    ``containment`` is the share of the evaluation record's distinct ``k``-word sequences found in the training
    record. ``id`` must be unique. Rows with null id, null or other split, null or empty text or fewer than ``k`` words are
    left out; repeated texts are one class; an empty table gives an empty result; further columns are ignored.
    """
    sides = df.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("__t"),
        F.col(split_col).alias("split")).where(F.col("id").isNotNull() & F.col("split").isin(train, *evals))
    sets = stage(textsets.text_sets(sides, "id", "__t", k, ["split"]), "split-sets")
    is_train = F.col("split") == train
    cls = textsets.classes(sets, F.count_if(is_train).alias("trains"), F.count_if(~is_train).alias("evals"))
    side = cls.select(F.col("rep").alias("id"), (F.col("trains") > 0).alias("in_train"), (F.col("evals") > 0).alias("in_eval"))
    reps = sets.select("id", "n", "sh").join(side, "id")
    frequent = frequent_elements(sets)
    cut = has_long_lists(frequent)
    index = prefixes(reps, threshold, hits, frequent, ["in_train", "in_eval"])
    met = shared_prefixes(index.where("in_eval"), index.where("in_train"), threshold, hits, same_side=False, cut=cut)
    if containment is not None:
        asked = stage(prefixes(reps.where("in_eval"), containment, hits, frequent), "asked")
        offered = all_entries(reps.where("in_train"), frequent, bitmap.build(asked, "e"))
        met = met.unionByName(shared_prefixes(asked, offered, containment, hits, same_side=False, contained=True, cut=cut)).distinct()
    na, nb, common = F.col("na"), F.col("nb"), F.col("common")
    kept = textsets.at_least(threshold, na, nb, common)
    if containment is not None:
        kept = kept | (common.cast("bigint") * 1_000_000 >= na.cast("bigint") * round(containment * 1_000_000))
    near = textsets.verify(met, sets).where(kept).select(
        "a", "b", (common / (na + nb - common)).alias("similarity"), (common / na).alias("containment"))
    same = cls.where("trains > 0 and evals > 0").select(
        F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("containment"))
    pairs = (
        near.unionByName(same).join(cls.select(F.col("rep").alias("a"), "evals"), "a").join(cls.select(F.col("rep").alias("b"), "trains"), "b")
        .select("a", "b", "similarity", "containment", "evals", "trains")
    )
    return Overlap(stage(pairs, "class-pairs"), textsets.members(sets, cls, "split"), train)


def split_overlap(df: DataFrame, id_col: str, text_col: str, split_col: str, *, containment: float | None = None, **how) -> DataFrame:
    """(eval_id, train_id, eval_split, similarity, containment): every pair of :func:`find_overlap`, by similarity alone
    unless a ``containment`` is asked for. Only for results that must name every pair."""
    return find_overlap(df, id_col, text_col, split_col, containment=containment, **how).expand()


def overlap_report(found: DataFrame, origin: DataFrame) -> DataFrame:
    """(split, publication, records, pairs, copies): overlaps by the evaluation record's split and source.

    ``found`` is a result by record (:meth:`Overlap.records`) or by pair. ``origin`` gives (eval_id, publication), one row
    per id; a null publication is a row of its own.
    """
    if "pairs" not in found.columns:
        found = found.groupBy("eval_id", "eval_split").agg(F.count("*").alias("pairs"), F.count_if(F.col("similarity") == 1).alias("copies"))
    return found.join(origin, "eval_id").groupBy(F.col("eval_split").alias("split"), "publication").agg(
        F.count("*").alias("records"), F.sum("pairs").alias("pairs"), F.sum("copies").alias("copies"))
