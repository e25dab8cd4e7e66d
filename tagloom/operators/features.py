"""Token feature tables and label vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import tokens as tk


def positions(docs: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """(keys..., pos, token)."""
    return docs.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def token_features(docs: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """One row per token: its own attributes, those of its neighbours at 1, the lower form at 2, and the document's edges.

    Neighbours are read from the array itself, so no window and no shuffle is needed.
    """
    w, at = F.col("token"), lambda d: F.get(F.col("__k"), F.col("pos") + d)
    rows = docs.select(*keys, F.col(tokens).alias("__k"), F.posexplode(tokens).alias("pos", "token")).select(
        *keys, "pos", "token", at(-1).alias("__p"), at(1).alias("__n"), at(-2).alias("__pp"), at(2).alias("__nn"))

    def around(prefix: str, c) -> list:
        return [F.lower(c).alias(f"{prefix}_lower"), tk.is_title(c).alias(f"{prefix}_istitle"), tk.is_upper(c).alias(f"{prefix}_isupper"),
                tk.is_digit(c).alias(f"{prefix}_isdigit"), tk.shape(c).alias(f"{prefix}_shape")]

    return rows.select(
        *keys, "pos", "token", F.lower(w).alias("lower"), *[c.alias(n) for n, c in tk.affixes(w).items()], tk.is_upper(w).alias("isupper"),
        tk.is_title(w).alias("istitle"), tk.is_digit(w).alias("isdigit"), tk.has_digit(w).alias("hasdigit"), tk.has_punct(w).alias("haspunct"),
        F.char_length(w).alias("len"), tk.shape(w).alias("shape"), *around("prev", F.col("__p")), *around("next", F.col("__n")),
        F.lower("__pp").alias("prev2_lower"), F.lower("__nn").alias("next2_lower"), F.col("__p").isNull().alias("bos"), F.col("__n").isNull().alias("eos"))


def label_vocabulary(docs: DataFrame, tags: str = "tags") -> DataFrame:
    """(label, id): ``O`` first (whether it occurs or not), then the labels in order. The table of distinct labels is small."""
    labels = docs.select(F.explode(tags).alias("label")).where(F.col("label") != "O").distinct()
    ranked = labels.withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")).cast("bigint"))
    return ranked.unionByName(docs.sparkSession.createDataFrame([("O", 0)], "label string, id bigint"))


def first_subtoken(sub: DataFrame, keys: list[str]) -> DataFrame:
    """Sub-token rows (keys..., pos, word_id, label_id) with ``target``: the label where a word begins, else -100."""
    before = F.lag("word_id").over(Window.partitionBy(*keys).orderBy("pos"))
    starts = F.col("word_id").isNotNull() & ~F.coalesce(F.col("word_id") == before, F.lit(False))
    return sub.withColumn("target", F.when(starts, F.col("label_id")).otherwise(-100))
