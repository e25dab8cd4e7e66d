"""From model output to predictions: parsing, slicing document labels to records, and the scorer interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.operators.skew import join_unique


def parse_generated(df: DataFrame, text: str, length: str, out: str = "pred") -> DataFrame:
    """Adds ``out``: the labels of generated text, cut or filled to the record's ``length``."""
    return df.withColumn("__labels", bio.parse_inline(F.col(text))).withColumn(out, bio.align(F.col("__labels"), F.col(length))).drop("__labels")


def slice_documents(records: DataFrame, labels: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Records with ``pred`` (the document's labels sliced to the record's type) and ``matched``.

    ``labels`` is (keys..., order, labels); of several documents with the same keys the last by ``order`` counts.
    Records need ``entity_type`` and ``gold``; one without a document is predicted all ``O``. Keys match as values,
    null keys match nothing. Records of one document stay where they are if they are many (``skew.join_unique``), so
    ``records`` is read more than once: pass a scan.
    """
    last = labels.groupBy(*keys).agg(F.max_by("labels", order).alias("__labels"))
    joined = join_unique(records, last, keys, how="left")
    sliced = bio.align(bio.slice_to(F.coalesce("__labels", F.array().cast("array<string>")), F.coalesce("entity_type", F.lit(""))), F.size("gold"))
    return joined.withColumn("pred", sliced).withColumn("matched", F.col("__labels").isNotNull()).drop("__labels")


def unmatched(sliced: DataFrame) -> DataFrame:
    """(records, missing)."""
    return sliced.agg(F.count("*").alias("records"), F.count_if(~F.col("matched")).alias("missing"))


def score(records: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], workers: int | None = None) -> DataFrame:
    """Records with ``gen``, made by ``scorer`` on batches of rows, in ``workers`` parallel partitions if given.

    The scorer is called once per batch and returns one text per row; retries and rate limits are its own matter.
    """
    source = records.repartition(workers) if workers else records
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields] + ["gen string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(gen=scorer(frame))

    return source.mapInPandas(run, schema)
