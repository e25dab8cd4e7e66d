"""Instruction records from annotated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import bio, prompts


def schema_by_act(docs: DataFrame, act: str = "act", tags: str = "tags") -> DataFrame:
    """(act, etypes): the sorted types that occur in any document of the act."""
    return (
        docs.select(act, F.explode(bio.entity_types(F.col(tags))).alias("t")).distinct()
        .groupBy(act).agg(F.sort_array(F.collect_list("t")).alias("etypes"))
    )


def fan_out(docs: DataFrame, schema: DataFrame, keep: list[str]) -> DataFrame:
    """One record per document and type of its act: the ``keep`` columns, then entity_type, instruction,
    instruction_fmt, input, output, is_negative.

    ``docs`` has act, tokens and tags; ``schema`` is (act, etypes), one row per act. Types the document lacks give
    negative records; a document whose act has no schema gives none. Null tokens or tags read as empty.
    """
    t = F.col("entity_type")
    empty = F.array().cast("array<string>")
    wide = docs.select(*keep, F.col("act").alias("__act"), F.coalesce("tokens", empty).alias("__k"), F.coalesce("tags", empty).alias("__g"))
    types = schema.select(F.col("act").alias("__act"), F.explode("etypes").alias("entity_type"))
    return wide.join(types, "__act").select(
        *keep, t, prompts.instruction(t).alias("instruction"), prompts.instruction_with_format(t).alias("instruction_fmt"),
        F.array_join("__k", " ").alias("input"), bio.render(F.col("__k"), bio.slice_to(F.col("__g"), t)).alias("output"),
        bio.is_negative(F.col("__g"), t).alias("is_negative"))
