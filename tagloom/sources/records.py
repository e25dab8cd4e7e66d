"""JSON sources and sinks: records, result documents, benchmark files, reports."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("instruction string, instruction_fmt string, input string, output string, act string, entity_type string, "
          "publication string, is_negative boolean, split string")
PREDICTION = "publication string, act string, entity_type string, is_negative boolean, gold array<string>, pred array<string>, gen string"
RESULT = f"model string, split string, metrics struct<f1:double,precision:double,recall:double,strict:struct<f1:double>>, predictions array<struct<{PREDICTION.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>"
BENCHMARK = "model string, tag string, task_set string, num_fewshot int, scores map<string,double>"


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, by_split: bool = False) -> None:
    """One object a line, nulls kept; ``by_split`` writes a folder per split, which readers prune by."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy("split") if by_split else writer).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Whole result documents; a strict score that is missing reads as the default one."""
    docs = spark.read.schema(RESULT).option("multiLine", "true").json(path)
    return docs.withColumn("f1_canonical", F.coalesce("metrics.strict.f1", "metrics.f1"))


def predictions(results: DataFrame) -> DataFrame:
    """One row per prediction, with its model and place in the document."""
    return results.select("model", F.posexplode("predictions").alias("idx", "p")).select("model", "idx", "p.*")


def read_benchmarks(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(BENCHMARK).option("multiLine", "true").json(paths)


def report(df: DataFrame, key: str) -> dict[str, Any]:
    """A small aggregate as {key: row}, ready for ``json.dumps``; meant for reports, not for data."""
    return {str(r[key]): {k: v for k, v in r.asDict(recursive=True).items() if k != key} for r in df.collect()}


def write_report(document: dict, path: str, spark: SparkSession | None = None) -> None:
    """One JSON document; with a session, on any file system that Spark knows."""
    text = json.dumps(document, ensure_ascii=False, indent=2)
    if spark is None:
        with open(path, "w", encoding="utf-8") as out:
            out.write(text)
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, fields...) of a report written by key; ``schema`` has the fields."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{schema}>>")).alias("key", "row")).select("key", "row.*")


def console(df: DataFrame, width: int = 12) -> str:
    """A fixed-width table of a small result."""
    def cell(v) -> str:
        return f"{v:>{width}.4f}" if isinstance(v, float) else f"{'-' if v is None else str(v):>{width}}"

    return "\n".join([" ".join(f"{c:>{width}}" for c in df.columns)] + [" ".join(map(cell, r)) for r in df.collect()])


def stem(path: Column) -> Column:
    """The last part of a path, without a slash at its end or the suffix behind its last dot."""
    name = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def tag_column(name: Column, seed: Column) -> Column:
    """:func:`model_tag` of a formatted run as a column: a suffix for the format and one for an unusual seed."""
    tag = F.element_at(F.split(F.rtrim(name, F.lit("/")), "/"), -1)
    tag = F.concat(tag, F.when(tag.contains("_fmt"), "").otherwise("_fmt"))
    return F.concat(tag, F.when(seed != 42, F.concat(F.lit("_s"), seed.cast("string"))).otherwise(""))


def model_tag(name: str, *, few_shot: int = 0, formatted: bool = True, seed: int = 42, share: float = 1.0, quantized: bool = False, smoke: bool = False) -> str:
    """Output name of a run: suffixes only for what differs from the usual run."""
    tag = name.rstrip("/").rsplit("/", 1)[-1]
    tag += f"_fs{few_shot}" if few_shot else ""
    tag += "_fmt" if formatted and "_fmt" not in tag else ""
    tag += "_qlora" if quantized else ""
    tag += f"_f{round(share * 100)}" if share < 1 else ""
    tag += f"_s{seed}" if seed != 42 else ""
    return tag + ("_smoke" if smoke else "")
