"""The resumable log as a stream of files: an extension for scorers that run all the time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.functions import bio
from tagloom.sources.resume import LOG


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Log entries as they arrive; lines without idx are skipped."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).json(path).where("idx is not null")


def running_counts(entries: DataFrame) -> DataFrame:
    """Strict span counts by act over all entries so far; the state is one row per act."""
    g, p = bio.spans(F.col("gold")), bio.spans(F.col("pred"))
    counted = entries.select("act", g.alias("g"), p.alias("p")).select(
        "act", F.size(F.array_intersect("g", "p")).alias("tp"), F.size("p").alias("n_pred"), F.size("g").alias("n_gold"))
    return counted.groupBy("act").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_gold")], F.count("*").alias("records"))


def append_stream(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append entries to a log, exactly once per entry."""
    return entries.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
