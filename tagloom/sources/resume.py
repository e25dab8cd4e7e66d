"""Resumable scoring: a log of finished records, what is left, and the gate before measuring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.sources.lines import read_lines
from tagloom.sources.records import PREDICTION

LOG = f"idx bigint, {PREDICTION}"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The last complete entry of each ``idx``; unreadable lines and lines without idx are skipped."""
    entries = read_lines(spark, path).select("file", "block", "n", F.from_json("line", LOG).alias("r")).where("r.idx is not null")
    return entries.groupBy("r.idx").agg(F.max_by("r", F.struct("file", "block", "n")).alias("r")).select("r.*")


def append_log(done: DataFrame, path: str) -> None:
    """Add finished records; the committer keeps half-written files out of sight."""
    done.write.mode("append").option("ignoreNullFields", "false").json(path)


def todo(records: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Records that are not in the log."""
    return records.join(done.select(*keys).distinct(), keys, "left_anti")


def require_complete(records: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """``done`` once every record is in it; raises before anything is measured otherwise."""
    left = todo(records, done, keys)
    if not left.isEmpty():
        raise ValueError(f"{left.count()} records have no prediction yet")
    return done
