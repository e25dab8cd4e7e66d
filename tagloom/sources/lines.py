"""Lines of text files with a place in their file, read in blocks.

A large file is cut into blocks by the text source, which gives whole lines. Within a block, lines come in order; blocks
are ordered by the byte they start at. So (block, line) orders the lines of a file without any task seeing all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, block, n, line): all lines; ``n`` rises along a block but isn't dense."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def _within() -> WindowSpec:
    """Lines of one block in order."""
    return Window.partitionBy("file", "block").orderBy("n")


def _earlier() -> WindowSpec:
    """The blocks of a file before this one: a window over one row per block."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def numbered(lines: DataFrame, breaks: Column, out: str, inclusive: bool) -> DataFrame:
    """Adds ``out``: how many lines up to this one (or before it) are breaks, counted over the whole file."""
    marked = lines.withColumn("__b", breaks.cast("int"))
    window = _within().rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    blocks = marked.groupBy("file", "block").agg(F.sum("__b").alias("__sum"))
    before = blocks.select("file", "block", F.coalesce(F.sum("__sum").over(_earlier()), F.lit(0)).alias("__before"))
    return (
        marked.withColumn(out, F.coalesce(F.sum("__b").over(window), F.lit(0))).join(before, ["file", "block"])
        .withColumn(out, F.col(out) + F.col("__before")).drop("__b", "__before")
    )


def carried(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Every column filled with its last value that is not null, over the borders of blocks too."""
    blocks = lines.groupBy("file", "block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c) for c in columns])
    before = blocks.select("file", "block", *[F.last(c, ignorenulls=True).over(_earlier()).alias(f"__{c}") for c in columns])
    upto = _within().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = lines.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})
    return here.join(before, ["file", "block"]).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])
