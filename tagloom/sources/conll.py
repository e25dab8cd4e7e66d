"""CoNLL files, read in blocks of lines: segments and their headers run on over the borders of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import WS, strip
from tagloom.plans.storage import stage
from tagloom.sources.lines import carried, numbered, read_lines


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files, staged: several passes number them, and all must see the same blocks."""
    found = read_lines(spark, path)
    if not found.inputFiles():
        raise FileNotFoundError(f"no files match {path}")
    return stage(found, "lines")


def act_of_file(name):
    """File name without suffix and a leading ``Ato_``."""
    return F.regexp_replace(F.regexp_replace(name, r"\.conll$", ""), "^Ato_", "")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(act, seq, publication, tokens, tags) of annotated files, one act a file.

    A blank line or a ``Publication:`` line closes a document; a blank line also forgets the publication. First and
    last field of a line are token and tag; a lone field is tagged ``O``. Documents without tokens are dropped.
    """
    header = F.col("line").startswith("Publication:")
    marked = _lines(spark, path).withColumn("blank", strip(F.col("line")) == "").withColumn("header", header)
    marked = numbered(marked, F.col("blank") | F.col("header"), "doc", inclusive=True)
    fields = F.filter(F.split("line", rf"(?U){WS}+"), lambda x: x != "")
    parts = marked.withColumn("f", fields).withColumn("is_token", ~F.col("blank") & ~F.col("header"))
    entry = F.struct("block", "n", F.get("f", F.lit(0)).alias("k"), F.when(F.size("f") < 2, "O").otherwise(F.element_at("f", -1)).alias("g"))
    docs = parts.groupBy("file", "name", "doc").agg(
        F.max(F.when(F.col("header"), strip(F.regexp_extract("line", "^[^:]*:(.*)$", 1)))).alias("publication"),
        F.sort_array(F.collect_list(F.when(F.col("is_token"), entry))).alias("t"))
    return docs.where(F.size("t") > 0).select(
        act_of_file(F.col("name")).alias("act"), F.col("doc").alias("seq"), "publication",
        F.transform("t", lambda x: x["k"]).alias("tokens"), F.transform("t", lambda x: x["g"]).alias("tags"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, publication, act, tokens, tags) of split files.

    Blank and ``Act:`` lines close a segment; one closed by ``Act:`` is discarded. Publication and act carry on over
    blank lines. The last space of a line separates token and label; a line without one is an error.
    """
    lines = _lines(spark, path).withColumns({
        "pub": F.when(F.col("line").startswith("Publication:"), strip(F.regexp_extract("line", "^[^:]*:(.*)$", 1))),
        "act": F.when(F.col("line").startswith("Act:"), strip(F.regexp_extract("line", "^[^:]*:(.*)$", 1)))})
    lines = lines.withColumns({
        "is_act": F.col("act").isNotNull(), "is_pub": F.col("pub").isNotNull(), "blank": F.col("pub").isNull() & F.col("act").isNull() & (strip(F.col("line")) == "")})
    lines = carried(numbered(lines, F.col("blank") | F.col("is_act"), "seg", inclusive=False), ["pub", "act"])
    is_token = ~F.col("blank") & ~F.col("is_act") & ~F.col("is_pub")
    label = F.regexp_extract("line", "^(.*) ([^ ]*)$", 2)
    checked = F.when(F.col("line").contains(" "), label).otherwise(F.raise_error(F.concat(F.lit("no label in line: "), F.col("line"))))
    entry = F.struct("block", "n", F.regexp_extract("line", "^(.*) ([^ ]*)$", 1).alias("k"), checked.alias("g"))
    docs = lines.groupBy("file", "seg").agg(
        F.max("is_act").alias("dropped"), F.max_by("pub", F.struct("block", "n")).alias("publication"), F.max_by("act", F.struct("block", "n")).alias("act"),
        F.sort_array(F.collect_list(F.when(is_token, entry))).alias("t"))
    return docs.where(~F.col("dropped") & (F.size("t") > 0)).select(
        "file", F.col("seg").alias("seq"), "publication", "act", F.transform("t", lambda x: x["k"]).alias("tokens"), F.transform("t", lambda x: x["g"]).alias("tags"))


def render(docs: DataFrame) -> DataFrame:
    """Adds ``text``: the document in split format, with its closing blank line left to the writer."""
    body = F.array_join(F.transform(F.arrays_zip("tokens", "tags"), lambda z: F.concat(z["tokens"], F.lit(" "), z["tags"])), "\n")
    return docs.withColumn("text", F.concat(
        F.lit("Publication: "), F.coalesce("publication", F.lit("None")), F.lit("\nAct: "), F.coalesce("act", F.lit("None")), F.lit("\n"), body, F.lit("\n")))


def write_split(docs: DataFrame, path: str, order: list[str]) -> None:
    """Write documents in ``order`` as part files in split format, readable by :func:`read_split`."""
    render(docs.repartitionByRange(*order).sortWithinPartitions(*order)).select("text").write.mode("overwrite").text(path)


def write_raw(docs: DataFrame, path: str) -> None:
    """Write documents (act, publication, tokens, tags) as annotated files, readable by :func:`read_raw` from ``path/*/*``.

    Every task writes files of its own, named by act, so an act may be of any size. Documents without an act are left out.
    """
    lines = F.array_join(F.transform(F.arrays_zip("tokens", "tags"), lambda z: F.concat(z["tokens"], F.lit(" _ _ "), z["tags"])), "\n")
    head = F.when(F.col("publication").isNotNull(), F.concat(F.lit("Publication: "), F.col("publication").cast("string"), F.lit("\n"))).otherwise("")
    docs.where(F.col("act").isNotNull()).select(F.col("act").alias("file_act"), F.concat(head, lines, F.lit("\n"))).write.partitionBy("file_act").text(path)
    context = docs.sparkSession.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(context._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):  # one folder an act, one file a task in it
        name = folder.getPath().getName()
        for i, file in enumerate(fs.listStatus(folder.getPath()) if name.startswith("file_act=") else []):
            place = context._jvm.org.apache.hadoop.fs.Path(root, str(i))
            fs.mkdirs(place)
            fs.rename(file.getPath(), context._jvm.org.apache.hadoop.fs.Path(place, f"Ato_{name.removeprefix('file_act=')}.conll"))
        if name.startswith("file_act="):
            fs.delete(folder.getPath(), True)
