"""Named queries of the readers and writers, and of the operators beside them: what is written is read back and compared
with the table it came from. ``SQL`` has the same results straight from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.operators import features, predict, selection, splits
from tagloom.oracle import DOC, PRED, REC, _SPLITTED
from tagloom.plans import pipelines
from tagloom.plans.storage import new_path, stage
from tagloom.sources import conll, resume
from tagloom.sources import records as io
from tagloom.sources.tables import table


def _tables():
    from tagloom import catalog

    return catalog


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return stage(_tables().documents(spark, d).where(F.size("tokens") > 0), "documents")


def conll_raw_read(spark, d):
    """Annotated files, one act a file, written and parsed."""
    path = new_path(spark, "raw")
    conll.write_raw(_documents(spark, d), path)
    return conll.read_raw(spark, f"{path}/*/*.conll").select("act", "publication", "tokens", "tags")


def conll_split_read(spark, d):
    """Split files in the order of act and publication, written and parsed."""
    path = new_path(spark, "split")
    docs = _documents(spark, d).withColumn("publication", F.col("publication").cast("string"))
    conll.write_split(docs, path, ["act", "publication", "act_id"])
    return conll.read_split(spark, path).select("act", "publication", "tokens", "tags")


def conll_order(spark, d):
    """Documents of split files in the order in which they stand there: how many, and how many out of order."""
    path = new_path(spark, "ordered")
    docs = _documents(spark, d).where("act is not null and publication is not null").withColumn("publication", F.col("publication").cast("string"))
    conll.write_split(docs, path, ["act", "publication", "act_id"])
    read = stage(conll.read_split(spark, path).select("file", "seq", F.struct("act", "publication").alias("k")), "read")
    before = F.lag("k").over(Window.partitionBy("file").orderBy("seq"))
    inside = read.select((F.col("k") < before).alias("late")).agg(F.count("*").alias("docs"), F.count_if("late").alias("late"))
    # files follow one another by name: one row a file
    files = read.groupBy("file").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    between = files.select((F.col("first") < F.lag("last").over(Window.orderBy("file"))).alias("late")).agg(F.count_if("late").alias("n"))
    return inside.select("docs", (F.col("late") + between.scalar()).alias("out_of_order"))


def records_read(spark, d):
    """The dev records of records written by split, one JSON object a line; only their folder is read."""
    path = new_path(spark, "records")
    kept = [f.split()[0] for f in io.RECORD.split(", ")]
    io.write_jsonl(_tables().instructions(spark, d).withColumn("publication", F.col("publication").cast("string")).select(*kept), path, by_split=True)
    return io.read_jsonl(spark, path).where("split = 'dev'").select(*kept)


def results_read(spark, d):
    """Whole result documents of up to 1,000 predictions each; every second one lacks a strict score."""
    path = new_path(spark, "results")
    part = F.expr("idx div 1000")
    fields = [f.split()[0] for f in io.PREDICTION.split(", ")]
    entry = F.struct("idx", *[F.col(f).cast("string").alias(f) if f == "publication" else F.col(f) for f in fields])
    docs = _tables().predictions(spark, d).groupBy(F.concat(F.lit("part"), part.cast("string")).alias("model")).agg(
        F.sort_array(F.collect_list(entry)).alias("predictions"))
    score = F.size("predictions") / F.lit(1000.0)
    docs = docs.select("model", F.lit("test").alias("split"), F.struct(
        score.alias("f1"), F.when(F.substring("model", -1, 1).isin(*"13579"), F.struct((score / 2).alias("f1"))).alias("strict")).alias("metrics"), "predictions")
    docs.write.partitionBy("model").json(path)
    read = io.read_results(spark, path)
    named = io.predictions(read).join(read.select("model", "f1_canonical"), "model")
    return named.select("model", "idx", "act", "entity_type", "is_negative", "gold", "pred", "gen", F.round("f1_canonical", 6).alias("f1"))


def log_read(spark, d):
    """A log in which every record stands twice, with an unreadable line behind: the later entry counts."""
    path = new_path(spark, "log")
    p = _tables().predictions(spark, d).withColumn("publication", F.col("publication").cast("string"))
    entry = lambda gen: F.to_json(F.struct("idx", "publication", "act", "entity_type", "is_negative", "gold", "pred", gen.alias("gen")))
    lines = F.concat_ws("\n", entry(F.lit("draft")), entry(F.coalesce("gen", F.lit("none"))), F.concat(F.lit('{"idx": '), F.col("idx").cast("string")))
    p.select(lines).write.text(path)
    return resume.read_log(spark, path).select("idx", "act", "entity_type", "gold", "gen")


def log_append(spark, d):
    """A log filled by two appends: negatives, then the others."""
    path = new_path(spark, "log")
    p = stage(_tables().predictions(spark, d).withColumn("publication", F.col("publication").cast("string")), "predictions")
    for part in (p.where("is_negative"), p.where("not is_negative or is_negative is null")):
        resume.append_log(part.select("idx", *[f.split()[0] for f in io.PREDICTION.split(", ")]), path)
    return resume.read_log(spark, path).select("idx", "act", "publication", "is_negative", "pred")


def report_read(spark, d):
    """The split statistics as one JSON document by act, written and read."""
    path = f"{new_path(spark, 'report')}/split_stats.json"
    io.write_report(io.report(_tables().split_stats(spark, d), "act"), path, spark)
    return io.read_report(spark, path, "train:bigint,dev:bigint,test:bigint,total:bigint").withColumnRenamed("key", "act")


def console_table(spark, d):
    """The lines of the fixed-width table of record counts by split."""
    text = io.console(_tables().record_counts(spark, d).orderBy("split"))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


def run_tags(spark, d):
    runs = table(spark, d, "run_registry")
    return runs.select("path", io.stem(F.col("path")).alias("stem"), io.tag_column(F.concat(F.lit("runs/"), F.col("method"), F.lit("/")), F.col("seed")).alias("tag"))


def first_subtokens(spark, d):
    """Tokens cut into pieces of four characters between two marks without a word: only a token's first piece has a target."""
    docs = _tables().label_encode(spark, d).join(_tables().documents(spark, d).select("act_id", "tokens"), "act_id")
    piece = "struct<word_id:int,label_id:bigint>"
    none = F.array(F.struct(F.lit(None).cast("int").alias("word_id"), F.lit(None).cast("bigint").alias("label_id"))).cast(f"array<{piece}>")
    pieces = F.transform("tokens", lambda t, i: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(t) / 4).cast("int"))),
        lambda _: F.struct(i.alias("word_id"), F.get("ids", i).cast("bigint").alias("label_id"))))
    rows = docs.select("act_id", F.posexplode(F.concat(none, F.flatten(pieces).cast(f"array<{piece}>"), none)).alias("pos", "p"))
    return features.first_subtoken(rows.select("act_id", "pos", "p.*"), ["act_id"]).select("act_id", "pos", "word_id", "target")


def label_argmax(spark, d):
    """The place of the largest of a vector of scores; here the lengths of a document's tokens stand for them."""
    docs = _tables().documents(spark, d).where(F.size("tokens") > 0)
    return docs.select("act_id", bio.argmax(F.transform("tokens", lambda t: F.length(t).cast("double"))).cast("bigint").alias("place"))


def scored_records(spark, d):
    """Texts made by a scorer on batches, in four partitions."""
    p = _tables().predictions(spark, d).select("idx", F.coalesce("act", F.lit("")).alias("act"))
    return predict.score(p, lambda frame: frame["act"].str.upper() + "!", workers=4)


def checkpoint_latest(spark, d):
    """The last complete step of each run; a step is complete once it has a score."""
    return selection.latest(table(spark, d, "checkpoints").withColumn("complete", F.col("dev_f1").isNotNull()), "complete")


def result_last(spark, d):
    """The result that sorts last by its path, of each method and family."""
    return selection.last_result(table(spark, d, "run_registry"), ["method", "family"], "path")


def pipeline_build(spark, d):
    """Annotated files to a data set, and what is read back of it: documents and records by split."""
    raw, out = new_path(spark, "raw"), new_path(spark, "built")
    conll.write_raw(_documents(spark, d), raw)
    pipelines.build_dataset(spark, f"{raw}/*/*.conll", out)
    docs = None
    for split in splits.SPLITS:
        part = conll.read_split(spark, f"{out}/conll/{split}").select(F.lit(split).alias("split"))
        docs = part if docs is None else docs.unionByName(part)
    counted = splits.record_counts(io.read_jsonl(spark, f"{out}/finetune")).select("split", "records", "negatives")
    return docs.groupBy("split").agg(F.count("*").alias("docs")).join(counted, "split", "left").select("split", "docs", "records", "negatives")


def _asked(spark, d):
    return _tables().instructions(spark, d).where("split in ('dev', 'test')").select(F.col("record_id").alias("idx"), "split")


def resume_left(spark, d):
    """Dev and test records without a prediction, when all predictions of the table are in the log."""
    return resume.todo(_asked(spark, d), _tables().predictions(spark, d), ["idx"])


def completeness_by_split(spark, d):
    asked = stage(_asked(spark, d), "asked")
    left = resume.todo(asked, _tables().predictions(spark, d), ["idx"]).groupBy("split").agg(F.count("*").alias("missing"))
    return asked.groupBy("split").agg(F.count("*").alias("asked")).join(left, "split", "left").select(
        "split", "asked", F.coalesce("missing", F.lit(0)).alias("missing"), F.col("missing").isNull().alias("complete"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (conll_raw_read, conll_split_read, conll_order, records_read, results_read, log_read, log_append, report_read, console_table, run_tags, first_subtokens,
              label_argmax, scored_records, checkpoint_latest, result_last, pipeline_build, resume_left, completeness_by_split)
}

_LABELS = "l AS (SELECT DISTINCT unnest(tags) AS label FROM doc), v AS (SELECT ['O'] || list(label ORDER BY label) FILTER (label <> 'O') AS v FROM l)"
_ASKED = "asked AS (SELECT record_id AS idx, split FROM rec WHERE split IN ('dev', 'test'))"

SQL: dict[str, str] = {
    "conll_raw_read": f"WITH {DOC} SELECT act, publication::VARCHAR AS publication, tokens, tags FROM doc WHERE act IS NOT NULL AND len(tokens) > 0",
    "conll_split_read": f"WITH {DOC} SELECT coalesce(act, 'None') AS act, coalesce(publication::VARCHAR, 'None') AS publication, tokens, tags FROM doc WHERE len(tokens) > 0",
    "conll_order": f"WITH {DOC} SELECT count(*) AS docs, 0::BIGINT AS out_of_order FROM doc WHERE len(tokens) > 0 AND act IS NOT NULL AND publication IS NOT NULL",
    "records_read": f"""WITH {REC} SELECT instruction, instruction_fmt, input, output, act, entity_type, publication::VARCHAR AS publication, is_negative, split
      FROM rec WHERE split = 'dev'""",
    "results_read": f"""WITH {PRED}, p AS (SELECT *, idx // 1000 AS part, count(*) OVER (PARTITION BY idx // 1000) / 1000.0::DOUBLE AS score,
        (row_number() OVER (PARTITION BY idx // 1000 ORDER BY idx) - 1)::INT AS place FROM pred)
      SELECT 'part' || part AS model, place AS idx, act, entity_type, is_negative, gold, pred, gen,
        round(CASE WHEN part % 2 = 1 THEN score / 2 ELSE score END, 6) AS f1 FROM p""",
    "log_read": f"WITH {PRED} SELECT idx, act, entity_type, gold, coalesce(gen, 'none') AS gen FROM pred",
    "log_append": f"WITH {PRED} SELECT idx, act, publication::VARCHAR AS publication, is_negative, pred FROM pred",
    "report_read": _SPLITTED + """ SELECT coalesce(act, 'None') AS act, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev,
      count(*) FILTER (split = 'test') AS test, count(*) AS total FROM splitted GROUP BY ROLLUP (act)""",
    "console_table": f"""WITH {REC}, c AS (SELECT split, count(*) AS records, count(*) FILTER (is_negative) AS negatives, round(count(*) FILTER (is_negative) / count(*), 6) AS share FROM rec GROUP BY split)
      SELECT 0 AS n, concat_ws(' ', lpad('split', 12, ' '), lpad('records', 12, ' '), lpad('negatives', 12, ' '), 'negative_share') AS line UNION ALL
      SELECT (row_number() OVER (ORDER BY split NULLS FIRST))::INT, concat_ws(' ', lpad(coalesce(split, '-'), 12, ' '), lpad(records::VARCHAR, 12, ' '),
        lpad(negatives::VARCHAR, 12, ' '), lpad(format('{{:.4f}}', share), 12, ' ')) FROM c""",
    "run_tags": r"""SELECT path, regexp_replace(list_last(string_split(rtrim(path, '/'), '/')), '(.)\.[^.]*$', '\1') AS stem,
      method || CASE WHEN contains(method, '_fmt') THEN '' ELSE '_fmt' END || CASE WHEN seed <> 42 THEN '_s' || seed ELSE '' END AS tag FROM run_registry""",
    "first_subtokens": f"""WITH {DOC}, {_LABELS}, w AS (SELECT act_id, unnest(tokens) AS token, unnest(tags) AS tag, (generate_subscripts(tokens, 1) - 1)::INT AS word_id FROM doc
      ), c AS (SELECT w.*, greatest(1, (length(token) + 3) // 4) AS n, list_position(v, tag) - 1 AS label_id FROM w, v
      ), b AS (SELECT *, 1 + coalesce(sum(n) OVER (PARTITION BY act_id ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM c
      ), e AS (SELECT act_id, word_id, label_id, first, unnest(range(0, n)) AS j FROM b)
      SELECT act_id, (first + j)::INT AS pos, word_id, CASE WHEN j = 0 THEN label_id ELSE -100 END AS target FROM e UNION ALL
      SELECT act_id, 0, NULL, -100 FROM doc UNION ALL
      SELECT act_id, (1 + coalesce(n, 0))::INT, NULL, -100 FROM doc LEFT JOIN (SELECT act_id, sum(n) AS n FROM c GROUP BY act_id) USING (act_id)""",
    "label_argmax": f"""WITH {DOC}, s AS (SELECT act_id, list_transform(tokens, lambda t: length(t)) AS s FROM doc WHERE len(tokens) > 0)
      SELECT act_id, list_position(s, list_max(s)) - 1 AS place FROM s""",
    "scored_records": f"WITH {PRED} SELECT idx, coalesce(act, '') AS act, upper(coalesce(act, '')) || '!' AS gen FROM pred",
    "checkpoint_latest": "SELECT run, max(step) AS step FROM checkpoints WHERE dev_f1 IS NOT NULL GROUP BY run",
    "result_last": "SELECT method, family, max(path) AS path FROM run_registry WHERE path IS NOT NULL GROUP BY ALL",
    "pipeline_build": _SPLITTED + """, typ AS (SELECT DISTINCT act, regexp_extract(tag, '-(.*)$', 1) AS etype FROM (SELECT act, unnest(tags) AS tag FROM doc WHERE act IS NOT NULL)
      WHERE tag <> 'O' AND contains(tag, '-')
    ), r AS (SELECT split, NOT list_contains(tags, 'B-' || etype) AND NOT list_contains(tags, 'I-' || etype) AS negative
      FROM splitted JOIN doc USING (act_id) JOIN typ ON typ.act = splitted.act
    ), c AS (SELECT split, count(*) AS records, count(*) FILTER (negative) AS negatives FROM r GROUP BY split)
    SELECT split, docs, records, negatives FROM (SELECT split, count(*) AS docs FROM splitted GROUP BY split) LEFT JOIN c USING (split)""",
    "resume_left": f"WITH {PRED}, {REC}, {_ASKED} SELECT idx, split FROM asked ANTI JOIN pred USING (idx)",
    "completeness_by_split": f"""WITH {PRED}, {REC}, {_ASKED} SELECT split, count(*) AS asked, count(*) FILTER (pred.idx IS NULL) AS missing,
      count(*) FILTER (pred.idx IS NULL) = 0 AS complete FROM asked LEFT JOIN pred USING (idx) GROUP BY split""",
}
