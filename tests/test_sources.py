import json

import pytest
from pyspark.sql import functions as F

from tagloom.sources import conll, records, resume
from tagloom.streaming import log

RAW = "Publication: p1\nAna x B-nome\nveio O\n\nsolto\n\n \nPublication: p2\nPublication: p3\nb B-a\nPublication: p4\nc O"
SPLIT = "Publication: p1\nAct: X\na b B-n\nc O\n\nd O\nAct: Y\ne O\n\nPublication: p2\nf I-n\n"


def test_raw_files(spark, tmp_path):
    (tmp_path / "Ato_Nomeacao.conll").write_text(RAW, encoding="utf-8")
    (tmp_path / "Cessao.conll").write_text("", encoding="utf-8")
    got = conll.read_raw(spark, str(tmp_path / "*.conll")).orderBy("seq").collect()
    assert [(r.act, r.publication, r.tokens, r.tags) for r in got] == [
        ("Nomeacao", "p1", ["Ana", "veio"], ["B-nome", "O"]), ("Nomeacao", None, ["solto"], ["O"]),
        ("Nomeacao", "p3", ["b"], ["B-a"]), ("Nomeacao", "p4", ["c"], ["O"])]


@pytest.mark.parametrize("block", [16, 64])
def test_files_in_many_blocks(spark, tmp_path, block):
    """Files far larger than a block: documents, segments and headers run across the borders, and log order holds."""
    (tmp_path / "Ato_X.conll").write_text("".join(f"Publication: p{i}\n" + "".join(f"t{i}.{j} _ O\n" for j in range(i % 7)) + "\n" * (i % 3) for i in range(60)))
    (tmp_path / "train.conll").write_text("".join(f"Publication: p{i // 9}\nAct: A{i // 4}\n" * (i % 4 == 0) + f"a{i} O\nb{i} B-x\n\n" for i in range(60)))
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({"idx": i % 5, "act": str(i)}) for i in range(60)) + "\n{half")
    whole = {}
    for size in (128 << 20, block):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            lines = conll.read_lines(spark, str(tmp_path / "*.conll"))
            assert (lines.select("block").distinct().count() > 20) == (size == block) and (size > block or lines.rdd.getNumPartitions() > 20)
            raw = sorted(map(tuple, conll.read_raw(spark, str(tmp_path / "Ato_X.conll")).collect()), key=repr)
            split = sorted((tuple(r)[1:] for r in conll.read_split(spark, str(tmp_path / "train.conll")).collect()), key=repr)
            log = {r.idx: r.act for r in resume.read_log(spark, str(tmp_path / "log.jsonl")).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes"), spark.conf.unset("spark.sql.files.openCostInBytes")
        whole.setdefault("raw", raw), whole.setdefault("split", split), whole.setdefault("log", log)
        assert (raw, split, log) == (whole["raw"], whole["split"], whole["log"])
    assert len(whole["raw"]) == sum(i % 7 > 0 for i in range(60)) and len(whole["split"]) == 60 and whole["log"] == {i: str(55 + i) for i in range(5)}


def test_missing_files_are_an_error(spark, tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        conll.read_raw(spark, str(tmp_path / "*.conll")).count()


def test_split_files(spark, tmp_path):
    (tmp_path / "train.conll").write_text(SPLIT, encoding="utf-8")
    got = conll.read_split(spark, str(tmp_path / "train.conll")).orderBy("seq").collect()
    assert [(r.publication, r.act, r.tokens, r.tags) for r in got] == [
        ("p1", "X", ["a b", "c"], ["B-n", "O"]), ("p1", "Y", ["e"], ["O"]), ("p2", "Y", ["f"], ["I-n"])]
    (tmp_path / "bad.conll").write_text("Publication: p\nAct: X\nword\n", encoding="utf-8")
    with pytest.raises(Exception, match="no label"):
        conll.read_split(spark, str(tmp_path / "bad.conll")).collect()


def test_split_writer_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("p2", "B", ["x", "y"], ["O", "B-a"]), ("p1", "A", ["z"], ["I-a"])], "publication string, act string, tokens array<string>, tags array<string>")
    conll.write_split(docs, str(tmp_path / "out"), ["act", "publication"])
    back = conll.read_split(spark, str(tmp_path / "out")).select("publication", "act", "tokens", "tags")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))


def test_jsonl_keeps_nulls_and_prunes_splits(spark, tmp_path):
    rows = [("i", "f", "in é", "out", "x", "a", None, False, "train"), ("i", None, "in", "out", "x", "a", "p", True, "dev")]
    df = spark.createDataFrame(rows, records.RECORD)
    records.write_jsonl(df, str(tmp_path / "flat"))
    lines = [json.loads(x) for p in (tmp_path / "flat").glob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert {"publication", "instruction_fmt"} <= set(lines[0]) and sorted(x["input"] for x in lines) == ["in", "in é"]
    records.write_jsonl(df, str(tmp_path / "parts"), by_split=True)
    assert records.read_jsonl(spark, str(tmp_path / "parts")).where("split = 'dev'").count() == 1


def test_results_and_reports(spark, tmp_path):
    doc = {"model": "m", "split": "test", "metrics": {"f1": 0.5, "precision": 0.5, "recall": 0.5},
           "predictions": [{"publication": "p", "act": "x", "entity_type": "a", "is_negative": False, "gold": ["B-a"], "pred": ["O"], "gen": "t"}]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    read = records.read_results(spark, str(tmp_path / "r.json"))
    assert read.first().f1_canonical == 0.5
    p = records.predictions(read).first()
    assert (p.model, p.idx, p.gold, p.gen) == ("m", 0, ["B-a"], "t")
    (tmp_path / "b.json").write_text(json.dumps({"model": "m", "tag": "t", "task_set": "core", "num_fewshot": 0, "scores": {"a": 0.1, "b": None}}))
    assert records.read_benchmarks(spark, [str(tmp_path / "b.json")]).first().scores == {"a": 0.1, "b": None}
    rep = spark.createDataFrame([("x", 1, 0.5)], "act string, n int, f double")
    assert records.report(rep, "act") == {"x": {"n": 1, "f": 0.5}}
    records.write_report({"é": 1}, str(tmp_path / "rep.json"))
    assert json.loads((tmp_path / "rep.json").read_text(encoding="utf-8")) == {"é": 1}
    assert "0.5000" in records.console(rep)
    assert records.model_tag("a/b/lora_r8", few_shot=3, seed=43, share=0.25, quantized=True, smoke=True) == "lora_r8_fs3_fmt_qlora_f25_s43_smoke"


def test_resume(spark, tmp_path):
    good = {"idx": 1, "act": "x", "gold": ["O"], "pred": ["O"]}
    lines = [json.dumps(good), "{broken", json.dumps({"act": "no idx"}), json.dumps(good | {"act": "y"}), json.dumps(good | {"idx": 2})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    done = resume.read_log(spark, str(tmp_path / "log.jsonl"))
    assert {r.idx: r.act for r in done.collect()} == {1: "y", 2: "x"}
    recs = spark.range(1, 4).withColumnRenamed("id", "idx")
    assert [r.idx for r in resume.todo(recs, done, ["idx"]).collect()] == [3]
    with pytest.raises(ValueError, match="1 records"):
        resume.require_complete(recs, done, ["idx"])
    assert resume.require_complete(recs.where("idx < 3"), done, ["idx"]) is done


def test_log_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"idx": 1, "act": "x", "gold": ["B-a"], "pred": ["B-a"]}) + "\n" + json.dumps({"act": "x"}) + "\n")
    stream = log.read_log_stream(spark, str(src))
    query = log.running_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("counts").collect()] == [("x", 1, 1, 1, 1)]
    log.append_stream(log.read_log_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).select(F.col("idx")).collect()[0].idx == 1
