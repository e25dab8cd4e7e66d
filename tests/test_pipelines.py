import json
import random

import pytest

from tagloom import __main__ as cli
from tagloom.plans import pipelines
from tagloom.sources import conll, records


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(0)
    for act in ("Ato_X", "Ato_Y"):
        with open(folder / f"{act}.conll", "w", encoding="utf-8") as out:
            for i in range(40):
                out.write(f"Publication: p{i}\n")
                for _ in range(rng.randrange(1, 9)):
                    out.write(f"t{rng.randrange(3)} {rng.choice(['O', 'B-nome', 'I-nome', 'B-cargo'])}\n")
                out.write("\n")
    return str(folder / "*.conll")


def test_build(spark, corpus, tmp_path):
    summary = pipelines.build_dataset(spark, corpus, str(tmp_path))
    assert summary["doc_totals"]["total"] == 80 and set(summary["doc_counts_per_act"]) == {"X", "Y"}
    docs = {s: conll.read_split(spark, f"{tmp_path}/conll/{s}") for s in ("train", "dev", "test")}
    assert {s: d.count() for s, d in docs.items()} == {s: summary["doc_totals"][s] for s in docs}
    bodies = {s: {(r.act, " ".join(r.tokens)) for r in d.collect()} for s, d in docs.items()}
    assert not (bodies["train"] & bodies["dev"] or bodies["train"] & bodies["test"] or bodies["dev"] & bodies["test"])
    schema = json.loads((tmp_path / "entity_schema.json").read_text())
    assert schema == {"X": ["cargo", "nome"], "Y": ["cargo", "nome"]}
    recs = records.read_jsonl(spark, f"{tmp_path}/finetune")
    assert recs.count() == 160 == sum(c["records"] for c in summary["finetune_record_counts"].values())


def result(tmp_path, name, seed):
    rng = random.Random(1)
    noise = random.Random(seed)
    preds = []
    for i in range(60):
        gold = [rng.choice(["O", "B-a", "I-a"]) for _ in range(8)]
        preds.append({"publication": f"p{i % 12}", "act": "xy"[i % 2], "entity_type": "a", "is_negative": False, "gold": gold,
                      "pred": [t if noise.random() < 0.9 else "O" for t in gold]})
    doc = {"model": name, "split": "test", "metrics": {"f1": 0.1, "precision": 0.1, "recall": 0.1}, "predictions": preds}
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(doc))
    return str(path)


def test_evaluate_compare_errors(spark, tmp_path, capsys):
    a, b = result(tmp_path, "a", 5), result(tmp_path, "b", 6)
    made = pipelines.evaluate(pipelines.load_predictions(spark, a), "a", "test", 40)
    assert set(made) == {"model", "split", "metrics", "per_act", "per_entity", "bootstrap"} and set(made["per_act"]) == {"x", "y"}
    assert made["bootstrap"]["ci_lower"] <= made["metrics"]["strict"]["f1"] <= made["bootstrap"]["ci_upper"]
    same = pipelines.compare(pipelines.load_predictions(spark, a), pipelines.load_predictions(spark, a), iterations=20)
    assert same["delta_f1"] == 0 and same["bootstrap"] == {"ci_lower": 0.0, "ci_upper": 0.0, "h1_sustained": False}
    with pytest.raises(ValueError, match="different"):
        pipelines.compare(pipelines.load_predictions(spark, a), pipelines.load_predictions(spark, b).where("publication <> 'p1'"), iterations=5)
    cli.main(["compare", a, b, "--iterations", "20"])
    assert '"delta_f1"' in capsys.readouterr().out
    cli.main(["errors", a, b, "--by", "entity_type"])
    assert "omission_share" in capsys.readouterr().out
    cli.main(["evaluate", a, "--iterations", "20", "--out", str(tmp_path / "out.json")])
    assert json.loads((tmp_path / "out.json").read_text())["model"] == "a"


def test_benchmarks_and_checkpoints(spark, tmp_path, capsys):
    rows = [("base", 1, "core", {"a": 0.5, "probe": 0.2}), ("m", 1, "core", {"a": 0.45, "probe": 0.3}), ("base", 2, "core", {"a": 0.5}), ("m", 2, "core", {"a": 0.51, "z": 0.1})]
    delta, bench, seeds = pipelines.benchmark_tables(spark.createDataFrame(rows, "model string, seed int, task_set string, scores map<string,double>"), "base", ["probe"])
    assert {(r.seed, r.bench): r.reading for r in delta.collect()} == {(1, "a"): "SIGNIFICANT", (1, "probe"): "SIGNIFICANT", (2, "a"): "moderate", (2, "z"): "N/A"}
    assert {r.bench: r.seeds for r in bench.collect()} == {"a": 2, "probe": 1, "z": 0}
    assert seeds.first().mean_delta == pytest.approx(-2.0)
    (tmp_path / "c.csv").write_text("run,step,dev_f1\nr,50,0.1\nr,100,0.3\nr,150,\n")
    cli.main(["checkpoints", str(tmp_path / "c.csv")])
    assert "100" in capsys.readouterr().out
