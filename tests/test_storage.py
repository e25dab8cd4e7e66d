import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tagloom.plans import storage


def test_stage_round_trip_and_drop(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, None)], "id long, x array<string>")
    kept = storage.stage(df, "t")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect())) and kept.schema == df.schema
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.isdir(folder)
    storage.drop_staged(kept)
    assert not os.path.exists(folder)
    assert storage.stage(df.limit(0), "empty").count() == 0


def test_a_workspace_leaves_nothing(spark):
    before = storage.stage(spark.range(3), "before")
    with storage.workspace(spark):
        inside = storage.stage(spark.range(3), "inside")
        folder = inside.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert inside.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(folder) and before.count() == 3


def test_tables_go_when_the_program_ends(tmp_path):
    """A session that never drops anything leaves an empty folder."""
    code = f"""
from pyspark.sql import SparkSession
from tagloom.plans.storage import stage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
print(stage(spark.range(5), "t").count(), *[x for x in __import__("os").listdir("{tmp_path}") if x.startswith("tagloom")])
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": root})
    count, folder = done.stdout.split()
    assert count == "5" and folder.startswith("tagloom-") and folder not in os.listdir(tmp_path)


def test_a_cluster_needs_a_shared_folder():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(session)
