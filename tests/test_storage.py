import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from grovewise import storage
from grovewise.operators import graph

ROOT = Path(__file__).resolve().parent.parent


def files(spark):
    return sorted(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("grovewise-*"))


def test_scope_leaves_nothing(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a long, b long")
    before = files(spark)
    with storage.scope():
        found = graph.components(edges)
        assert len(files(spark)) > len(before)
        assert {r["v"]: r["component"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert files(spark) == before


def test_drop_and_close(spark):
    scratch = storage.Scratch(spark)
    a, b = scratch.keep(spark.range(3)), scratch.keep(spark.range(4))
    scratch.drop(a)
    assert b.count() == 4 and len(list(Path(scratch.root.removeprefix("file://")).iterdir())) == 1
    scratch.close()
    assert not Path(scratch.root.removeprefix("file://")).exists()


def test_application_leaves_nothing_and_clusters_need_a_folder(tmp_path):
    code = f"""
import sys, pathlib
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from grovewise import storage
spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
try:
    at = storage.Scratch(spark)
    at.keep(spark.range(2))
    assert spark.conf.get("spark.checkpoint.dir", None) is None
    print("FOLDER", at.root, pathlib.Path(at.root.removeprefix("file://")).exists())
except RuntimeError as e:
    print("REFUSED", e)
spark.stop()
"""
    run = lambda master: subprocess.run([sys.executable, "-c", code, master], capture_output=True, text=True, timeout=200, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}).stdout
    said = run("local[1]").split()
    assert said[0] == "FOLDER" and said[2] == "True" and not Path(said[1].removeprefix("file://")).parent.exists()
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(RuntimeError):
            storage.shared_dir(unset)


def test_tasks_find_the_package(spark):
    storage.ship_package(spark)
    storage.ship_package(spark)

    def where(batches):
        import grovewise.functions.ids as ids

        for batch in batches:
            yield batch.assign(at=len(ids.BLANKS))

    assert spark.range(1).mapInPandas(where, "id long, at long").first()["at"] > 5
