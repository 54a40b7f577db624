"""The shared folder under sessions of several kinds."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tickloom.session import shared_folder


def session(master, checkpoint=None, of_context=None):
    held = {"spark.sql.warehouse.dir": "hdfs://store/tables"} | ({"spark.checkpoint.dir": checkpoint} if checkpoint else {})
    hadoop = SimpleNamespace(hadoopConfiguration=lambda: {"fs.defaultFS": "file:///"})
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: of_context, _jsc=hadoop)
    return SimpleNamespace(conf=SimpleNamespace(get=held.get, set=held.__setitem__), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,2,1024]", "local[4]"])
def test_a_named_folder_is_taken(master):
    assert shared_folder(session(master, "/shared/kept")) == "/shared/kept"
    assert shared_folder(session(master, None, "hdfs://store/kept")) == "hdfs://store/kept"


def test_without_a_folder():
    for master in ("spark://host:7077", "local-cluster[2,2,1024]"):
        assert shared_folder(session(master)) == "hdfs://store/tables/_tickloom"
    here = session("local[4]")
    assert shared_folder(here).startswith("file:///") and shared_folder(here) == shared_folder(here)


RUN = """
from pyspark.sql import SparkSession
from tickloom.session import cut_lineage, drop_scratch, materialise, shared_folder
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = shared_folder(spark)
assert materialise(spark.range(7), "seven").count() == 7 and cut_lineage(spark.range(5)).count() == 5
assert shared_folder(spark) == folder
drop_scratch(spark)
"""


def test_a_real_session_without_a_folder(tmp_path):
    """Spark refuses to set spark.checkpoint.dir in a running session: CANNOT_MODIFY_CONFIG."""
    home = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": home, "TMPDIR": str(tmp_path)}
    env = {k: v for k, v in env.items() if k != "PYSPARK_GATEWAY_PORT" and k != "PYSPARK_GATEWAY_SECRET"}
    done = subprocess.run([sys.executable, "-c", RUN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
