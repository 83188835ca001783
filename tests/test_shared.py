"""Storage that driver and executors share, in sessions that name a folder and in those that don't."""

import os
import subprocess
import sys
from pathlib import Path

from shardloom import shared

CODE = """
import sys
from pyspark.sql import SparkSession
from shardloom import shared
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1]).getOrCreate()
df = shared.materialize(spark.range(7))
assert df.count() == 7 and all(f.startswith(sys.argv[1]) for f in df.inputFiles()), df.inputFiles()
assert spark.conf.get("spark.checkpoint.dir", None) is None
shared.release()
"""


def test_a_session_without_a_checkpoint_folder_uses_its_warehouse(tmp_path):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(Path(__file__).parent.parent)}
    done = subprocess.run([sys.executable, "-c", CODE, f"file://{tmp_path}/warehouse"], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not list((tmp_path / "warehouse").glob("shardloom-*"))


def test_folders_are_below_the_checkpoint_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    df = shared.materialize(spark.range(3))
    assert all(f.startswith(base.replace("file://", "file:")) or f.startswith(base) for f in df.inputFiles())


def test_scratch_goes_before_the_end(spark):
    before = shared.materialize(spark.range(1))
    mark = shared.marked()
    first, last = shared.materialize(spark.range(2)), shared.materialize(spark.range(3))
    gone = [f.removeprefix("file://") for f in first.inputFiles()]
    shared.release_since(mark)
    assert not any(os.path.exists(f) for f in gone) and last.count() == 3 and before.count() == 1


CLUSTER = """
import sys
from pyspark.sql import SparkSession
from shardloom import shared
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1]).getOrCreate()
class Context:
    master = "spark://host:7077"
type(spark).sparkContext = property(lambda self: Context)
try:
    shared.shared_folder(spark)
except RuntimeError as e:
    assert "spark.checkpoint.dir" in str(e)
else:
    raise SystemExit("a local folder was taken")
"""


def test_a_cluster_needs_a_shared_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(Path(__file__).parent.parent)}
    done = subprocess.run([sys.executable, "-c", CLUSTER, f"file://{tmp_path}/warehouse"], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
