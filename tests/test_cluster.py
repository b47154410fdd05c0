"""Queries on executors that are processes of their own."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parents[1]
PROGRAM = """
import sys
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "512m").getOrCreate()
for _ in range(2):
    print("ROWS", sorted(map(tuple, e.queries()["jdbc_fetch"](spark, sys.argv[1]).collect())))
spark.stop()
"""


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_a_database_is_read_by_executors_of_their_own(spark, tmp_path) -> None:
    (tmp_path / "home/work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # logs of executors go to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": str(REPO), "SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS")}
    out = subprocess.run([sys.executable, "-c", PROGRAM, str(DATA)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    want = sorted(map(tuple, spark.read.parquet(f"{DATA}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()))
    assert [line for line in out.stdout.splitlines() if "ROWS" in line] == [f"ROWS {want}"] * 2, out.stderr[-2000:]
