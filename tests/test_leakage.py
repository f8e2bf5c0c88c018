"""Leakage in a session of its own: the fault depended on the ids of a session's first columns."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
from pyspark.sql import SparkSession
from quillstone import queries
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
print("found", sorted(map(tuple, queries.leakage_check(spark, sys.argv[1]).collect())))
"""


def test_first_query_of_a_session(spark, tmp_path):
    rows = [(1, "a License of web", "en", "web", 16), (2, "plain", "xx", "web", 5), (3, None, "en", "web", 0), (4, "xx xx", "xx", "web", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    #: a process of its own, without the settings of the session around it
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_")) or k == "SPARK_HOME"} | {"PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])}
    out = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], capture_output=True, text=True, timeout=120, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.splitlines()[-1] == "found [(1, 'text', 3), (4, 'text', 1)]"
