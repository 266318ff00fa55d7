"""A session started outside the repository must still run the Python-side
operators (the package is shipped to the workers with addPyFile)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as se
print("ROWS", se.entry(spark).count(), se.queries()["p1_text_topk"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_entry_runs_from_another_directory():
    workdir = tempfile.mkdtemp(prefix="pairlab-elsewhere-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=workdir, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    rows = [int(x) for x in out.stdout.split("ROWS")[1].split()[:2]]
    assert rows[0] > 0 and rows[1] > 0
