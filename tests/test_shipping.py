"""Python steps find the package wherever the workers run."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

from conftest import SF

REPO = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert __spark_entry__.queries()["r12_detected_ranges"](spark, sys.argv[2]).count() >= 0
print("done")
"""


def test_python_steps_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT, str(REPO), SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("done"), got.stderr[-2000:]
