"""Queries run from a folder that isn't the repository's: workers find what they need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from jobsift.plans.queries import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("asked_titles", "asked_checks", "wordpiece_ids", "token_ids"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_workers_need_not_have_the_package(tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN, str(Path(__file__).parent.parent)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == "asked_titles True asked_checks True wordpiece_ids True token_ids True".split(), done.stderr[-2000:]
