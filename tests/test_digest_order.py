"""The digest's lines keep their order when sorts spill, which only an application of its own can be made to do."""

import os
import subprocess
import sys

SCRIPT = """
import glob, sys
from datetime import date
from pyspark.sql import SparkSession, functions as F
from newsloom.operators import feed
out = sys.argv[1]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.shuffle.spill.numElementsForceSpillThreshold", "40").config("spark.checkpoint.dir", out + "/checkpoint").config("spark.local.dir", out + "/local").getOrCreate()
text = F.concat(F.lit("s"), F.col("id").cast("string"), F.lit("\\nb"))
digest = spark.range(300).select(F.col("id").alias("story_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), text.alias("text"))
feed.write_digest(digest, date(2024, 1, 1), out + "/digest", 2)
lines = [x for f in sorted(glob.glob(out + "/digest/day=2024-01-01/part-*")) for x in open(f, encoding="utf-8").read().splitlines()]
assert lines[2:] == [x for i in range(300) for x in (f"s{i}", "b")], lines[:12]
"""


def test_lines_keep_their_order_when_sorts_spill(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
