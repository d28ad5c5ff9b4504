"""Workers that have no copy of the package get it from the driver."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver alone
from pyspark.sql import SparkSession
from concord import session
from concord.operators import stage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
session.ship(spark)
session.ship(spark)

def name_of(batches):
    from concord.operators import ledger
    for b in batches:
        yield b.assign(v=ledger.__name__)

print(spark.range(1).mapInPandas(name_of, "id long, v string").first().v)
"""


def test_package_is_sent_to_workers(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert run.stdout.strip().endswith("concord.operators.ledger"), run.stderr[-2000:]
