"""Pandas UDFs must run when the package is importable on the driver only
(driver started elsewhere, package added to sys.path at run time)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
n = E.queries()["anova_pvalues"](spark, "/root/testdata/sf0.001").where("p_unc IS NOT NULL").count()
print("ROWS", n)
spark.stop()
"""


def test_udf_runs_without_installed_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 9" in out.stdout, out.stderr[-2000:]
