"""The entry works without the optional package, and the package ships to workers that start elsewhere."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_package(tmp_path):
    shutil.copytree(os.path.join(ROOT, "paddock"), tmp_path / "paddock", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as E; q = E.queries(); print(len(q) >= 55, 'pipeline' in q, set(E.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False", "True"], out.stderr[-500:]


def test_workers_get_the_package(tmp_path):
    """A session started in another folder, without the repository on the workers' path."""
    code = f"""
import sys
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r})
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
sys.path.insert(0, {ROOT!r})
from paddock.operators.fuzzy import name_pairs
sales = spark.createDataFrame([(1, 1, "Spring Sale", "2000-01-01"), (2, 1, "Spring Sales", "1999-01-01")],
    "sale_id long, company_id long, sale_name string, start_date string").selectExpr(
    "*", "cast(start_date as date) as end_date", "1L as sale_type_id").withColumn("start_date", F.col("start_date").cast("date"))
print("pairs", name_pairs(sales, 1, 1).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "pairs 1" in out.stdout, out.stderr[-800:]
