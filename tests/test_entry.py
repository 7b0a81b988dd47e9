"""The entry module, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
queries = entry.queries()
assert "pipeline" not in queries and not any(n.startswith("op1_") for n in queries)
assert set(entry.oracle_sql()) <= set(queries)
assert queries["size_estimate"](spark, SF).count() > 0
"""


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_corpus_subpackage(tmp_path, sf_dir, with_pipeline):
    shutil.copytree(os.path.join(ROOT, "reelspark"), tmp_path / "reelspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] * with_pipeline)):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.replace("SF", repr(sf_dir))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
