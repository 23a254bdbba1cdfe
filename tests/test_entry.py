"""The entry and the core without the optional training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert "flagship" in e.queries() and not any(k == "pipeline" or k[:2] == "op" and k[2:3].isdigit() for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
print("ROWS", e.entry(spark).count())
"""


@pytest.mark.parametrize("gone", [["millrace/llm", "tests/llm"], ["millrace/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_training_data_operators(tmp_path, gone):
    for name in ("millrace", "__spark_entry__.py", "corpus_pipeline.py"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "ROWS 6" in done.stdout, done.stderr[-2000:]
