"""The library imports and lists its queries where the corpus operators are absent."""

import os
import shutil
import subprocess
import sys

import pytest

from shoebox.plans.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_corpus_operators(tmp_path, pipeline):
    if pipeline:  # left behind
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    shutil.copytree(f"{ROOT}/shoebox", tmp_path / "shoebox", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "shoebox" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave behind
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[:2] == ["True", str(len(QUERIES))], out.stderr[-500:]
