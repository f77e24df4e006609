"""The registration works without the parts that may be taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
CODE = """
import json, __spark_entry__ as entry
from frostgrid.plans import ORACLE_SQL, QUERIES
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL), sorted(entry.queries())
import tests.test_oracle
"""


@pytest.mark.parametrize("gone", [("frostgrid/llm", "tests/llm"), ("frostgrid/llm", "tests/llm", "corpus_pipeline.py")])
def test_import_without_training_data_operators(tmp_path, gone):
    away = {str(ROOT / g) for g in gone}

    def left_out(folder, names):
        return [n for n in names if n.startswith(".git") or n == "__pycache__" or f"{folder}/{n}" in away]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", check=True, timeout=120)


def test_an_error_inside_is_not_taken_for_a_missing_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git*", "__pycache__"))
    broken = tmp_path / "copy/frostgrid/llm/common.py"
    broken.write_text("import a_module_that_does_not_exist\n" + broken.read_text().replace("from __future__ import annotations", ""))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "copy", capture_output=True, timeout=120)
    assert done.returncode and b"a_module_that_does_not_exist" in done.stderr
