"""The entry points: names, columns, and that the rest stands without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TINY = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no tables")
def test_flagship(spark):
    rows = {(r["path"], r["code"]): r["n"] for r in entry.entry(spark).collect()}
    assert rows[("l_orderkey", "rel_unresolved")] == 0 and rows[("l_quantity", "constraint")] > 0


def test_without_corpus_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "concord"), tmp_path / "concord", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
