"""The driver's contract: names, schemas, and results against the reference SQL at the smallest size."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from palaver.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def test_registration():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalog.QUERIES) <= set(queries) and len(catalog.ORACLES) > 60


def without(tmp_path, code, *ignored):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(os.path.join(root, "palaver"), tmp_path / "palaver", ignore=shutil.ignore_patterns("__pycache__", *ignored))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    names = subprocess.run([sys.executable, "-c", f"{code}\nimport __spark_entry__ as e\nprint(*e.queries(), *e.oracle_sql())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert "speaker_stats" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]


def test_entry_without_training_data_operators(tmp_path):
    without(tmp_path, "", "llm")


def test_entry_without_tokenizer_files(tmp_path):
    without(tmp_path, "import sys\nsys.modules['public_tokenizers'] = None")


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["call_id", "speaker", "segments", "words"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLES:
        relation = oracle.sql(catalog.ORACLES[name])
        assert sorted(relation.columns) == columns
        order = [relation.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
