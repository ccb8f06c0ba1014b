"""Every query of the catalogue against its SQL in DuckDB."""

import os
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from kairoframe.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    if isinstance(x, Decimal):
        return float(x)
    return x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(v[i]) for i in order) for v in values], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry_points_work_without_optional_parts(tmp_path):
    """In a copy in which the optional folders are really deleted, with and without corpus_pipeline.py."""
    root = Path(__file__).resolve().parent.parent
    ignored = shutil.ignore_patterns("llm", "tests", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=ignored)
    assert not list((tmp_path / "copy").rglob("llm"))
    code = (
        "import __spark_entry__ as e, kairoframe.plans.catalogue as c, kairoframe.streaming.live, kairoframe.sources.sinks;"
        "assert set(e.queries()) == set(c.QUERIES), set(e.queries()) ^ set(c.QUERIES); assert set(e.oracle_sql()) == set(c.ORACLES)"
    )
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
