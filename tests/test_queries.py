"""Queries against their SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

from tabseg.plans import catalog
from tests.conftest import DATA, ROOT

duckdb = pytest.importorskip("duckdb")


def normal(rows):
    return sorted(tuple("null" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in sorted((DATA / "sf0.001").glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    got = catalog.queries()[name](spark, str(DATA / "sf0.001"))
    want = sql.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert normal(tuple(r) for r in got.select(*cols).collect()) == normal([r[i] for i in at] for r in want.fetchall())


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_runs_without_the_optional_package(tmp_path):
    """The entry point loads in a copy of the repository from which the optional package is deleted, with all queries of the core."""
    shutil.copytree(ROOT / "tabseg", tmp_path / "tabseg", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]
