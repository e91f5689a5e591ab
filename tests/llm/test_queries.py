import pytest

from tabseg.llm import catalog
from tests.conftest import DATA
from tests.test_queries import normal

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_odd_tables(spark, edges, kind, name):
    n = catalog.queries()[name](spark, edges[kind]).count()
    if kind == "empty" and name not in ("p8_found", "p8_shares"):  # these have a row per target
        assert n == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in sorted((DATA / "sf0.001").glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = catalog.queries()[name](spark, str(DATA / "sf0.001"))
    want = con.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    assert normal(tuple(r) for r in got.select(*cols).collect()) == normal([r[i] for i in at] for r in want.fetchall())
