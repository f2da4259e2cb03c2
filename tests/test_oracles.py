"""Every query that has SQL gives the SQL's rows on the small tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple("" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(SQL) & set(QUERIES)))
def test_query_equals_sql(spark, duck, name):
    got, want = _rows(QUERIES[name](spark, SF).toPandas()), _rows(duck.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
