"""Every query that has a SQL twin equals it on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from docketry.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert canonical(map(tuple, rows)) == canonical(duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
