import duckdb
import pytest

from lotlens.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=repr)
