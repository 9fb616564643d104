import duckdb
import pytest

from ledgerline import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    got = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for table in ("orders", "events", "customer", "part", "supplier", "documents", "nation", "conversations", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(d[0] for d in want.description) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
