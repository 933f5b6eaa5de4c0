"""The entry module: names agree, and all queries equal their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from talentgrid import bindings

D = "/root/testdata/sf0.001"
def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(bindings.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    got = entry.queries()[name](spark, D)
    ran = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in ran.description]
    key = lambda r: [str(round(v, 4) if isinstance(v, float) else v) for v in r]
    assert sorted(key(r) for r in got.select(*order).collect()) == sorted(key(r) for r in ran.fetchall())
