import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


def shown(v):
    return "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_duckdb(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(small, t)}.parquet'")
    got, want = entry.queries()[name](spark, small).toPandas(), db.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(shown, r)) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_partitions_make_no_difference(spark, small):
    query = entry.queries()["ray_trace"]
    want = sorted(map(tuple, query(spark, small).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(tuple, query(spark, small).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
