"""Every registered query against its SQL."""

import duckdb
import pytest

from check import TABLES, normal
from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, duck, sf_dir):
    got = queries()[name](spark, sf_dir).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0 or name == "sample_rows"
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
    # in the smallest tables no symbol has 60 test rows
    assert len(got) > 0 or name in ("sample_rows", "sequence_classifier")


def test_entry(spark):
    assert entry(spark).count() > 0
