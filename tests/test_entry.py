"""The registry against DuckDB on the smallest tables, and the entry point."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__
from tensorloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, int, decimal.Decimal)):
        return repr(float(v) + 0.0)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in got]) == _rows(names, want.fetchall())


def test_every_name_with_sql_is_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert __spark_entry__.entry(spark).count() == 5 * asked


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
