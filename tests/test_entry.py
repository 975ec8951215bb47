"""The driver's contract: every query of the library, against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 4) if isinstance(x, float) else str(x)

    return sorted(([value(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = canonical(columns, found.fetchall())
    assert canonical(df.columns, df.collect()) == expected and expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registers():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(catalogue.QUERIES) <= set(queries) and set(sql) <= set(queries)


def test_workers_started_elsewhere_find_the_package(spark):
    entry.entry(spark)
    assert os.path.dirname(os.path.abspath(entry.__file__)) in spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)
