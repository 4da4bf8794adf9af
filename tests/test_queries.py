"""Every query of guarded frames against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registry
from cloister.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat().replace("+00:00", "") if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert rows == sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in found.fetchall())


def test_registry(spark):
    assert registry.entry(spark).count() == 3
    assert set(QUERIES) <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_sorted_lists_keep_the_order_of_ties(spark):
    """Rows that are equal in what a group's list is sorted by keep the frame's order, in reverse too."""
    from cloister.functions.expr import col
    from cloister.policy import Policy, TrueRule
    from cloister.session import GuardSession

    rows = spark.createDataFrame([(i, i // 2 % 3, f"{9 - i}") for i in range(9)], "i long, v long, name string")
    frame = GuardSession(spark).send_df(rows, Policy(TrueRule()), order_by=("i",))
    for reverse in (False, True):
        got = frame.groupby(col("i") * 0).agg(col("name").sort_by(col("v"), reverse=reverse).alias("s")).df.first()["s"]
        assert got == [f"{9 - i}" for i in sorted(range(9), key=lambda i: i // 2 % 3, reverse=reverse)]


def test_doubles_round_as_in_sql(spark):
    """Halves of the product in double precision go away from zero, and a negative number that rounds to zero stays negative."""
    from pyspark.sql import functions as F

    from cloister.functions.expr import round_double

    values = [-1e-9, -0.0, 0.0, 1.0000005, 2.0000015, -2.0000025, 0.0078125, 1e300, -3e15 - 0.5, float("inf"), float("nan"), 0.1234565]
    got = [str(r[0]) for r in spark.createDataFrame([(v,) for v in values], "v double").select(round_double(F.col("v"), 6)).collect()]
    want = [str(duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0]) for v in values]
    assert got == want and got[0] == "-0.0"
