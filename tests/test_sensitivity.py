"""Bounds of column expressions, and reviews that wait in a store."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloister.operators.privacy import BudgetExceeded, PrivacyContext, sigma
from cloister.operators.sensitivity import Bounded, PrivateTable
from cloister.policy import Action, Aggregation, Policy
from cloister.session import GuardSession, RequestRejected, ReviewPending


@settings(max_examples=100, deadline=None)
@given(*[st.integers(-9, 9)] * 4, st.floats(0, 1), st.floats(0, 1))
def test_intervals_hold_what_they_say(spark, a, b, c, d, u, v):
    x, y = (Bounded(F.lit(0.0), float(min(p, q)), float(max(p, q))) for p, q in ((a, b), (c, d)))
    p, q = x.low + u * (x.high - x.low), y.low + v * (y.high - y.low)
    for found, value in ((x + y, p + q), (x - y, p - q), (x * y, p * q), (x * -2, -2 * p), (x / 4, p / 4), (x.abs(), abs(p)), (2 + x, 2 + p), (x.clamp(-1, 3), min(max(p, -1), 3))):
        assert found.low - 1e-9 <= value <= found.high + 1e-9


def table(spark, limit=10.0, rows=None):
    rows = rows or [(i % 3, float(i % 7) if i % 11 else math.nan, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, x double, u int")
    return PrivateTable.of(df, PrivacyContext(limit, len(rows)))


def test_bounds_of_sums(spark):
    t = table(spark)
    x = t.col("x").clamp(-1, 4)
    total = t.sum(x)
    a, b = t.split(F.col("u") == 1)
    a1, a2 = a.split(F.col("g") == 0)
    assert total.bound == 4 and (total * -2).bound == 8 and (total + 5).bound == 4 and (total + total).bound == 8
    assert (a.sum(x) - b.sum(x)).bound == 4 and (a.sum(x) + total).bound == 8 and (a1.sum(x) + a2.sum(x) + b.sum(x)).bound == 4
    assert (a1.sum(x) + a.sum(x)).bound == 8 and total.clamp(0, 3).bound == 3 and t.count().bound == 1 and (total / 2).bound == 2
    assert t.sum(t.col("x")).bound is None and (t.sum(t.col("x")) + total).bound is None and t.sum(t.col("x")).clamp(0, 2).bound == 2
    other, _ = t.split(F.col("g") == 1)
    assert (other.sum(x) + a.sum(x)).bound == 8  # two splits of the same table may overlap


def test_release(spark):
    t = table(spark)
    with pytest.raises(ValueError, match="raw is not known"):
        t.release(1.0, ["g"], raw=t.sum(t.col("x")), n=t.count())
    with pytest.raises(ValueError):
        t.release(1.0, ["g"])
    assert t.context.spent == 0
    x = t.col("x").clamp(0, 3)
    keys = spark.createDataFrame([(0,), (7,), (None,)], "g int")
    found = {r["g"]: r for r in t.release(4.0, ["g"], keys, s=t.sum(x), n=t.count() + 100).collect()}
    assert set(found) == {0, 7, None} and t.context.spent == 4.0
    std = sigma(4.0, t.context.delta, 3 * math.sqrt(2))
    assert all(r["s_sigma"] == pytest.approx(std) and r["n_sigma"] == pytest.approx(std / 3) for r in found.values())
    exact = sum(min(i % 7, 3) for i in range(0, 300, 3) if i % 11)
    assert 0 < abs(found[0]["s"] - exact) < 10 * std and abs(found[7]["n"] - 100) < 10 * std and 0 < abs(found[None]["s"]) < 10 * std
    with pytest.raises(BudgetExceeded):
        t.release(6.0, ["g"], n=t.count())
    whole = t.release(5.0, where_few=t.where(F.col("g") > 5).count()).first()
    assert abs(whole["where_few"]) < 10 * whole["where_few_sigma"]
    for ends in ((1, 0), (0, math.inf)):
        with pytest.raises(ValueError):
            t.col("x").clamp(*ends)


def test_units_have_few_rows(spark):
    df = spark.createDataFrame([(i % 5 if i < 100 else i, 1.0) for i in range(150)], "unit int, x double").repartition(4)
    t = PrivateTable.of(df, PrivacyContext(1e9, 55), "unit", 3)
    assert {r["unit"]: r["count"] for r in t.df.groupBy("unit").count().collect()} == {i: 3 if i < 5 else 1 for i in [*range(5), *range(100, 150)]}
    assert t.df.columns == ["unit", "x"] and t.sum(t.col("x").clamp(0, 2)).bound == 6


def test_reviews_wait_for_an_answer(spark, tmp_path):
    folder = f"file://{tmp_path}/reviews"
    ann = GuardSession(spark, user="ann", reviews=folder)
    df = ann.send_df(spark.range(20), Policy(Aggregation(10), Action.REVIEW))
    first, second = df.collect(), df.limit(3).collect()
    for _ in range(2):
        with pytest.raises(ReviewPending):
            ann.release(first.identifier)
    assert second.fetch() is None and ann.fetch(second.identifier, timeout=0.3, delay=0.1) is None
    owner, guest = GuardSession(spark, user="olga", reviews=folder), GuardSession(spark, user="eve", is_owner=False, reviews=folder)
    assert [r["name"] for r in owner.review_queue.requests()] == [first.identifier, second.identifier]
    request = owner.review_queue.read(first.identifier)
    assert request["user"] == "ann" and "scan" in request["query"] and "at least 10" in request["reason"]
    with pytest.raises(RequestRejected):
        guest.answer(first.identifier, True)
    owner.answer(first.identifier, True)
    owner.answer(second.identifier, False, "too fine")
    with pytest.raises(ValueError, match="answered"):
        owner.answer(second.identifier, True)
    with pytest.raises(KeyError):
        owner.answer("none", True)
    assert first.fetch().count() == 20 and second.fetch() is None
    with pytest.raises(RequestRejected):
        ann.release(second.identifier)
    table = {r["name"]: (r["state"], r["by"], r["note"]) for r in owner.review_queue.table().collect()}
    assert table == {first.identifier: ("allowed", "olga", ""), second.identifier: ("denied", "olga", "too fine")}
    assert [e["event"] for e in ann.events if e["event"].startswith("review")] == ["review asked", "review asked", "review", "review", "review"]
    with pytest.raises(ValueError):
        GuardSession(spark).answer("x", True)
