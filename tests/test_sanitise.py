"""Sensitive columns stay null in what is fetched, under whatever name and through whatever operator."""

import pytest

from cloister.functions.expr import all_columns, coalesce, col, count, lit, when
from cloister.plans.sql import sql
from cloister.policy import Policy, TrueRule
from cloister.session import GuardSession, RequestRejected

ROWS = [(1, "ann", 5.0, "x"), (2, "bob", 7.0, "x"), (3, "cid", 9.0, "y")]


@pytest.fixture
def frame(spark):
    session = GuardSession(spark)
    df = spark.createDataFrame(ROWS, "id long, name string, pay double, team string")
    return session.send_df(df, Policy(TrueRule()), ("name", "pay"), order_by=("id",))


def _leaks(frame) -> set[str]:
    """Columns of the fetched rows that hold a sensitive value, or part of one."""
    secret = {"ann", "bob", "cid", "ANN", "BOB", "CID", 5.0, 7.0, 9.0}
    flat = lambda v: {y for x in v for y in flat(x)} if isinstance(v, (list, tuple)) else {v}
    return {c for r in frame.fetch().collect() for c, v in r.asDict(recursive=False).items() if flat([v]) & secret}


n, p = col("name"), col("pay")
SHOWING = [
    n.max(), n.min(), n.first(), n.last(), n.mode(), n.list(), n.head(2), n.sort_by(p), p.quantile(0.5), p.median(), p.max() + 0, n.max().str.to_uppercase(), p.max() - p.min() + p.min(),
    n.filter(col("id") == 2).first(), when(col("id") == 1).then(n).otherwise("z").max(), coalesce(n, "team").max(), n.str.concat("-"), p.product(),
]


@pytest.mark.parametrize("i", range(len(SHOWING)))
def test_aggregates(frame, i):
    assert _leaks(frame.groupby("team").agg(SHOWING[i].alias("m"))) == set()
    if not SHOWING[i].listed:
        assert _leaks(frame.select(SHOWING[i].alias("m"))) == set()


def test_summaries_are_released(frame):
    row = frame.select(n.count().alias("n"), n.n_unique().alias("u"), p.sum().alias("s"), p.mean().alias("m")).fetch().first()
    assert tuple(row) == (3, 3, 21.0, 7.0)
    assert frame.select(p.sum()).fetch().first()[0] is None  # by its name


def test_order_and_windows(frame):
    by_pay = frame.order_by("pay")
    assert _leaks(by_pay.select(col("id").arg_max().alias("m"))) == set()
    for e in (p.mean().over("id"), p.shift(1), p.cumsum().over("id"), p.rolling_max(2, 1), p.rank(), n.forward_fill(), p.sum().over("id") * 1):
        out = frame.select("id", e.alias("m"))
        assert out.fetch().where("m is not null").count() == 0, e


def test_operators(frame, spark):
    session = frame.session
    other = session.send_df(spark.createDataFrame([("ann", 1), ("zed", 2)], "who string, k int"), Policy(TrueRule()))
    assert _leaks(frame.with_columns(n.alias("a")).rename({"a": "b"})) == set()
    assert _leaks(frame.groupby("team").agg(n.max().alias("m")).join(frame.select("team"), on="team")) == set()
    assert _leaks(frame.select(n.max().alias("m"), p.max().alias("q")).melt("m", "q")) == set()
    assert _leaks(other.join(frame, left_on="who", right_on="name", how="outer")) == set()
    from cloister.functions.expr import struct

    assert _leaks(frame.select(struct("name", "id").alias("s")).unnest("s")) == set()
    assert _leaks(frame.groupby(n.alias("k")).agg(count().alias("n"))) == set()
    assert _leaks(frame.select(all_columns().max().suffix("_max"))) == set()
    assert _leaks(frame.select(lit("ok").alias("name"))) == set()
    for plot in (frame.boxplot("pay"), frame.barplot("team", "pay", estimator="max"), frame.histplot("pay", bins=1), frame.pieplot("pay", "name")):
        assert _leaks(plot) == set()
    for reject in (lambda: frame.partition_by("name"), lambda: frame.to_dummies("name")):
        with pytest.raises(RequestRejected):
            reject()


def test_rolling_and_dynamic(spark):
    session = GuardSession(spark)
    df = spark.sql("SELECT timestamp'2024-01-01' + make_dt_interval(id) AS ts, 'ann' AS name FROM range(4)")
    f = session.send_df(df, Policy(TrueRule()), ("name",))
    assert _leaks(f.groupby_rolling("ts", "2d").agg(n.max().alias("m"))) == set()
    assert _leaks(f.groupby_dynamic("ts", "2d").agg(n.min().alias("m"))) == set()


@pytest.mark.parametrize(
    "text",
    [
        "SELECT max(name) AS m FROM {}",
        "SELECT upper(min(name)) AS m, team FROM {} GROUP BY team",
        "SELECT name AS m FROM {}",
        "WITH a AS (SELECT name AS q FROM {}) SELECT q AS m FROM a",
        "SELECT (SELECT max(name) FROM {}) AS m",
        "SELECT team AS m FROM {} UNION ALL SELECT name FROM {}",
        "SELECT first_value(name) OVER (ORDER BY id) AS m FROM {}",
        "SELECT sum(pay) OVER (PARTITION BY id) AS m FROM {}",
        "SELECT explode(collect_list(name)) AS m FROM {}",
        "SELECT m FROM {} LATERAL VIEW explode(array(name)) t AS m",
        "SELECT x.m FROM (SELECT team, max_by(name, pay) AS m FROM {} GROUP BY team) x",
        "SELECT team, name AS m, count(*) FROM {} GROUP BY ROLLUP (team, name)",
        "SELECT CASE WHEN id IN (SELECT id FROM {}) THEN name END AS m FROM {}",
    ],
)
def test_sql(frame, text):
    assert _leaks(sql(text, *[frame] * text.count("{}"))) == set()
    renamed = frame.rename({"name": "nm", "pay": "py"})
    again = text.replace("name", "nm").replace("pay", "py")
    assert _leaks(sql(again, *[renamed] * again.count("{}"))) == set()


def test_sql_summaries_are_released(frame):
    row = sql("SELECT count(name) AS n, sum(pay) AS s FROM {}", frame).fetch().first()
    assert tuple(row) == (3, 21.0)


def test_counts_over_windows_show_no_value(spark):
    from cloister.plans.sql import sql

    f = GuardSession(spark).send_df(spark.createDataFrame([("a", 1), ("b", 1), (None, 2)], "name string, k int"), Policy(TrueRule()), sanitized_columns=("name",))
    got = sql("SELECT k, count(name) OVER (PARTITION BY k) AS n, max(name) OVER (PARTITION BY k) AS m, count(k) OVER (PARTITION BY name) AS p FROM {}", f).fetch().collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(1, 2), (1, 2), (2, 0)] and {(r["m"], r["p"]) for r in got} == {(None, None)}
