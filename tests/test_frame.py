import math
import random

import numpy as np
import pytest

from cloister.functions.expr import all_columns, col, count, java_pattern, lit, when
from cloister.functions.udf import ApplyAbs, ApplyBins
from cloister.operators import ordered
from cloister.plans.sql import sql
from cloister.policy import Action, Aggregation, Policy, Stats, TrueRule
from cloister.session import GuardSession, NotFound, RequestRejected, UnsupportedOperation

OPEN = Policy(TrueRule())


@pytest.fixture()
def session(spark):
    return GuardSession(spark)


def send(session, rows, schema, policy=OPEN, sanitized=(), order=()):
    return session.send_df(session.spark.createDataFrame(rows, schema), policy, sanitized, order_by=order)


def rows(frame):
    return [tuple(r) for r in (frame.df if hasattr(frame, "provenance") else frame).collect()]


def nums(session, order=("i",)):
    return send(session, [(0, "a", 3.0), (1, "b", None), (2, "a", 5.0), (3, "b", 1.0), (4, None, 2.0)], "i long, k string, v double", order=order)


def test_round_trip_of_types(session):
    for data, schema in (
        ([([1],), ([2],)], "a array<long>"), ([("b",), ("a",)], "a string"), ([(["b"],), (["a"],)], "a array<string>"), ([(1,), (2,), (4,)], "a long"),
        ([(None,)], "a int"), ([("x", ["b"], [1], 7)], "a string, b array<string>, d array<long>, e long"),
    ):
        f = send(session, data, schema).select(all_columns())
        assert sorted(map(str, rows(f.fetch()))) == sorted(map(str, data))


def test_sources_are_never_released(session):
    f = nums(session)
    assert f.fetch() is None
    with pytest.raises(RequestRejected):
        session.release(f.identifier)
    assert f.select("i").fetch() is not None


@pytest.mark.parametrize("action", list(Action))
def test_fetch_gate(session, action):
    asked = []
    session.reviewer = lambda request: asked.append(request) or request.query.count("limit") == 0
    f = send(session, [(i % 3, i) for i in range(30)], "k int, v int", Policy(Aggregation(10), action))
    safe = f.groupby("k").agg(col("v").mean().alias("m"))
    assert len(rows(safe.fetch())) == 3 and not asked
    unsafe = f.groupby("v").agg(col("k").mean())
    got = unsafe.fetch()
    assert (got is None) is (action is Action.REJECT)
    assert len(asked) == (action is Action.REVIEW)
    denied = f.limit(3).fetch()
    assert (denied is None) is (action is not Action.LOG)
    assert any(e["event"] in ("warning", "review", "reject") for e in session.events)


def test_review_denies_by_default(spark):
    f = send(GuardSession(spark), [(1,)], "a int", Policy(Aggregation(10), Action.REVIEW))
    assert f.select("a").fetch() is None


def test_global_aggregates_stand_for_their_rows(session):
    f = send(session, [(1,)], "a int", Policy(Aggregation(10), Action.REJECT))
    assert f.select(col("a").sum()).fetch() is None and f.sum().fetch() is None and f.describe().fetch() is None and f.boxplot(y="a").fetch() is None
    session.strict = False  # the compatible mode
    assert f.select(col("a").sum()).fetch() is not None
    nested = f.select(col("a").sum()).select(col("a").sum())
    assert list(nested.provenance().values()) == [Stats(math.inf, 1)]


def test_values_of_single_rows_are_no_aggregates(session):
    f = send(session, [(i, i % 2) for i in range(40)], "a int, k int", Policy(Aggregation(10), Action.REJECT)).order_by("a")
    g, a = f.groupby("k"), col("a")
    for e in (a.list(), a.first(), a.last() * 2, a.mean() + a.first(), a.arg_max(), a.sort_by(a), a.head(2), a.take([0]), when(a.count() > 1).then(a.first()).otherwise(lit(0))):
        assert g.agg(e.alias("x")).fetch() is None and (e.listed or f.select(e.alias("x")).fetch() is None)
    for e in (a.mean(), a.min(), a.median(), a.count(), a.sum() / a.count()):
        assert g.agg(e.alias("x")).fetch() is not None and f.select(e.alias("x")).fetch() is not None
    for name in ("first(a)", "max_by(a, k)", "collect_list(a)", "sum(a) + any_value(a)", "size(collect_set(a))"):
        assert sql(f"SELECT k, {name} AS x FROM {{}} GROUP BY k", f).fetch() is None and sql(f"SELECT {name} AS x FROM {{}}", f).fetch() is None
    assert sql("SELECT k, sum(a) AS x FROM {} GROUP BY k", f).fetch() is not None
    assert send(session, [("x", i) for i in range(12)], "s string, k int", Policy(Aggregation(10), Action.REJECT)).order_by("k").select(col("s").str.concat()).fetch() is None
    session.strict = False
    assert g.agg(a.list().alias("x")).fetch() is not None


def test_aggregated_expressions():
    assert (col("a").sum() / count() + 1).aggregated and lit(1).aggregated
    assert not (col("a").sum() + col("b")).aggregated
    assert not when(col("a") > 0).then(lit(1)).otherwise(lit(2)).aggregated
    assert when(col("a").sum() > 0).then(lit(1)).otherwise(col("b").max()).aggregated
    assert col("a").filter(col("b") > 1).sum().aggregated and not col("a").filter(col("b") > 1).aggregated


def test_provenance_properties(session):
    rng = random.Random(1)
    left, right = [(rng.randrange(6), i) for i in range(60)], [(rng.randrange(8), i) for i in range(25)]
    a, b = send(session, left, "k int, x int"), send(session, right, "k int, y int")
    joined = a.join(b, on="k")
    stats = joined.provenance()
    assert stats[a.identifier].join_scaling == max(sum(r[0] == k for r in right) for k, _ in left)
    assert stats[b.identifier].join_scaling == max(sum(r[0] == k for r in left) for k, _ in right)
    grouped = joined.groupby("k").agg(count().alias("n"))
    least = min(r[1] for r in rows(grouped))
    assert {s.agg_size for s in grouped.provenance().values()} == {least}
    assert a.join(b, on="k", how="semi").provenance()[b.identifier].join_scaling == 0
    assert a.join(b, how="cross").provenance()[a.identifier].join_scaling == 25
    both = a.vstack(a.filter(col("x") > 3))
    assert both.provenance() == {a.identifier: Stats(1, 1)}
    assert a.filter(col("x") < 0).groupby("k").agg(count()).provenance()[a.identifier].agg_size == 0


def test_empty_group_result_is_unsafe(session):
    f = send(session, [(1,)], "a int", Policy(Aggregation(1), Action.REJECT))
    assert f.filter(col("a") > 5).groupby("a").agg(count()).fetch() is None


def test_sanitised_columns(session):
    f = send(session, [(1, "x", 2.0), (2, "y", 3.0)], "i int, secret string, v double", sanitized=("secret",))
    for frame in (
        f.select("i", "secret"), f.select("i", col("secret").alias("s2")), f.rename({"secret": "other"}), f.with_columns(col("secret").str.to_uppercase().alias("up")),
        f.join(f.select("i", col("secret").alias("t")), on="i"), f.melt("i", ["secret"]), sql("SELECT i, secret AS hidden FROM {}", f),
        sql("SELECT i, upper(x) AS y FROM (SELECT i, secret || 'a' AS x FROM {})", f),
    ):
        got = frame.fetch().toPandas()
        for c in got.columns:
            values = set(got[c].dropna().astype(str))
            assert not values & {"x", "y", "X", "Y", "xa", "ya", "XA", "YA"}, c
    assert len(rows(f.select(col("secret").alias("n").n_unique().alias("n")).fetch())) == 1


def test_save_reload_delete(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    session = GuardSession(spark, user="own", store=store)
    f = send(session, [(i % 2, i) for i in range(40)], "k int, v int", Policy(Aggregation(10), Action.REJECT), sanitized=("v",))
    f.save()
    again = GuardSession(spark, store=store)
    g = again.get_df(f.identifier)
    assert again.artifact(f.identifier).policy == Policy(Aggregation(10), Action.REJECT) and g.blacklist == {"v"}
    assert g.fetch() is None and len(rows(g.groupby("k").agg(count()).fetch())) == 2
    assert f.identifier in {r["name"] for r in again.list_dfs().collect()} and "v" in again.header(f.identifier)
    closed = send(session, [(1,)], "a int", Policy(savable=False))
    with pytest.raises(RequestRejected):
        closed.save()
    with pytest.raises(NotFound):
        session.get_df("nothing")
    again.is_owner = False
    with pytest.raises(RequestRejected):
        again.delete(f.identifier)
    with pytest.raises(RequestRejected):
        send(again, [(1,)], "a int")
    with pytest.raises(RequestRejected):
        again.read(f"{tmp_path}/store")
    again.is_owner = True
    again.delete(f.identifier)
    assert GuardSession(spark, store=store).catalogue == {}


def test_vstack_and_joins_by_example(session):
    metals = send(session, [("Copper", 1357.77), ("Silver", 1234.93), ("Gold", 1337.33), ("Platinum", 2041.4)], "Element string, melting double")
    more = send(session, [("Silver", 1234.93), ("Magnesium", 923.0)], "Element string, melting double")
    both = metals.vstack(more)
    assert both.df.count() == 6 and both.unique().df.count() == 5
    symbols = send(session, [("Copper", "Cu", 29), ("Silver", "Ag", 47), ("Gold", "Au", 79), ("Platinum", "Pt", 78)], "Element string, Symbol string, Number long")
    assert rows(both.join(symbols, on="Element", how="anti")) == [("Magnesium", 923.0)]
    assert both.join(symbols, on="Element").columns == ["Element", "melting", "Symbol", "Number"]
    with pytest.raises(ValueError, match="same column"):
        metals.vstack(symbols)
    with pytest.raises(ValueError, match="same session"):
        metals.join(send(GuardSession(session.spark), [("a",)], "Element string"), on="Element")


@pytest.mark.parametrize(("strategy", "want"), [("backward", ["Amateur", "Intermediate", "Intermediate", "Advanced"]), ("forward", ["Intermediate", "Advanced", "Advanced", "Expert"])])
@pytest.mark.parametrize("by", [None, "g"])
def test_asof_by_example(session, strategy, want, by):
    left = send(session, [(7, "A", 1), (16, "B", 1), (24, "C", 1), (49, "D", 1)], "distance int, name string, g int")
    right = send(session, [(1, "Amateur", 1), (10, "Intermediate", 1), (25, "Advanced", 1), (50, "Expert", 1)], "distance int, level string, g int")
    if by is None:
        right = right.drop("g")
    got = {r["name"]: r["level"] for r in left.join_asof(right, on="distance", by=by, strategy=strategy).df.collect()}
    assert [got[n] for n in "ABCD"] == want


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("group_rows", [10, 10**6])
def test_asof_against_brute_force(session, monkeypatch, seed, forward, group_rows):
    monkeypatch.setattr(ordered, "ASOF_GROUP_ROWS", group_rows)
    rng = random.Random(seed)
    left = [(i, rng.choice([None, rng.randrange(200)])) for i in range(150)]
    right = [(rng.choice([None, *range(0, 200, 7)]), j) for j in range(rng.randrange(40))]
    right = list({k: (k, j) for k, j in right}.values())
    out = send(session, left, "i int, t int").join_asof(send(session, right, "t int, j int"), on="t", strategy="forward" if forward else "backward", tolerance=15)
    want = {}
    for i, t in left:
        near = [(abs(k - t), j) for k, j in right if k is not None and t is not None and (k >= t if forward else k <= t) and abs(k - t) <= 15]
        want[i] = min(near)[1] if near else None
    assert {r["i"]: r["j"] for r in out.df.collect()} == want


@pytest.mark.parametrize("group_rows", [10, 10**6])
def test_asof_by_keys_against_brute_force(session, monkeypatch, group_rows):
    monkeypatch.setattr(ordered, "ASOF_GROUP_ROWS", group_rows)
    rng = random.Random(5)
    left = [(i, rng.choice([None, "a", "a", "a", "b"]), rng.randrange(500)) for i in range(200)]
    right = [(rng.choice([None, "a", "b", "c"]), k, k) for k in rng.sample(range(500), 60)]
    out = send(session, left, "i int, g string, t int").join_asof(send(session, right, "g string, t int, j int"), on="t", by="g")
    want = {i: max((j for h, k, j in right if g is not None and h == g and k <= t), default=None) for i, g, t in left}
    assert {r["i"]: r["j"] for r in out.df.collect()} == want


def test_scalers_by_example(session):
    f = send(session, [(180000.0, 110), (360000.0, 905), (230000.0, 230), (60000.0, 450)], "a double, b int")
    z = [r[0] for r in rows(f.zscore_scale("a").select("a"))]
    assert z == pytest.approx([-0.221422, 1.227884, 0.181163, -1.187625], abs=1e-6)
    assert [r[0] for r in rows(f.minmax_scale("a"))] == pytest.approx([0.4, 1, 0.566667, 0], abs=1e-6)
    assert min(r[1] for r in rows(f.mean_scale(["a", "b"]))) < 0
    assert max(r[0] for r in rows(f.max_abs_scale("a"))) == 1
    with pytest.raises(ValueError, match="not found"):
        f.zscore_scale("c")
    assert rows(send(session, [(2.0,), (2.0,)], "a double").minmax_scale("a")) == [(None,), (None,)]  # a zero range gives nulls


def test_nulls_and_positions(session):
    f = nums(session)
    assert rows(f.select(col("v").count(), col("v").null_count().alias("z"), col("k").n_unique().alias("u"))) == [(5, 1, 3)]
    assert [r[2] for r in rows(f.interpolate().sort("i"))] == [3.0, 4.0, 5.0, 1.0, 2.0]
    assert [r[0] for r in rows(f.shift(2).sort("__ord").select("i"))] == [None, None, 0, 1, 2]
    assert [r[0] for r in rows(f.take_every(2).sort("i").select("i"))] == [0, 2, 4]
    assert rows(f.with_row_count("n").sort("n").select("n", "i")) == [(i, i) for i in range(5)]
    assert [r[0] for r in rows(f.slice(1, 2).select("i"))] == [1, 2] and [r[0] for r in rows(f.slice(-2).select("i"))] == [3, 4]
    assert [r[0] for r in rows(f.reverse().head(2).select("i"))] == [4, 3] and [r[0] for r in rows(f.tail(2).select("i"))] == [3, 4]
    assert rows(f.first().select("i")) == [(0,)] and rows(f.last().select("i")) == [(4,)]
    assert rows(f.filter(col("k") != None).select(count())) == [(4,)]  # noqa: E711
    assert rows(f.sort("v").select("v").limit(2)) == [(None,), (1.0,)]
    assert rows(f.groupby("k").agg(col("i").first().alias("a"), col("i").last().alias("b")).sort("k")) == [(None, 4, 4), ("a", 0, 2), ("b", 1, 3)]
    assert rows(f.unique(subset="k", keep="last").sort("i").select("i")) == [(2,), (3,), (4,)]
    with pytest.raises(ValueError, match="order"):
        f.order_by().with_row_count()
    with pytest.raises(UnsupportedOperation):
        f.with_context()
    with pytest.raises(ValueError, match="not found"):
        f.select("nothing")


@pytest.mark.parametrize("block", [3, 10**6])
def test_interpolation_over_blocks(session, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    values = [None, 2.0, None, None, None, None, None, None, 10.0, None, 12.0, None, None]
    f = send(session, list(enumerate(values)), "i int, v double", order=("i",))
    got = [r[1] for r in rows(f.interpolate().sort("i"))]
    assert got == [None, 2.0, *(pytest.approx(2 + 8 * k / 7) for k in range(1, 7)), 10.0, 11.0, 12.0, None, None]


@pytest.mark.parametrize("order", ["i", "-i"])
def test_fills_look_both_ways(session, order):
    values = [(0, None, "a"), (1, 2.0, "a"), (2, None, "b"), (3, None, "a"), (4, 8.0, "a"), (5, 9.0, "b"), (6, None, "a")]
    f = send(session, values, "i int, v double, g string", order=(order,))
    back = [r[1] for r in rows(f.select("i", col("v").backward_fill().alias("b")).sort("i"))]
    assert back == ([2.0, 2.0, 8.0, 8.0, 8.0, 9.0, None] if order == "i" else [None, 2.0, 2.0, 2.0, 8.0, 9.0, 9.0])
    line = [r[1] for r in rows(f.select("i", col("v").interpolate().over("g").alias("w")).sort("i"))]
    assert line == [None, 2.0, None, 5.0, 8.0, 9.0, None]


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("alpha", [1.0, 0.5, 0.05])
def test_exponential_weights(session, alpha, adjust):
    values = [None if i % 7 in (0, 3) or 300 < i < 500 else math.sin(i) * 10 for i in range(1200)]
    got = [r[1] for r in rows(send(session, list(enumerate(values)), "i int, v double", order=("i",)).select("i", col("v").ewm_mean(alpha, adjust).alias("e")).sort("i"))]
    total, weight, expected = 0.0, 0.0, []
    for v in values:
        if v is not None and adjust:
            total, weight = total * (1 - alpha) + v, weight * (1 - alpha) + 1
        elif v is not None:
            total, weight = (v if weight == 0 else total * (1 - alpha) + v * alpha), 1.0
        expected.append(total / weight if weight else None)
    assert got == [None if e is None else pytest.approx(e, rel=1e-9, abs=1e-9) for e in expected]


def test_quantiles(session):
    values = [(float(x),) for x in (1, 2, 3, 10)]
    f = send(session, values, "v double")
    q = lambda p, how: rows(f.select(col("v").quantile(p, how)))[0][0]
    assert [q(0.5, h) for h in ("nearest", "lower", "higher", "midpoint", "linear")] == [3, 2, 3, 2.5, 2.5]
    assert q(0.25, "nearest") == 2 and q(1.0, "nearest") == 10 and q(0.0, "linear") == 1
    assert rows(f.filter(col("v") > 99).select(col("v").quantile(0.5))) == [(None,)]


def test_describe_and_frame_aggregates(session):
    f = send(session, [(1, 2.0, "a"), (2, None, "b"), (6, 4.0, None)], "i int, v double, s string")
    got = {r[0]: r[1:] for r in rows(f.describe())}
    assert got["count"] == (3, 3, "3") and got["null_count"] == (0, 1, "1") and got["mean"] == (3, 3, None) and got["median"] == (2, 3, None)
    assert (got["min"][2], got["max"][2]) == ("a", "b")
    assert rows(f.max()) == [(6, 4.0, "b")] and rows(f.sum()) == [(9, 6.0, None)]


def test_fills_and_reshape(session):
    f = send(session, [(1, None, None), (None, 2.5, "x")], "i int, v double, s string")
    assert sorted(map(str, rows(f.fill_null("100")))) == sorted(map(str, [(1, None, "100"), (None, 2.5, "x")]))
    assert sorted(map(str, rows(f.fill_null(7)))) == sorted(map(str, [(1, 7.0, "7"), (7, 2.5, "x")]))
    g = send(session, [(1, [1, 2], [3, 4]), (2, [], None)], "i int, a array<int>, b array<int>")
    assert sorted(map(str, rows(g.explode(["a", "b"])))) == sorted(map(str, [(1, 1, 3), (1, 2, 4), (2, None, None)]))
    assert set(f.to_dummies("s").columns) == {"i", "v", "s_null", "s_x"}
    assert rows(nums(session).melt("i", ["v"]).filter(col("i") == 2)) == [(2, "v", 5.0)]


def test_udfs(session):
    f = send(session, [(-7, 2.5, "a"), (13, None, "b")], "i int, v double, s string")
    assert rows(f.apply_udf(["i"], ApplyBins(5)).select("i")) == [(-10,), (10,)]
    assert rows(f.apply_udf(["i", "v"], ApplyAbs()).select("i", "v")) == [(7, 2.5), (13, None)]
    with pytest.raises(TypeError):
        f.apply_udf("s", ApplyAbs())
    with pytest.raises(ValueError):
        f.apply_udf("zz", ApplyAbs())
    with pytest.raises(TypeError):
        f.apply_udf("i", lambda x: 5)


def test_plots(session):
    f = send(session, [(i % 3, float(i), "h" if i % 2 else None) for i in range(30)], "x int, y double, h string", Policy(Aggregation(5), Action.REJECT))
    assert sum(r[1] for r in rows(f.histplot("y", bins=7))) == 30
    assert f.histplot("y", bins=7).fetch() is None and f.histplot("x", bins=1).fetch() is not None
    assert rows(f.barplot(y="y", estimator="max")) == [(29.0,)]
    assert len(rows(f.barplot("x", "y", "h", "std"))) == 6
    box = rows(f.boxplot("y"))[0]
    assert box[0] == 0 and box[4] == 29 and box[5] == box[3] - box[1]
    assert [r[0] for r in rows(f.groupby("h").count().pieplot("count", "h"))].count("null") == 1
    assert len(rows(f.facet("h", "x").histplot("y", 100))) == 6
    with pytest.raises(ValueError):
        f.barplot()
    with pytest.raises(ValueError):
        f.barplot("x", "y", estimator="nothing")


def test_time_groups(session):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    f = send(session, [(at(h), h) for h in (0, 1, 2, 5, 26)], "t timestamp, v int")
    rolled = {r[0]: r[1] for r in rows(f.groupby_rolling("t", "2h").agg(col("v").sum().alias("s")))}
    assert [rolled[at(h)] for h in (0, 1, 2, 5, 26)] == [0, 1, 3, 5, 26]
    rolled = {r[0]: r[1] for r in rows(f.groupby_rolling("t", "2h", closed="both").agg(count().alias("n")))}
    assert [rolled[at(h)] for h in (0, 1, 2)] == [1, 2, 3]
    days = rows(f.groupby_dynamic("t", "1d", include_boundaries=True).agg(count().alias("n")).sort("t"))
    assert [(r[2], r[3]) for r in days] == [(at(0), 4), (at(24), 1)] and days[0][1] == at(24)


def test_sql_guard(session, spark):
    f = nums(session)
    spark.range(3).createOrReplaceTempView("loose_view")
    for text in ("SELECT * FROM {} JOIN loose_view", "SELECT * FROM parquet.`/etc` JOIN {}", "DROP TABLE {}", "INSERT INTO {} VALUES (1)", "SELECT (SELECT max(id) FROM loose_view) FROM {}", "SELECT * FROM {} JOIN range(5)"):
        with pytest.raises(Exception):  # noqa: B017
            sql(text, f)
    assert rows(sql('WITH c AS (SELECT count("k") AS n FROM {}) SELECT n FROM c', f)) == [(4,)]
    with pytest.raises(ValueError):
        sql("SELECT 1")
    with pytest.raises(ValueError):
        sql("SELECT * FROM {}", f, f)
    grouped = sql("SELECT k, avg(v) AS m FROM {} GROUP BY k ORDER BY k", f)
    assert list(grouped.provenance().values()) == [Stats(1, 1)]
    assert list(sql("SELECT avg(v) FROM {}", f).provenance().values()) == [Stats(5, 1)]
    joined = sql("SELECT a.i FROM {} a JOIN {} b ON a.k = b.k", f, nums(session)).provenance()
    assert {s.join_scaling for s in joined.values()} == {2}


def test_date_patterns():
    assert java_pattern("%m/%d/%Y") == "MM/dd/yyyy" and java_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    with pytest.raises(ValueError):
        java_pattern("%Q")


def test_trusted_sources_need_no_counts(session, monkeypatch):
    """A result of tables whose policies ask nothing is released without jobs that count rows; one of other tables is not."""
    from cloister import lineage

    open_, closed = (send(session, [(1, 2), (1, 3)], "k int, v int", p) for p in (Policy(TrueRule()), Policy(Aggregation(2), Action.REJECT)))
    counted = []
    monkeypatch.setattr(lineage, "smallest_group", lambda df, keys: counted.append(1) or 2)
    assert len(rows(open_.groupby("k").agg(count()).collect().fetch())) == 1 and not counted
    assert len(rows(closed.groupby("k").agg(count()).collect().fetch())) == 1 and counted
    both = open_.groupby("k").agg(count()).vstack(closed.groupby("k").agg(count()))
    assert both.provenance.sources == set(open_.provenance.sources) | set(closed.provenance.sources)


def test_dynamic_windows_by_hand(session):
    import datetime

    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    f = send(session, [(day(1),), (day(2),), (day(2, 12),), (day(4),), (None,)], "t timestamp_ntz")
    seen = lambda **k: {r[0]: r[1] for r in rows(f.groupby_dynamic("t", "1d", **k).agg(count().alias("n")))}
    assert seen() == {day(1): 1, day(2): 2, day(4): 1}
    assert seen(closed="right") == {day(1) - datetime.timedelta(1): 1, day(1): 1, day(2): 1, day(3): 1}
    assert seen(closed="both") == {day(1) - datetime.timedelta(1): 1, day(1): 2, day(2): 2, day(3): 1, day(4): 1}
    assert seen(closed="none") == {day(2): 1}
    assert seen(period="6h") == {day(1): 1, day(2): 1, day(4): 1}
    assert seen(offset="12h") == {day(1) - datetime.timedelta(hours=12): 1, day(1, 12): 1, day(2, 12): 1, day(3, 12): 1}
    assert seen(truncate=False) == {day(1): 1, day(2): 2, day(4): 1}
    months = {r[0]: r[1] for r in rows(f.groupby_dynamic("t", "1mo", period="2mo").agg(count().alias("n")))}
    assert months == {datetime.datetime(2023, 12, 1): 4, datetime.datetime(2024, 1, 1): 4}
    both = rows(f.groupby_dynamic("t", "1y", include_boundaries=True).agg(count().alias("n")))
    assert [tuple(r) for r in both] == [(datetime.datetime(2024, 1, 1), datetime.datetime(2025, 1, 1), datetime.datetime(2024, 1, 1), 4)]
    for wrong in ({"closed": "up"}, {"period": "-1d"}):
        with pytest.raises(ValueError):
            f.groupby_dynamic("t", "1d", **wrong)


def test_medians_by_rank(spark):
    """Medians and linear quantiles of groups, columns and plots, without any task that holds a group's values."""
    import statistics

    rows = [(i % 3, float((i * 37) % 101) if i % 5 else None, i if i % 7 else None, "x") for i in range(100)] + [(7, None, None, "y")]
    f = GuardSession(spark).send_df(spark.createDataFrame(rows, "k int, a double, b int, s string"), Policy(TrueRule()))
    of = lambda column, k=None: [r[column] for r in rows if r[column] is not None and k in (None, r[0])]
    got = f.median().fetch().first()
    assert (got["a"], got["b"], got["s"]) == (statistics.median(of(1)), statistics.median(of(2)), None)
    assert f.quantile(0.3, "linear").fetch().first()["a"] == pytest.approx(np.quantile(of(1), 0.3))
    assert f.quantile(0.3, "higher").fetch().first()["b"] == np.quantile(of(2), 0.3, method="higher")
    described = {r["describe"]: r for r in f.describe().fetch().collect()}
    assert described["median"]["a"] == statistics.median(of(1)) and described["median"]["s"] is None and described["max"]["s"] == "y"
    by = {r["k"]: (r["m"], r["q"]) for r in f.groupby("k").agg(col("a").median().alias("m"), col("a").quantile(0.9, "linear").alias("q")).fetch().collect()}
    assert by[7] == (None, None) and all(by[k] == (statistics.median(of(1, k)), pytest.approx(np.quantile(of(1, k), 0.9))) for k in range(3))
    bars = {r["k"]: r["value"] for r in f.barplot("k", "a", estimator="median").fetch().collect()}
    assert bars == {k: m for k, (m, _) in by.items()}
    assert f.barplot(y="a", estimator="median").fetch().first()["value"] == statistics.median(of(1))
    none = f.filter(col("k") > 99)
    assert none.median().fetch().first()["a"] is None and none.barplot(y="a", estimator="median").fetch().first()["value"] is None
    for frame in (f.median(), f.describe(), f.groupby("k").agg(col("a").median()), f.barplot("k", "a", estimator="median")):
        plan = frame.df._jdf.queryExecution().optimizedPlan().toString()
        assert "median(" not in plan and "percentile(" not in plan


def test_cross_joins_are_bounded(session, monkeypatch):
    a, b = nums(session), nums(session)
    assert a.join(b, how="cross").fetch().count() == a.df.count() ** 2
    monkeypatch.setattr("cloister.frame.CROSS_ROWS", 20)
    with pytest.raises(ValueError, match="cross join of 5 by 5"):
        a.join(b, how="cross")


def test_named_parts(session, monkeypatch):
    f = nums(session)
    monkeypatch.setattr("cloister.frame.MOST_PARTS", 1)
    with pytest.raises(ValueError, match="more than 1 values"):
        f.partition_by("i")
    parts = f.partition_by("i", values=[1, 2, 99])
    assert [parts[v].fetch().count() for v in (1, 2, 99)] == [f.df.where(f"i = {v}").count() for v in (1, 2, 99)]
