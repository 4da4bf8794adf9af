"""Windows over whole frames, cut into blocks of a few rows, against plain Python."""

import datetime as dt
import math
import pickle
import random

import pytest

from cloister.functions.expr import col, count
from cloister.operators import ordered
from cloister.policy import Policy, TrueRule
from cloister.session import GuardSession

N = 60


@pytest.fixture
def values():
    rng = random.Random(9)
    return [None if rng.random() < 0.3 or 20 <= i < 35 else float(rng.randrange(12)) for i in range(N)]


@pytest.fixture
def frame(spark, values, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    rows = [(i, v) for i, v in enumerate(values)]
    random.Random(2).shuffle(rows)
    return GuardSession(spark).send_df(spark.createDataFrame(rows, "id long, v double").repartition(3), Policy(TrueRule()), order_by=("id",))


def _got(frame, e, order="id"):
    return [r["x"] for r in sorted(frame.order_by(order).select("id", e.alias("x")).fetch().collect(), key=lambda r: r["id"])]


def _so_far(values, f):
    return [None if v is None else f([x for x in values[: i + 1] if x is not None]) for i, v in enumerate(values)]


def _product(xs):
    out = 1.0
    for x in xs:
        out *= x
    return out


def _ewm(values, alpha, adjust):
    out, seen = [], []
    for v in values:
        if v is not None:
            seen.append(v)
        if not seen:
            out.append(None)
        elif adjust:
            weights = [(1 - alpha) ** (len(seen) - 1 - j) for j in range(len(seen))]
            out.append(sum(w * x for w, x in zip(weights, seen, strict=True)) / sum(weights))
        else:
            y = seen[0]
            for x in seen[1:]:
                y = alpha * x + (1 - alpha) * y
            out.append(y)
    return out


def _close(a, b):
    return all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9 * max(1, abs(y))) for x, y in zip(a, b, strict=True))


v = col("v")


def test_running(frame, values):
    assert _close(_got(frame, v.cumsum()), _so_far(values, sum))
    assert _got(frame, v.cummin()) == _so_far(values, min)
    assert _got(frame, v.cummax()) == _so_far(values, max)
    assert _close(_got(frame, (v / 6 + 0.5).cumprod()), _so_far([None if x is None else x / 6 + 0.5 for x in values], _product))
    assert _got(frame, v.cumcount()) == list(range(N))


@pytest.mark.parametrize("n", [1, 3, 20, -1, -9])
def test_shifts(frame, values, n):
    moved = [values[i - n] if 0 <= i - n < N else None for i in range(N)]
    assert _got(frame, v.shift(n)) == moved
    assert _got(frame, v.diff(n)) == [None if a is None or b is None else a - b for a, b in zip(values, moved, strict=True)]


@pytest.mark.parametrize("size", [2, 5, 30])
def test_rolling(frame, values, size):
    windows = [[x for x in values[max(0, i - size + 1) : i + 1] if x is not None] for i in range(N)]
    assert _close(_got(frame, v.rolling_sum(size, 1)), [sum(w) if w else None for w in windows])
    assert _got(frame, v.rolling_max(size, 2)) == [max(w) if len(w) > 1 else None for w in windows]


def test_fills(frame, values):
    forward = [next((x for x in reversed(values[: i + 1]) if x is not None), None) for i in range(N)]
    backward = [next((x for x in values[i:] if x is not None), None) for i in range(N)]
    assert _got(frame, v.forward_fill()) == forward and _got(frame, v.backward_fill()) == backward
    known = [i for i, x in enumerate(values) if x is not None]
    want = []
    for i, x in enumerate(values):
        a, b = max((k for k in known if k <= i), default=None), min((k for k in known if k >= i), default=None)
        want.append(x if x is not None else None if a is None or b is None else values[a] + (values[b] - values[a]) * (i - a) / (b - a))
    assert _close(_got(frame, v.interpolate()), want)
    whole = {r["id"]: r["v"] for r in frame.interpolate().fetch().collect()}
    assert _close([whole[i] for i in range(N)], want)


@pytest.mark.parametrize("alpha", [0.9, 0.3, 0.01, 1.0])
def test_ewm(frame, values, alpha):
    for adjust in (True, False):
        assert _close(_got(frame, v.ewm_mean(alpha, adjust)), _ewm(values, alpha, adjust))
    parts = frame.with_columns((col("id") % 2).alias("k")).order_by("id")
    got = {r["id"]: r["x"] for r in parts.select("id", v.ewm_mean(alpha).over("k").alias("x")).fetch().collect()}
    for k in (0, 1):
        assert _close([got[i] for i in range(k, N, 2)], _ewm(values[k::2], alpha, True))


def test_long_ewm_runs(spark):
    """More values than a run of weights in double precision holds."""
    rows = [(i, float(i % 13)) for i in range(3000)]
    f = GuardSession(spark).send_df(spark.createDataFrame(rows, "id long, v double"), Policy(TrueRule()), order_by=("id",))
    assert _close(_got(f, v.ewm_mean(0.7)), _ewm_fast([x for _, x in rows], 0.7))


def _ewm_fast(values, alpha):
    out, s, n = [], 0.0, 0.0
    for x in values:
        s, n = s * (1 - alpha) + x, n * (1 - alpha) + 1
        out.append(s / n)
    return out


@pytest.mark.parametrize("reverse", [False, True])
def test_ranks(frame, values, reverse):
    known = [x for x in values if x is not None]
    before = (lambda a, b: a > b) if reverse else (lambda a, b: a < b)
    low = [None if x is None else sum(before(y, x) for y in known) + 1 for x in values]
    assert _got(frame, v.rank("min", reverse)) == low
    assert _got(frame, v.rank("max", reverse)) == [None if x is None else n + known.count(x) - 1 for n, x in zip(low, values, strict=True)]
    assert _got(frame, v.rank("average", reverse)) == [None if x is None else n + (known.count(x) - 1) / 2 for n, x in zip(low, values, strict=True)]
    assert _got(frame, v.rank("dense", reverse)) == [None if x is None else len({y for y in known if before(y, x)}) + 1 for x in values]
    ordinal = [None if x is None else n + sum(y == x for y in values[:i]) for i, (n, x) in enumerate(zip(low, values, strict=True))]
    assert _got(frame, v.rank("ordinal", reverse)) == ordinal
    assert sorted(x for x in _got(frame, v.rank("random", reverse)) if x is not None) == list(range(1, len(known) + 1))


def test_several_at_once_and_aggregates(frame, values):
    mean = sum(x for x in values if x is not None) / sum(x is not None for x in values)
    got = frame.with_columns((v - v.mean()).cumsum().alias("c"), v.shift(2).alias("s"), v.rank("min").alias("r"), v.ewm_mean(0.5).alias("e")).fetch().collect()
    got = {r["id"]: r for r in got}
    assert len(got) == N and set(got[0].asDict()) == {"id", "v", "c", "s", "r", "e"}
    assert _close([got[i]["c"] for i in range(N)], _so_far([None if x is None else x - mean for x in values], sum))
    assert [got[i]["s"] for i in range(2, N)] == values[:-2]
    assert _close([got[i]["e"] for i in range(N)], _ewm(values, 0.5, True))
    above = {r["id"] for r in frame.filter(v.cumsum() > 50).fetch().collect()}
    assert above == {i for i, x in enumerate(_so_far(values, sum)) if x is not None and x > 50}


@pytest.mark.parametrize("closed", ["left", "right", "both", "none"])
def test_rolling_time_in_ranges(spark, monkeypatch, closed):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 20)
    rng = random.Random(4)
    rows = [(i, 1_700_000_000 + rng.randrange(3000), rng.randrange(9)) for i in range(300)] + [(300 + i, 1_700_001_000, 1) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, s long, v long").selectExpr("timestamp_seconds(s) AS ts", "v")
    f = GuardSession(spark).send_df(df, Policy(TrueRule()))
    got = sorted((r["ts"].timestamp(), r["n"], r["t"]) for r in f.groupby_rolling("ts", "60s", closed=closed).agg(count().alias("n"), col("v").sum().alias("t")).fetch().collect())
    inside = lambda d: (d < 60 or (d == 60 and closed in ("left", "both"))) and (d > 0 or (d == 0 and closed in ("right", "both")))
    want = []
    for _, s, _ in rows:
        near = [x for _, t, x in rows if t <= s and inside(s - t)]
        want.append((float(s), len(near), sum(near) if near else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or 0))


@pytest.mark.parametrize("interpolation", ["nearest", "lower", "higher", "midpoint"])
@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_quantiles_of_groups(spark, monkeypatch, interpolation, q):
    """Groups beyond the size that is looked at whole, ties, nulls and null keys."""
    monkeypatch.setattr(ordered, "WHOLE_GROUP", 50)
    monkeypatch.setattr(ordered, "QUANTILE_SHARE", 20)
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float(rng.randrange(40)), rng.random()])) for _ in range(1500)] + [("c", None), ("d", 5.0)]
    f = GuardSession(spark).send_df(spark.createDataFrame(rows, "k string, v double"), Policy(TrueRule()))
    x = col("v").quantile(q, interpolation)

    def want(found):
        found = sorted(found)
        if not found:
            return None
        at = (len(found) - 1) * q
        low, high = int(at), -int(-at // 1)
        return {"nearest": found[int(at + 0.5)], "lower": found[low], "higher": found[high], "midpoint": (found[low] + found[high]) / 2}[interpolation]

    far = col("v").quantile(0.35, "lower")  # found in the same pass
    got = {r["k"]: (r["x"], r["y"]) for r in f.groupby("k").agg(x.alias("x"), (far - far + 1).alias("y")).fetch().collect()}
    lower = {r["k"]: r["f"] for r in f.groupby("k").agg(x.alias("x"), far.alias("f"), col("v").quantile(0.9).alias("z")).fetch().collect()}
    for k in ("a", "b"):
        own = sorted(v for j, v in rows if j == k and v is not None)
        assert lower[k] == own[int((len(own) - 1) * 0.35)]
    for k in ("a", "b", "c", "d", None):
        w = want([v for j, v in rows if j == k and v is not None])
        assert got[k] == (w, None if w is None else 1.0)
    assert f.select(x.alias("x")).fetch().first()[0] == want([v for _, v in rows if v is not None])
    assert f.select((col("v") - x).alias("x")).fetch().where("x is not null").count() == sum(v is not None for _, v in rows)


def test_places_of_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, i * 2])) for i in range(90)] + [("one", 99, 1)]
    f = GuardSession(spark).send_df(spark.createDataFrame(rows, "k string, i long, v long"), Policy(TrueRule()), order_by=("i",))
    e = col("v")
    got = {r["k"]: r for r in f.groupby("k").agg(e.head(3).alias("h"), e.tail(2).alias("t"), e.slice(1, 4).alias("s"), e.slice(-3, 2).alias("b"), e.take([0, 5]).alias("x"), e.take([-1]).alias("y")).fetch().collect()}
    for k in ("a", "b", None, "one"):
        own = [v for j, _, v in rows if j == k]
        assert (got[k]["h"], got[k]["t"], got[k]["s"], got[k]["b"]) == (own[:3], own[-2:], own[1:5], own[-3:][:2])
        assert got[k]["x"] == [own[j] for j in (0, 5) if j < len(own)]
        assert got[k]["y"] == own[-1:]


GROUPS = [("a", 40), ("b", 3), (None, 9), ("c", 1), ("d", 7)]


@pytest.fixture
def grouped(spark, monkeypatch):
    """Groups of which some go on over several blocks of seven rows, and their rows in order."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    rng, rows = random.Random(4), []
    for k, n in GROUPS:
        rows += [(len(rows) + i, k, None if rng.random() < 0.3 else float(rng.randrange(1, 9))) for i in range(n)]
    mixed = rows[:]
    rng.shuffle(mixed)
    ids = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: rng.random()))}  # ids do not follow the groups
    mixed = [(ids[i], k, v) for i, k, v in mixed]
    df = spark.createDataFrame(mixed, "id long, k string, v double").repartition(3)
    groups = {k: sorted((i, v) for i, g, v in mixed if g == k) for k, _ in GROUPS}
    return GuardSession(spark).send_df(df, Policy(TrueRule()), order_by=("id",)), groups


def _by_group(grouped, e, want):
    frame, groups = grouped
    got = {r["id"]: r["x"] for r in frame.select("id", e.alias("x")).fetch().collect()}
    assert len(got) == sum(map(len, groups.values()))
    for rows in groups.values():
        assert _close([got[i] for i, _ in rows], want([v for _, v in rows]))


SEGMENTED = {
    "cumsum": (v.cumsum(), lambda x: _so_far(x, sum)),
    "cummax": (v.cummax(), lambda x: _so_far(x, max)),
    "cumprod": (v.cumprod(), lambda x: _so_far(x, _product)),
    "cumcount": (v.cumcount(), lambda x: list(range(len(x)))),
    "shift": (v.shift(3), lambda x: [None] * min(3, len(x)) + x[:-3]),
    "lead": (v.shift(-2), lambda x: (x[2:] + [None, None])[: len(x)]),
    "rolling": (v.rolling_sum(4, 1), lambda x: [sum(w) if (w := [y for y in x[max(0, i - 3) : i + 1] if y is not None]) else None for i in range(len(x))]),
    "forward": (v.forward_fill(), lambda x: [next((y for y in reversed(x[: i + 1]) if y is not None), None) for i in range(len(x))]),
    "backward": (v.backward_fill(), lambda x: [next((y for y in x[i:] if y is not None), None) for i in range(len(x))]),
    "ewm": (v.ewm_mean(0.3), lambda x: _ewm(x, 0.3, True)),
    "sum": (v.sum(), lambda x: [sum(y for y in x if y is not None) if any(y is not None for y in x) else None] * len(x)),
    "centred": (v - v.max(), lambda x: [None if y is None else y - max(z for z in x if z is not None) for y in x]),
    "share of the sum so far": (v.cumsum() / v.sum(), lambda x: [None if s is None else s / sum(y for y in x if y is not None) for s in _so_far(x, sum)]),
    "rank": (v.rank("min"), lambda x: [None if y is None else 1 + sum(z is not None and z < y for z in x) for y in x]),
}


@pytest.mark.parametrize("name", SEGMENTED)
def test_large_groups(grouped, name):
    e, want = SEGMENTED[name]
    _by_group(grouped, e.over("k"), want)


def test_several_passes_in_one_frame(grouped):
    frame, groups = grouped
    found = frame.select("id", v.cumsum().over("k").alias("a"), (v.cumsum().over(col("id") % 1) - v.sum().over("k")).alias("b"), v.cumcount().over("k").alias("c"), v.cumsum().alias("d"), v.mean().alias("m")).fetch().collect()
    got = {r["id"]: r for r in found}
    everything = [x for _, x in sorted(y for rows in groups.values() for y in rows)]
    assert _close([got[i]["d"] for i in sorted(got)], _so_far(everything, sum))
    for rows in groups.values():
        total = sum(x for _, x in rows if x is not None)
        assert _close([got[i]["a"] for i, _ in rows], _so_far([x for _, x in rows], sum)) and [got[i]["c"] for i, _ in rows] == list(range(len(rows)))
        known = [(got[i]["b"], got[i]["d"]) for i, x in rows if x is not None]
        assert all(abs(b - (d - total)) < 1e-9 for b, d in known)
    kept = frame.filter(v.cumcount().over("k") < 2).fetch().collect()
    assert sorted(r["id"] for r in kept) == sorted(i for rows in groups.values() for i, _ in rows[:2])


def test_a_hot_group_is_spread(grouped):
    """No window of the plan goes by the group alone, and the largest share of a task is a block and what is copied to it."""
    frame, _ = grouped
    plan = frame.select("id", v.cumsum().over("k").alias("x")).df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__block" in line for line in windows)


@pytest.mark.parametrize("closed", ["right", "left", "both", "none"])
@pytest.mark.parametrize("seconds", [1, 5, 60])
def test_rolling_time_of_large_groups(spark, monkeypatch, closed, seconds):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice("ab"), None if rng.random() < 0.05 else rng.randrange(40), float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, k string, s long, v double").selectExpr("id", "k", "timestamp_seconds(s) AS ts", "v").repartition(3)
    f = GuardSession(spark).send_df(df, Policy(TrueRule()), order_by=("id",))
    got = f.groupby_rolling("ts", f"{seconds}s", closed=closed, by="k").agg(v.sum().alias("x"), count().alias("n")).fetch().collect()
    left, right = closed in ("left", "both"), closed in ("right", "both")
    want = []
    for _, k, s, _ in rows:
        if s is None:
            inside = [x for _, g, t, x in rows if g == k and t is None]
        else:
            inside = [x for _, g, t, x in rows if g == k and t is not None and (s - seconds <= t if left else s - seconds < t) and (t <= s if right else t < s)]
        want.append((k, s, sum(inside) if inside else None, len(inside)))
    assert sorted(((r["k"], None if r["ts"] is None else int(r["ts"].timestamp()), r["x"], r["n"]) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("interpolation", ["nearest", "lower", "higher", "midpoint", "linear"])
def test_long_rolling_quantiles(frame, values, grouped, monkeypatch, interpolation):
    import numpy as np

    from cloister.functions import scans

    monkeypatch.setattr(scans, "SHORT_WINDOW", 4)
    for size, least in ((5, 2), (20, 5), (90, 1)):
        def want(x, size=size, least=least):
            windows = [[y for y in x[max(0, i - size + 1) : i + 1] if y is not None] for i in range(len(x))]
            return [float(np.quantile(w, 0.4, method=interpolation if interpolation != "nearest" else "linear")) if len(w) >= least and interpolation != "nearest" else sorted(w)[int((len(w) - 1) * 0.4 + 0.5)] if len(w) >= least else None for w in windows]

        assert _close(_got(frame, v.rolling_quantile(0.4, size, interpolation, least)), want(values))
        _by_group(grouped, (v.rolling_quantile(0.4, size, interpolation, least) * 1).over("k"), want)
    assert _close(_got(frame, v.rolling_median(7, 3)), [float(np.median(w)) if len(w := [y for y in values[max(0, i - 6) : i + 1] if y is not None]) > 2 else None for i in range(N)])


def test_sliding_window_with_nan():
    import pyarrow as pa

    from cloister.functions.scans import SlidingQuantile

    rows = pa.table({"__ord": range(6), "__halo": [True, False, False, False, False, False], "__v": [1.0, float("nan"), 2.0, None, 0.0, 5.0]})
    got = SlidingQuantile(3, 1, 1.0, "lower").rows(rows)["__out"].to_pylist()
    assert [repr(x) for x in got] == ["nan", "nan", "nan", "2.0", "5.0"]


def _distinct():
    return dict(start={}, step=lambda s, x: {**s, x: s.get(x, 0) + 1}, merge=lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}, finish=len, dtype="long")


def test_folds_merge_over_blocks(frame, values, grouped):
    """The number of distinct values so far, and the longest run of increases, whose states are no numbers."""
    def distinct(x):
        return [len({y for y in x[: i + 1] if y is not None}) for i in range(len(x))]

    assert _got(frame, v.cumulative_fold(**_distinct())) == distinct(values)
    _by_group(grouped, v.cumulative_fold(**_distinct()).over("k"), distinct)
    last = v.cumulative_fold(None, lambda s, x: x, lambda a, b: a if b is None else b)
    assert _close(_got(frame, last), [next((x for x in reversed(values[: i + 1]) if x is not None), None) for i in range(N)])
    mixed = {r["id"]: (r["a"], r["b"]) for r in frame.select("id", (v.cumulative_fold(**_distinct()) + v.cumcount()).alias("a"), v.cumsum().alias("b")).fetch().collect()}
    assert [mixed[i][0] for i in range(N)] == [a + i for i, a in enumerate(distinct(values))] and _close([mixed[i][1] for i in range(N)], _so_far(values, sum))
    with pytest.raises(ValueError, match="frame of rows"):
        frame.groupby("id").agg(v.rolling_median(500))


@pytest.mark.parametrize("closed", ["left", "right", "both", "none"])
def test_long_time_windows_as_in_spark(spark, monkeypatch, closed):
    """Aggregates of time windows by a scan of blocks equal Spark's own windows, with nulls, NaN, infinities, equal times and rows without a time."""
    from cloister import frame as frames

    odd = {5: None, 17: float("nan"), 40: float("inf"), 60: 1e15}
    rows = [(i, None if i % 41 == 3 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * i % 97 * 10), i % 3, odd.get(i, i * 0.37 % 11), None if i % 13 == 1 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k int, v double, n int")
    values = [col("v").sum().alias("s"), (col("v").mean() + 1).alias("m"), col("v").min().alias("lo"), col("v").max().alias("hi"), count().alias("c"), col("n").sum().alias("ns"), col("n").mean().alias("nm")]

    def found(by):
        out = GuardSession(spark).send_df(df, Policy(TrueRule())).groupby_rolling("ts", "3m", closed=closed, by=by).agg(*values).df
        assert ("FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()) == (frames.LONG_GROUP == 0)
        close = lambda x: "nan" if x != x else x if not isinstance(x, float) else float(f"{x:.9g}")
        return sorted(str(tuple(map(close, r))) for r in out.collect())

    for by in (None, "k"):
        plain = found(by)
        monkeypatch.setattr(frames, "LONG_GROUP", 0)
        assert found(by) == plain
        monkeypatch.undo()


def test_scans_of_a_frame_share_a_pass(frame, values, monkeypatch):
    from cloister.functions import scans

    monkeypatch.setattr(scans, "SHORT_WINDOW", 4)
    out = frame.select("id", v.rolling_median(9, 1).alias("a"), v.rolling_quantile(0.9, 20, "linear", 5).alias("b"), v.cumulative_fold(**_distinct()).alias("c"), v.backward_fill().alias("d"))
    assert out.df._jdf.queryExecution().analyzed().toString().count("FlatMapGroupsInArrow") == 1
    got = {r["id"]: r for r in out.fetch().collect()}
    assert [got[i]["c"] for i in range(N)] == [len({y for y in values[: i + 1] if y is not None}) for i in range(N)]


def test_pieces_of_blocks():
    """A piece ends where places leave off or a block does, not with a batch; its state is that of its last group."""
    import pyarrow as pa

    from cloister.functions.scans import Fold, pieces

    def batch(*rows):
        return pa.RecordBatch.from_pylist([dict(zip(("__block", "__h0", "__h1", "__ord", "__v0"), r, strict=True)) for r in rows])

    run = Fold(0, lambda s, x: s + x, lambda a, b: a + b, lambda s: s)
    parts = [batch((0, 1, 1, 0, 1), (0, 1, 1, 1, 2)), batch((0, 1, 1, 2, None), (0, 2, 1, 3, 8), (0, 2, 2, 4, 16)), batch((0, 2, 2, 5, 32), (1, 2, 2, 6, 64), (1, 3, 3, 9, 128))]
    got = [[*r.to_pylist()[0].values()] for r in pieces(iter(parts), [(0, run)])]
    assert [[*r[:-1], pickle.loads(r[-1])] for r in got] == [[0, 0, 1, 1, 2, 2, 48], [1, 6, 2, 2, 2, 2, 64], [1, 9, 3, 3, 3, 3, 128]]


@pytest.mark.parametrize("interpolation", ["nearest", "lower", "higher", "midpoint", "linear"])
def test_wavelet_matrix_as_sorted_windows(monkeypatch, interpolation):
    import pyarrow as pa

    from cloister.functions import scans

    monkeypatch.setattr(scans, "PART_ROWS", 11)
    x = [None if i % 9 == 2 else math.inf if i % 31 == 5 else i * i % 23 / 2 for i in range(200)]
    got = scans.SlidingQuantile(8, 3, 0.7, interpolation).rows(pa.table({"__ord": range(200), "__halo": [i < 4 for i in range(200)], "__v": x}))
    assert got["__ord"].to_pylist() == [*range(4, 200)]
    for i, found in zip(got["__ord"].to_pylist(), got["__out"].to_pylist(), strict=True):
        w = sorted(y for y in x[max(0, i - 7) : i + 1] if y is not None)
        place = (len(w) - 1) * 0.7
        low, high = w[math.floor(place)], w[math.ceil(place)]
        want = {"nearest": w[math.floor(place + 0.5)], "lower": low, "higher": high, "midpoint": (low + high) / 2, "linear": low + (high - low) * (place - math.floor(place))}[interpolation]
        assert len(w) >= 3 and found == want or (want != want and found != found)
