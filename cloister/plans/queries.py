"""One query for each operator of guarded frames, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloister.frame import GuardedFrame
from cloister.functions.expr import all_columns, col, concat_str, count, lit, of_types, round_double, when
from cloister.policy import Action, Aggregation, AtLeastNOf, FalseRule, Policy, TrueRule, UserId
from cloister.session import GuardSession

Query = Callable[[SparkSession, str], DataFrame]

OPEN = Policy(TrueRule())


class Tables:
    """Guarded tables of a folder; sources need no aggregation unless a query says so."""

    def __init__(self, spark: SparkSession, sf_dir: str, policy: Policy = OPEN):
        self.session, self.sf_dir, self.policy = GuardSession(spark), sf_dir, policy

    def __call__(self, name: str, *order: str, policy: Policy | None = None, sanitized: tuple[str, ...] = ()) -> GuardedFrame:
        df = self.session.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.session.send_df(df, policy or self.policy, sanitized, name=f"{name}-{len(self.session.catalogue)}", order_by=order)


def _released(out: GuardedFrame | DataFrame) -> DataFrame:
    """A frame's rows as an analyst gets them: collected, judged by the policies of its tables, sanitised and fetched."""
    return out.session.release(out.collect().identifier) if isinstance(out, GuardedFrame) else out


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: _released(f(Tables(spark, sf_dir)))
        if sql:
            SQL[name] = sql
        return f

    return register


def r(e, n: int = 4):
    return e.round(n)


# Projection, filter, columns.


@query("SELECT l_orderkey, l_quantity * 2 AS twice, l_extendedprice FROM lineitem WHERE l_quantity > 45")
def select_project(t):
    return t("lineitem").filter(col("l_quantity") > 45).select("l_orderkey", (col("l_quantity") * 2).alias("twice"), "l_extendedprice")


@query("SELECT count(*) AS n, round(avg(l_quantity), 4) AS mean_qty, round(sum(l_extendedprice), 2) AS total FROM lineitem")
def global_agg(t):
    return t("lineitem").select(count().alias("n"), r(col("l_quantity").mean()).alias("mean_qty"), r(col("l_extendedprice").sum(), 2).alias("total"))


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND o_orderpriority IS NOT NULL")
def filter_chain(t):
    return t("orders").filter(col("o_totalprice") > 100000).filter((col("o_orderstatus") == "F") & (col("o_orderpriority") != None))  # noqa: E711


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)")
def filter_eq_max(t):
    return t("part").filter(col("p_retailprice") == col("p_retailprice").max()).select("p_partkey", "p_retailprice")


@query("SELECT p_partkey, round(p_retailprice - (SELECT avg(p_retailprice) FROM part), 4) AS centred FROM part")
def with_column_broadcast_aggregate(t):
    p = t("part").with_columns(r(col("p_retailprice") - col("p_retailprice").mean()).alias("centred"))
    return p.select("p_partkey", "centred")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band FROM orders")
def case_when(t):
    return t("orders").select("o_orderkey", when(col("o_totalprice") < 50000).then("low").when(col("o_totalprice") < 200000).then("mid").otherwise("high").alias("band"))


@query("SELECT o_orderkey, try_cast(o_orderpriority AS INT) AS bad, CAST(o_orderkey AS VARCHAR) AS key, try_cast(o_orderkey AS SMALLINT) AS small FROM orders")
def cast_try(t):
    return t("orders").select(
        "o_orderkey",
        col("o_orderpriority").cast("int", strict=False).alias("bad"),
        col("o_orderkey").cast("string").alias("key"),
        col("o_orderkey").cast("smallint", strict=False).alias("small"),
    )


def _gaps(t, *order):
    return t("orders", *order).select("o_orderkey", when(col("o_orderkey") % 7 != 0).then(col("o_totalprice")).otherwise(None).alias("price"), when(col("o_orderkey") % 5 != 0).then(col("o_orderstatus")).otherwise(None).alias("status"))


_GAPS = "g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders)"


@query(f"WITH {_GAPS} SELECT o_orderkey, coalesce(price, 100) AS price, coalesce(status, '100') AS status FROM g")
def fill_null(t):
    return _gaps(t).fill_null(100)


@query(f"WITH {_GAPS} SELECT * FROM g WHERE price IS NOT NULL AND status IS NOT NULL")
def drop_nulls(t):
    return _gaps(t).drop_nulls()


@query(f"WITH {_GAPS} SELECT status, round(sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS percent, count(*) - count(price) AS nulls FROM g GROUP BY status")
def percent_missing(t):
    return _gaps(t).groupby("status").agg(r(col("price").null_count() * 100 / col("price").count()).alias("percent"), col("price").null_count().alias("nulls"))


@query("SELECT l_orderkey, CASE WHEN l_quantity > 40 THEN 0.0 ELSE l_quantity END AS q FROM lineitem")
def fill_nan(t):
    f = t("lineitem").select("l_orderkey", when(col("l_quantity") > 40).then(float("nan")).otherwise(col("l_quantity")).alias("q"))
    return f.fill_nan(0.0)


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def drop_rename(t):
    return t("orders").drop("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").rename({"o_orderkey": "id", "o_totalprice": "price"})


@query("SELECT round(avg(p_retailprice), 4) AS p_retailprice_mean, round(avg(p_size), 4) AS p_size_mean, round(avg(p_partkey), 4) AS p_partkey_mean FROM part")
def column_selectors(t):
    from pyspark.sql import types as T

    return t("part").select(of_types(T.NumericType).mean().round(4).suffix("_mean"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus, range(o_orderkey % 4, 5, 2) AS up, range(3, o_orderkey % 4, -1) AS down FROM orders")
def column_positions(t):
    """Columns by what they are not and by place, and lists of numbers between two columns; some are empty."""
    from cloister.functions.expr import arange, exclude, nth

    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    rest, key = exclude("o_orderstatus", "o_orderdate"), col("o_orderkey") % 4
    return o.select(rest, nth(1), arange(key, 5, 2).alias("up"), arange(lit(3), key, -1).alias("down"))


@query("SELECT max(r_regionkey) AS r_regionkey, max(r_name) AS r_name FROM region")
def select_all_max(t):
    return t("region").select(all_columns().max())


@query(
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events),
    k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id) AS a,
      first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM s)
    SELECT k.event_id, round(CASE WHEN k.v IS NOT NULL THEN k.v ELSE x.v + (y.v - x.v) * (k.event_id - a) / (b - a) END, 4) AS v
    FROM k LEFT JOIN s x ON x.event_id = a LEFT JOIN s y ON y.event_id = b"""
)
def interpolate(t):
    f = t("events", "event_id").select("event_id", when(col("event_id") % 4 == 0).then(col("value")).otherwise(None).alias("v"))
    return f.order_by("event_id").interpolate().with_columns(col("v").round(4))


@query("SELECT n_nationkey, unnest([n_regionkey, n_nationkey]) AS part FROM nation UNION ALL SELECT n_nationkey, NULL FROM nation WHERE false")
def explode(t):
    return t("nation").select("n_nationkey", (lambda a, b: a._binary(b, F.array))(col("n_regionkey"), col("n_nationkey")).alias("part")).explode("part")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def unnest(t):
    from cloister.functions.expr import struct

    return t("nation").select("n_nationkey", struct("n_name", "n_regionkey").alias("s")).unnest("s")


@query("SELECT r_name, variable, value FROM (SELECT r_name, r_regionkey, r_regionkey * 10 AS tens FROM region) UNPIVOT (value FOR variable IN (r_regionkey, tens))")
def melt(t):
    return t("region").with_columns((col("r_regionkey") * 10).alias("tens")).melt("r_name")


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus_P FROM orders")
def to_dummies(t):
    return t("orders").select("o_orderkey", "o_orderstatus").to_dummies("o_orderstatus", ["F", "O", "P"])


@query("SELECT row_number() OVER (ORDER BY n_name) - 1 AS index, n_name, n_nationkey FROM nation")
def row_index(t):
    return t("nation", "n_name").select("n_name", "n_nationkey").order_by("n_name").with_row_count()


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 50 = 0")
def take_every(t):
    return t("events", "event_id").select("event_id", "user_id").take_every(50)


@query("SELECT lag(event_id, 3) OVER (ORDER BY event_id) AS event_id, lag(user_id, 3) OVER (ORDER BY event_id) AS user_id FROM events")
def shift(t):
    return t("events", "event_id").select("event_id", "user_id").shift(3).drop("__ord")


@query("SELECT coalesce(lead(event_id, 2) OVER (ORDER BY event_id), -1) AS event_id, coalesce(lead(user_id, 2) OVER (ORDER BY event_id), -1) AS user_id FROM events")
def shift_and_fill(t):
    return t("events", "event_id").select("event_id", "user_id").shift_and_fill(-2, -1).drop("__ord")


@query("SELECT DISTINCT event_type, user_id FROM events")
def unique_all(t):
    return t("events").select("event_type", "user_id").unique()


@query("SELECT arg_max(event_id, event_id) AS event_id, user_id FROM events GROUP BY user_id")
def unique_keep_last(t):
    return t("events", "event_id").select("event_id", "user_id").unique(subset="user_id", keep="last")


# Joins.


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return t("orders").join(t("customer"), left_on="o_custkey", right_on="c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


_RICH = "(SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000)"


def _rich(t):
    return t("customer").filter(col("c_acctbal") > 5000).select("c_custkey", "c_name")


@query(f"SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN {_RICH} c ON o_custkey = c_custkey")
def join_left(t):
    return t("orders").select("o_orderkey", "o_custkey").join(_rich(t), left_on="o_custkey", right_on="c_custkey", how="left")


@query("SELECT coalesce(s_nationkey, k) AS s_nationkey, s_name, n, total FROM supplier FULL JOIN (SELECT o_custkey % 40 AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON s_nationkey = k")
def join_outer(t):
    o = t("orders").groupby((col("o_custkey") % 40).alias("k")).agg(count().alias("n"), r(col("o_totalprice").sum(), 2).alias("total"))
    return t("supplier").select("s_nationkey", "s_name").join(o, left_on="s_nationkey", right_on="k", how="outer")


@query(f"SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM {_RICH})")
def join_semi(t):
    return t("orders").join(_rich(t), left_on="o_custkey", right_on="c_custkey", how="semi").select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {_RICH})")
def join_anti(t):
    return t("orders").join(_rich(t), left_on="o_custkey", right_on="c_custkey", how="anti").select("o_orderkey")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(t):
    return t("region").select("r_name").join(t("nation").select("n_name"), how="cross")


@query("SELECT a.n_name, b.n_name AS n_name_right, a.n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_suffix(t):
    a = t("nation").select("n_name", "n_regionkey")
    return a.join(t("nation").select("n_name", "n_regionkey"), on="n_regionkey")


@query("SELECT e.event_id, s.s_name FROM events e JOIN supplier s ON e.user_id + 1 = s.s_suppkey * 2 - 1")
def join_on_expressions(t):
    return t("events").join(t("supplier"), left_on=(col("user_id") + 1), right_on=(col("s_suppkey") * 2 - 1)).select("event_id", "s_name")


@query(
    """WITH a AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS k, n_name FROM nation),
    b AS (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END AS k, r_name FROM region)
    SELECT a.k, n_name, r_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k"""
)
def join_null_keys(t):
    a = t("nation").select(when(col("n_nationkey") % 4 == 0).then(None).otherwise(col("n_regionkey")).alias("k"), "n_name")
    b = t("region").select(when(col("r_regionkey") == 0).then(None).otherwise(col("r_regionkey")).alias("k"), "r_name")
    return a.join(b, on="k", join_nulls=True)


def _purchases_views(t):
    e = t("events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.filter(col("event_type") == "purchase").select("event_id", "ts", "user_id"), e.filter(col("event_type") == "view").select(col("event_id").alias("view_id"), "ts", "user_id")


_PV = "p AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS view_id, ts, user_id FROM events WHERE event_type = 'view')"


@query(f"WITH {_PV} SELECT p.event_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_backward(t):
    p, v = _purchases_views(t)
    return p.join_asof(v, on="ts", by="user_id").select("event_id", "view_id")


@query(f"WITH {_PV} SELECT p.event_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts")
def asof_forward(t):
    p, v = _purchases_views(t)
    return p.join_asof(v, on="ts", by="user_id", strategy="forward").select("event_id", "view_id")


@query(f"WITH {_PV} SELECT p.event_id, CASE WHEN p.ts - v.ts <= INTERVAL 6 HOUR THEN v.view_id END AS view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_tolerance(t):
    p, v = _purchases_views(t)
    return p.join_asof(v, on="ts", by="user_id", tolerance="6h").select("event_id", "view_id")


@query(f"WITH {_PV} SELECT p.event_id, v.view_id FROM p ASOF LEFT JOIN v ON p.ts >= v.ts")
def asof_without_key(t):
    p, v = _purchases_views(t)
    return p.join_asof(v.drop("user_id"), on="ts").select("event_id", "view_id")


# Aggregation.


@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS mean_qty FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag")
def group_mean_sort(t):
    return t("lineitem").groupby("l_returnflag").agg(r(col("l_quantity").mean()).alias("mean_qty")).sort("l_returnflag")


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS disc, count(*) AS n,
    min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, round(stddev_samp(l_quantity), 4) AS sd, round(var_samp(l_quantity), 4) AS va, median(l_quantity) AS med,
    count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def pricing_summary(t):
    f = t("lineitem").filter(col("l_shipdate") <= F_lit_timestamp("1998-09-02"))
    return f.groupby("l_returnflag", "l_linestatus").agg(
        col("l_quantity").sum().alias("sum_qty"),
        r((col("l_extendedprice") * (1 - col("l_discount"))).sum(), 2).alias("revenue"),
        r(col("l_discount").mean()).alias("disc"),
        count().alias("n"),
        col("l_shipdate").min().alias("first_ship"),
        col("l_shipdate").max().alias("last_ship"),
        r(col("l_quantity").std()).alias("sd"),
        r(col("l_quantity").var()).alias("va"),
        col("l_quantity").median().alias("med"),
        col("l_suppkey").n_unique().cast("long").alias("suppliers"),
    )


def F_lit_timestamp(text: str):
    return lit(text).cast("timestamp_ntz")


@query("SELECT CAST(month(o_orderdate) AS INT) AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def group_by_expression(t):
    return t("orders").groupby(col("o_orderdate").dt.month().alias("month")).agg(r(col("o_totalprice").sum(), 2).alias("total"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE i <= 3")
def group_head(t):
    return t("events", "event_id").select("event_id", "user_id").groupby("user_id").head(3)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) WHERE i <= 3")
def group_tail(t):
    return t("events", "event_id").select("event_id", "user_id").groupby("user_id").tail(3)


@query(
    """SELECT user_id, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, count(DISTINCT event_type) AS kinds,
    round(sum(CASE WHEN event_type = 'purchase' THEN value END), 4) AS bought FROM events GROUP BY user_id"""
)
def group_first_last_filter(t):
    return t("events", "event_id").groupby("user_id").agg(
        col("value").first().alias("first_value"), col("value").last().alias("last_value"), col("event_type").n_unique().cast("long").alias("kinds"), r(col("value").filter(col("event_type") == "purchase").sum()).alias("bought")
    )


_NEAREST = "list_sort(list({c}))[CAST(floor((count({c}) - 1) * {q} + 0.5) AS INT) + 1]"


@query(f"SELECT l_returnflag, {_NEAREST.format(c='l_extendedprice', q=0.25)} AS q25, {_NEAREST.format(c='l_extendedprice', q=0.9)} AS q90 FROM lineitem GROUP BY l_returnflag")
def quantile_nearest(t):
    return t("lineitem").groupby("l_returnflag").agg(col("l_extendedprice").quantile(0.25).alias("q25"), col("l_extendedprice").quantile(0.9).alias("q90"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25 FROM lineitem GROUP BY l_returnflag")
def quantile_linear(t):
    return t("lineitem").groupby("l_returnflag").agg(r(col("l_extendedprice").quantile(0.25, "linear")).alias("q25"))


@query("SELECT sum(p_retailprice).round(2) AS p_retailprice, sum(p_size)::DOUBLE AS p_size FROM part")
def frame_sum(t):
    return t("part").select("p_retailprice", col("p_size").cast("double")).sum().select(r(col("p_retailprice"), 2), "p_size")


@query(
    """WITH s AS (SELECT 'count' AS "describe", count(*)::DOUBLE AS p_size, count(*)::DOUBLE AS p_retailprice, count(*)::VARCHAR AS p_brand FROM part
    UNION ALL SELECT 'null_count', 0, 0, '0' UNION ALL SELECT 'mean', avg(p_size), avg(p_retailprice), NULL FROM part
    UNION ALL SELECT 'std', stddev_samp(p_size), stddev_samp(p_retailprice), NULL FROM part UNION ALL SELECT 'min', min(p_size), min(p_retailprice), min(p_brand) FROM part
    UNION ALL SELECT 'max', max(p_size), max(p_retailprice), max(p_brand) FROM part UNION ALL SELECT 'median', median(p_size), median(p_retailprice), NULL FROM part)
    SELECT "describe", round(p_size, 4) AS p_size, round(p_retailprice, 4) AS p_retailprice, p_brand FROM s"""
)
def describe(t):
    """Three columns of ``part``, text among them."""
    return t("part").select("p_size", "p_retailprice", "p_brand").describe().with_columns(r(col("p_size")), r(col("p_retailprice")))


def _over_frame(t):
    return t("orders", "o_orderkey").select("o_totalprice", col("o_custkey").cast("double"))


_PAIR = "round({f}(o_totalprice{a}), 4) AS o_totalprice, round({f}(o_custkey::DOUBLE{a}), 4) AS o_custkey FROM orders"
_FRAME = {"min": "min", "max": "max", "mean": "avg", "median": "median", "std": "stddev_samp", "var": "var_samp"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, {_PAIR.format(f=f, a='')}" for n, f in _FRAME.items()) + " UNION ALL SELECT 'quantile', " + _PAIR.format(f="quantile_cont", a=", 0.3"))
def frame_aggregates(t):
    """Aggregates of all columns of a frame."""
    f = _over_frame(t)
    found = [(n, getattr(f, n)()) for n in _FRAME] + [("quantile", f.quantile(0.3, "linear"))]
    parts = [x.select(lit(n).alias("name"), r(col("o_totalprice")), r(col("o_custkey"))) for n, x in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.vstack(p)
    return out


@query(f"WITH {_GAPS} SELECT 0 AS o_orderkey, count(*) - count(price) AS price, count(*) - count(status) AS status FROM g")
def frame_null_count(t):
    return _gaps(t).null_count()


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1) UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1)")
def frame_first_last(t):
    f = t("orders", "o_orderkey").select("o_orderkey", "o_totalprice").order_by("o_orderkey")
    return f.first().vstack(f.last())


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def partition_by(t):
    """One frame for each status, aggregated each and put together."""
    parts = t("orders").partition_by("o_orderstatus")
    found = [f.select(lit(k).alias("o_orderstatus"), count().alias("n"), r(col("o_totalprice").sum(), 2).alias("total")) for k, f in sorted(parts.items())]
    out = found[0]
    for p in found[1:]:
        out = out.vstack(p)
    return out


@query("SELECT event_type AS value, count(*) AS counts FROM events GROUP BY event_type")
def value_counts_expr(t):
    return t("events").select(col("event_type").value_counts()).unnest("event_type")


@query("SELECT count(*) AS user_id FROM events GROUP BY events.user_id")
def unique_counts(t):
    return t("events", "event_id").select(col("user_id").unique_counts())


@query("SELECT i AS value FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE value > 90")
def arg_where(t):
    return t("events", "event_id").select((col("value") > 90).arg_where())


@query("SELECT event_type, list(i ORDER BY i) AS places FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY event_type")
def group_places(t):
    return t("events", "event_id").groupby("event_type").agg(col("event_id").groups().alias("places"))


@query("SELECT * FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS i, row_number() OVER (ORDER BY event_id DESC) AS j FROM events) WHERE i IN (0, 7, 70) OR j = 2")
def frame_rows(t):
    e = t("events", "event_id").select("event_id", "user_id").order_by("event_id")
    n = e.with_row_count("i").rows([0, 7, 70, -2])
    back = e.sort("event_id", reverse=True).with_row_count("j").select("event_id", (col("j") + 1).alias("j"))
    return n.join(back, on="event_id")


@query("SELECT p_partkey * 2 + p_partkey AS p_partkey, p_size * 2 + p_size AS p_size, p_retailprice * 2 + p_retailprice AS p_retailprice, p_brand FROM part")
def frame_arithmetic(t):
    """A frame times a number, and its sum with another frame, by place."""
    p = t("part", "p_partkey").select("p_partkey", "p_size", "p_retailprice", "p_brand").order_by("p_partkey")
    return p * 2 + p


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS o_totalprice FROM orders")
def zip_with(t):
    return t("orders").select("o_orderkey", col("o_totalprice").zip_with(col("o_orderstatus") == "F", -col("o_totalprice")))


@query(
    """SELECT l_returnflag, round(kurtosis_pop(l_quantity), 4) AS kurt,
    round((avg(l_quantity ** 3) - 3 * avg(l_quantity) * avg(l_quantity ** 2) + 2 * avg(l_quantity) ** 3) / stddev_pop(l_quantity) ** 3, 4) + 0.0 AS skew,
    round(sum(l_quantity * l_discount), 2) AS dotted FROM lineitem GROUP BY l_returnflag"""
)
def skew_kurt_dot(t):
    q = col("l_quantity")
    return t("lineitem").groupby("l_returnflag").agg(r(q.kurtosis()).alias("kurt"), (r(q.skew()) + 0.0).alias("skew"), r(q.dot(col("l_discount")), 2).alias("dotted"))


@query("SELECT n_regionkey, product(1.0 + n_nationkey) AS prod FROM nation GROUP BY n_regionkey")
def product(t):
    return t("nation").groupby("n_regionkey").agg((col("n_nationkey") + 1.0).product().alias("prod"))


@query("SELECT p_brand, arg_min(p_size, (-n, p_size)) AS common FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def mode(t):
    return t("part").groupby("p_brand").agg(col("p_size").mode().alias("common"))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def value_counts(t):
    return t("events").groupby("event_type").count()


@query(
    """SELECT user_id, list(event_id ORDER BY event_id)[1:3] AS head, list(event_id ORDER BY event_id)[-2:] AS tail, list(event_id ORDER BY event_id DESC)[1] AS newest,
    [list(event_id ORDER BY event_id)[1], list(event_id ORDER BY event_id)[3]] AS taken, list(event_id ORDER BY value DESC)[1] AS top, round(avg((value - m) ** 3), 2) AS third
    FROM events JOIN (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id"""
)
def group_lists(t):
    e = col("event_id")
    return t("events", "event_id").groupby("user_id").agg(
        e.head(3).alias("head"), e.tail(2).alias("tail"), e.reverse().arr.first().alias("newest"), e.take([0, 2]).alias("taken"), e.sort_by(col("value"), reverse=True).arr.first().alias("top"), r(_third(col("value")), 2).alias("third")
    )


def _third(v):
    """The third central moment from raw ones, which one aggregation gives."""
    m = v.mean()
    return (v**3).mean() - 3 * m * (v**2).mean() + 2 * m**3


@query("SELECT event_id, user_id FROM events")
def shuffle_rows(t):
    return t("events").select("event_id", "user_id").shuffle(3)


@query()
def sample_rows(t):
    return t("events").select("event_id", "user_id").sample(0.1, seed=3)


# Windows.


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 4) AS off, count(*) OVER (PARTITION BY user_id, event_type) AS peers FROM events")
def over_partition(t):
    return t("events").select("event_id", r(col("value") - col("value").mean().over("user_id")).alias("off"), count().over("user_id", "event_type").alias("peers"))


@query(
    """SELECT event_id, rank() OVER w AS low, dense_rank() OVER w AS dense, rank() OVER w + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2.0 AS mean,
    rank() OVER w + count(*) OVER (PARTITION BY user_id, event_type) - 1 AS high, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS ordinal
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)"""
)
def rank_all(t):
    ranks = {"low": "min", "dense": "dense", "mean": "average", "high": "max", "ordinal": "ordinal"}
    return t("events", "event_id").select("event_id", *[col("event_type").rank(m).over("user_id").alias(n) for n, m in ranks.items()])


@query(
    """SELECT event_id, round(sum(value) OVER w, 4) AS cs, min(value) OVER w AS cmin, max(value) OVER w AS cmax, row_number() OVER w - 1 AS cc
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def cum_all(t):
    v = col("value")
    return t("events", "event_id").select("event_id", r(v.cumsum().over("user_id")).alias("cs"), v.cummin().over("user_id").alias("cmin"), v.cummax().over("user_id").alias("cmax"), v.cumcount().over("user_id").alias("cc"))


@query(
    """SELECT event_id, CASE WHEN count(*) OVER w >= 5 THEN round(avg(value) OVER w, 4) END AS mean5, CASE WHEN count(*) OVER w >= 5 THEN round(stddev_samp(value) OVER w, 4) END AS sd5,
    CASE WHEN count(*) OVER w >= 5 THEN median(value) OVER w END AS med5, max(value) OVER w AS max1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
)
def rolling_rows(t):
    v = col("value")
    return t("events", "event_id").select(
        "event_id", r(v.rolling_mean(5).over("user_id")).alias("mean5"), r(v.rolling_std(5).over("user_id")).alias("sd5"), v.rolling_median(5).over("user_id").alias("med5"), v.rolling_max(5, 1).over("user_id").alias("max1")
    )


@query("SELECT event_id, round(value - lag(value) OVER w, 4) AS d, lag(value, 2) OVER w AS s2, coalesce(lead(value) OVER w, -1) AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def diff_shift(t):
    v = col("value")
    return t("events", "event_id").select("event_id", r(v.diff().over("user_id")).alias("d"), v.shift(2).over("user_id").alias("s2"), v.shift(-1, -1.0).over("user_id").alias("nxt"))


@query(
    """WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
    SELECT a.event_id, round(sum(b.value * 0.5 ** (a.i - b.i)) / sum(0.5 ** (a.i - b.i)), 4) AS ewm FROM o a JOIN o b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id"""
)
def ewm_mean(t):
    return t("events", "event_id").select("event_id", r(col("value").ewm_mean(0.5).over("user_id")).alias("ewm"))


@query(
    """WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    w AS (SELECT a.event_id, sum(b.value * 0.5 ** (a.i - b.i)) / sum(0.5 ** (a.i - b.i)) AS m, sum(b.value * b.value * 0.5 ** (a.i - b.i)) / sum(0.5 ** (a.i - b.i)) AS q
      FROM o a JOIN o b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id)
    SELECT event_id, round(greatest(q - m * m, 0), 2) + 0.0 AS va, round(sqrt(greatest(q - m * m, 0)), 2) + 0.0 AS sd FROM w"""
)
def ewm_var_std(t):
    v = col("value")
    return t("events", "event_id").select("event_id", (v.ewm_var(0.5).over("user_id").map(lambda x: F.greatest(x, F.lit(0.0))).round(2) + 0.0).alias("va"), (v.ewm_std(0.5).over("user_id").round(2) + 0.0).alias("sd"))


@query("SELECT event_id, round(exp(sum(ln(1 + value / 1e6)) OVER (PARTITION BY user_id ORDER BY event_id)), 6) AS grown FROM events")
def cumprod(t):
    grown = (col("value") / 1e6 + 1).cumprod().over("user_id")
    return t("events", "event_id").select("event_id", grown.round(6).alias("grown"))


@query("SELECT event_id, max(value) OVER w - min(value) OVER w AS spread FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def cumulative_eval(t):
    return t("events", "event_id").select("event_id", col("value").cumulative_eval(lambda a: F.array_max(a) - F.array_min(a)).over("user_id").alias("spread"))


_LINES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_BY_LINE = f"ORDER BY {', '.join(_LINES)}"


@query(
    f"""SELECT {', '.join(_LINES)}, round(quantile_cont(l_extendedprice, 0.5) OVER w, 4) AS med, CASE WHEN count(*) OVER w >= 5000 THEN round(quantile_cont(l_quantity, 0.9) OVER w, 4) END AS high
    FROM lineitem WINDOW w AS ({_BY_LINE} ROWS BETWEEN 9999 PRECEDING AND CURRENT ROW)"""
)
def rolling_long(t):
    """Medians and quantiles of the last 10,000 rows, by blocks of rows."""
    price, quantity = col("l_extendedprice"), col("l_quantity")
    return t("lineitem", *_LINES).select(*_LINES, r(price.rolling_median(10_000, 1)).alias("med"), r(quantity.rolling_quantile(0.9, 10_000, "linear", 5000)).alias("high"))


@query(
    f"""WITH p AS (SELECT *, max(l_extendedprice) OVER w - l_extendedprice AS fall, max(l_extendedprice) OVER f - l_extendedprice AS own FROM lineitem
        WINDOW w AS ({_BY_LINE} ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY l_returnflag {_BY_LINE} ROWS UNBOUNDED PRECEDING))
    SELECT {', '.join(_LINES)}, round(max(fall) OVER w, 4) AS fall, round(max(own) OVER f, 4) AS own FROM p WINDOW w AS ({_BY_LINE} ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY l_returnflag {_BY_LINE} ROWS UNBOUNDED PRECEDING)"""
)
def cumulative_fold(t):
    """The largest fall of the price from an earlier peak so far, over all rows and within groups: a state (peak, lowest, fall) that merges over blocks."""

    def step(state, x):
        peak, low, fall = state
        peak = max(peak, x)
        return peak, min(low, x), max(fall, peak - x)

    def merge(a, b):
        return max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2], a[0] - b[1])

    fall = col("l_extendedprice").cumulative_fold((float("-inf"), float("inf"), 0.0), step, merge, lambda state: state[2])
    return t("lineitem", *_LINES).select(*_LINES, r(fall).alias("fall"), r(fall.over("l_returnflag")).alias("own"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 2, 6)) AS twice FROM embeddings")
def list_eval(t):
    return t("embeddings").select("vec_id", col("embedding").arr.eval(lambda x: round_double(x.cast("double") * 2, 6)).alias("twice"))


_W = "(ORDER BY event_id)"


@query(
    f"""SELECT event_id, round(value - lag(value, 2) OVER {_W}, 4) AS d2, lead(value) OVER {_W} AS nxt, round(sum(value) OVER {_W}, 2) AS cs, min(value) OVER {_W} AS cmin, max(value) OVER {_W} AS cmax,
    row_number() OVER {_W} - 1 AS cc, CASE WHEN row_number() OVER {_W} >= 7 THEN round(avg(value) OVER r7, 4) END AS mean7, max(value) OVER r7 AS max7, CASE WHEN row_number() OVER {_W} >= 7 THEN median(value) OVER r7 END AS med7
    FROM events WINDOW r7 AS (ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
)
def frame_windows(t):
    """Order-dependent functions over the whole frame, without ``over``."""
    v = col("value")
    return t("events", "event_id").select(
        "event_id", r(v.diff(2)).alias("d2"), v.shift(-1).alias("nxt"), r(v.cumsum(), 2).alias("cs"), v.cummin().alias("cmin"), v.cummax().alias("cmax"), v.cumcount().alias("cc"),
        r(v.rolling_mean(7)).alias("mean7"), v.rolling_max(7, 1).alias("max7"), v.rolling_median(7).alias("med7"),
    )


@query(
    """SELECT event_id, rank() OVER (ORDER BY user_id) AS low, dense_rank() OVER (ORDER BY user_id) AS dense, rank() OVER (ORDER BY user_id) + count(*) OVER (PARTITION BY user_id) - 1 AS high,
    rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0 AS mean, row_number() OVER (ORDER BY user_id, event_id) AS ordinal, rank() OVER (ORDER BY user_id DESC) AS down FROM events"""
)
def frame_rank(t):
    """Ranks over the whole frame."""
    ranks = {"low": "min", "dense": "dense", "mean": "average", "high": "max", "ordinal": "ordinal"}
    u = col("user_id")
    return t("events", "event_id").select("event_id", *[u.rank(m).alias(n) for n, m in ranks.items()], u.rank("min", reverse=True).alias("down"))


@query(
    """WITH g AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value END AS v FROM events)
    SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS fwd, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bwd FROM g"""
)
def frame_fills(t):
    e = t("events", "event_id").select("event_id", when(col("event_id") % 5 == 0).then(col("value")).otherwise(None).alias("v"))
    return e.order_by("event_id").select("event_id", col("v").forward_fill().alias("fwd"), col("v").backward_fill().alias("bwd"))


@query("SELECT ts, round(sum(value) OVER w, 3) AS total, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999 seconds' PRECEDING AND CURRENT ROW)")
def rolling_time_frame(t):
    """Time windows over the whole frame, without ``by``."""
    return t("events").groupby_rolling("ts", "6h").agg(r(col("value").sum(), 3).alias("total"), count().alias("n"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1 AS is_first FROM events")
def is_first(t):
    return t("events", "event_id").select("event_id", col("event_type").is_first().alias("is_first"))


@query(
    """SELECT user_id, ts, round(sum(value) OVER w, 4) AS total, count(*) OVER w AS n FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '172799.999999 seconds' PRECEDING AND CURRENT ROW)"""
)
def rolling_time(t):
    return t("events").groupby_rolling("ts", "2d", by="user_id").agg(r(col("value").sum()).alias("total"), count().alias("n"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS ts, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def dynamic_tumble(t):
    return t("events").groupby_dynamic("ts", "1d", by="user_id").agg(r(col("value").sum()).alias("total"), count().alias("n"))


@query("SELECT b AS ts, round(sum(value), 2) AS total, count(*) AS n FROM (SELECT value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY b")
def dynamic_slide(t):
    return t("events").groupby_dynamic("ts", "1h", "2h").agg(r(col("value").sum(), 2).alias("total"), count().alias("n"))


@query("SELECT date_trunc('month', ts) AS ts, count(*) AS n FROM events GROUP BY 1")
def dynamic_month(t):
    return t("events").groupby_dynamic("ts", "1mo").agg(count().alias("n"))


_DAY = "INTERVAL 1 DAY"


def _closed(low: str, high: str) -> str:
    return f"""WITH b AS (SELECT unnest(generate_series(date_trunc('day', min(ts)) - INTERVAL 3 DAY, max(ts) + {_DAY}, {_DAY})) + INTERVAL 6 HOUR AS s FROM events)
    SELECT s AS ts, user_id, count(*) AS n, round(sum(value), 3) AS total FROM b JOIN (SELECT date_trunc('hour', ts) AS ts, user_id, value FROM events) e ON e.ts {low} s AND e.ts {high} s + INTERVAL 2 DAY GROUP BY ALL"""


def _dynamic(t, closed):
    hours = t("events").with_columns(col("ts").dt.truncate("1h").cast("timestamp_ntz").alias("ts"))
    return hours.groupby_dynamic("ts", "1d", "2d", "6h", closed=closed, by="user_id").agg(count().alias("n"), r(col("value").sum(), 3).alias("total"))


@query(_closed(">=", "<"))
def dynamic_left(t):
    """Windows of two days that start each day at six, closed on the left."""
    return _dynamic(t, "left")


@query(_closed(">", "<="))
def dynamic_right(t):
    return _dynamic(t, "right")


@query(_closed(">=", "<="))
def dynamic_both(t):
    return _dynamic(t, "both")


@query(_closed(">", "<"))
def dynamic_none(t):
    return _dynamic(t, "none")


@query(
    """WITH b AS (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)) - INTERVAL 4 MONTH, max(o_orderdate) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) + INTERVAL 5 DAY AS s FROM orders)
    SELECT s AS o_orderdate, s AS _lower_boundary, s + INTERVAL 3 MONTH AS _upper_boundary, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM b JOIN orders o ON o.o_orderdate >= s AND o.o_orderdate < s + INTERVAL 3 MONTH GROUP BY s"""
)
def dynamic_calendar(t):
    """Quarters that start on the sixth of each month."""
    return t("orders").groupby_dynamic("o_orderdate", "1mo", "3mo", "5d", include_boundaries=True).agg(count().alias("n"), r(col("o_totalprice").sum(), 2).alias("total"))


@query("SELECT min(ts) AS ts, count(*) AS n FROM events GROUP BY time_bucket(INTERVAL 12 HOUR, ts)")
def dynamic_first_times(t):
    return t("events").groupby_dynamic("ts", "12h", truncate=False).agg(count().alias("n"))


# Sort, limit, set operations.


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def topk(t):
    return t("events").select("event_id", "value").sort(["value", "event_id"], reverse=[True, False]).limit(20)


@query("SELECT event_id, value FROM events ORDER BY event_id OFFSET 100 LIMIT 30")
def sort_slice(t):
    return t("events").select("event_id", "value").sort("event_id").slice(100, 30)


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 7")
def tail(t):
    return t("events").select("event_id").sort("event_id").tail(7)


@query("SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 4")
def reverse_head(t):
    return t("nation").select("n_name").sort("n_name").reverse().head(4)


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def vstack(t):
    a = t("nation")
    return a.select("n_nationkey", "n_name").vstack(a.filter(col("n_regionkey") == 1).select("n_nationkey", "n_name"))


@query("SELECT n_name, n_regionkey, NULL::INT AS r_regionkey FROM nation UNION ALL SELECT NULL, NULL, r_regionkey FROM region")
def concat_diagonal(t):
    return t("nation").select("n_name", "n_regionkey").concat_diagonal(t("region").select("r_regionkey"))


@query("SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation) LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region) USING (i)")
def concat_horizontal(t):
    return t("nation").select("n_name").sort("n_name").concat_horizontal(t("region").select("r_name").sort("r_name"))


# Scalar functions.


@query(
    """SELECT p_partkey, contains(p_type, 'e') AS has, starts_with(p_name, 'a') AS sw, upper(p_name) AS up, length(p_name) AS n, replace(p_brand, '#', '-') AS rep,
    substr(p_name, 2, 3) AS mid, regexp_extract(p_brand, '([0-9]+)', 1) AS num, p_brand || '/' || p_type AS both, lpad(p_size::VARCHAR, 5, '0') AS z, lower(hex(p_brand)) AS hx FROM part"""
)
def str_funcs(t):
    n, b = col("p_name"), col("p_brand")
    return t("part").select(
        "p_partkey", col("p_type").str.contains("e").alias("has"), n.str.starts_with("a").alias("sw"), n.str.to_uppercase().alias("up"), n.str.n_chars().cast("long").alias("n"),
        b.str.replace_all("#", "-").alias("rep"), n.str.slice(1, 3).alias("mid"), b.str.extract("([0-9]+)").alias("num"), concat_str(["p_brand", "p_type"], "/").alias("both"),
        col("p_size").cast("string").str.zfill(5).alias("z"), b.str.encode("hex").alias("hx"),
    )


@query(
    """SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, hour(o_orderdate)::INT AS h, (isodow(o_orderdate) - 1)::INT AS wd,
    week(o_orderdate)::INT AS wk, dayofyear(o_orderdate)::INT AS od, date_trunc('month', o_orderdate) AS tm, epoch(o_orderdate)::BIGINT AS ep, o_orderdate + INTERVAL 1 MONTH AS plus FROM orders"""
)
def date_parts(t):
    d = col("o_orderdate").dt
    return t("orders").select(
        "o_orderkey", d.year().alias("y"), d.month().alias("m"), d.day().alias("d"), d.hour().alias("h"), d.weekday().alias("wd"), d.week().alias("wk"), d.ordinal_day().alias("od"),
        d.truncate("1mo").cast("timestamp_ntz").alias("tm"), d.epoch().alias("ep"), d.offset_by("1mo").alias("plus"),
    )


@query("SELECT o_orderkey, o_orderdate::DATE AS d, NULL::DATE AS bad FROM orders")
def strptime(t):
    text = col("o_orderdate").dt.strftime("%m/%d/%Y")
    return t("orders").select("o_orderkey", text.str.strptime("date", "%m/%d/%Y").alias("d"), col("o_orderpriority").str.strptime("date", "%m/%d/%Y", strict=False).alias("bad"))


@query("SELECT event_id, round(ln(abs(value) + 1), 6) AS l, round(sqrt(abs(value)), 6) AS s, floor(value)::BIGINT AS f, ceil(value)::BIGINT AS c, round(value ** 2, 4) AS p, greatest(5, least(50, value)) AS cl, sign(value)::DOUBLE AS sg FROM events")
def math_funcs(t):
    v = col("value")
    return t("events").select("event_id", (v.abs() + 1).log().round(6).alias("l"), v.abs().sqrt().round(6).alias("s"), v.floor().alias("f"), v.ceil().alias("c"), r(v**2).alias("p"), v.clip(5, 50).alias("cl"), v.sign().alias("sg"))


@query(
    """SELECT vec_id, len(embedding)::INT AS n, list_max(embedding) AS mx, embedding[1] AS head, embedding[-1] AS tail, list_sort(embedding)[2] AS second,
    round(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE), 'sum'), 4) AS total FROM embeddings"""
)
def list_funcs(t):
    e = col("embedding").arr
    return t("embeddings").select("vec_id", e.lengths().alias("n"), e.max().alias("mx"), e.first().alias("head"), e.last().alias("tail"), e.sort().arr.get(1).alias("second"), r(e.sum()).alias("total"))


# Scaling.

_SCALE = "SELECT p_partkey, round({f}, 6) AS p_retailprice FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, avg(p_retailprice) AS mu, stddev_samp(p_retailprice) AS sd, median(p_retailprice) AS med, {q25} AS q1, {q75} AS q3 FROM part)".replace("{q25}", _NEAREST.format(c="p_retailprice", q=0.25)).replace("{q75}", _NEAREST.format(c="p_retailprice", q=0.75))


def _scaled(f):
    return f.select("p_partkey", col("p_retailprice").round(6))


@query(_SCALE.replace("{f}", "(p_retailprice - lo) / (hi - lo)"))
def scale_minmax(t):
    return _scaled(t("part").minmax_scale("p_retailprice"))


@query(_SCALE.replace("{f}", "(p_retailprice - mu) / (hi - lo)"))
def scale_mean(t):
    return _scaled(t("part").mean_scale("p_retailprice"))


@query(_SCALE.replace("{f}", "p_retailprice / hi"))
def scale_maxabs(t):
    return _scaled(t("part").max_abs_scale(["p_retailprice"]))


@query(_SCALE.replace("{f}", "(p_retailprice - mu) / sd"))
def scale_zscore(t):
    return _scaled(t("part").zscore_scale("p_retailprice"))


@query(_SCALE.replace("{f}", "(p_retailprice - med) / (q3 - q1)"))
def scale_robust(t):
    return _scaled(t("part").median_quantile_scale("p_retailprice"))


# Plot tables.


@query("SELECT floor(l_quantity / 5) * 5 AS bin, count(*) AS count FROM lineitem GROUP BY 1")
def hist1d(t):
    return t("lineitem").histplot("l_quantity", bins=5)


@query("SELECT floor(l_quantity / 10) * 10 AS bin, l_returnflag, count(*) AS count FROM lineitem GROUP BY 1, 2")
def hist2d(t):
    return t("lineitem").histplot("l_quantity", "l_returnflag", 10)


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 1, 2")
def bar_hue(t):
    return t("lineitem").barplot("l_returnflag", "l_quantity", "l_linestatus").with_columns(r(col("value")))


@query(f"SELECT l_returnflag, min(l_quantity) AS min, {_NEAREST.format(c='l_quantity', q=0.25)} AS q25, median(l_quantity) AS median, {_NEAREST.format(c='l_quantity', q=0.75)} AS q75, max(l_quantity) AS max, {_NEAREST.format(c='l_quantity', q=0.75)} - {_NEAREST.format(c='l_quantity', q=0.25)} AS iqr FROM lineitem GROUP BY 1")
def box_group(t):
    return t("lineitem").boxplot("l_quantity", "l_returnflag")


@query("SELECT label, round(n * 100.0 / sum(n) OVER (), 4) AS percent FROM (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)")
def pie(t):
    return t("events").groupby("event_type").count().pieplot("count", "event_type").with_columns(r(col("percent")))


@query("SELECT l_linestatus, l_returnflag, floor(l_quantity / 10) * 10 AS bin, count(*) AS count FROM lineitem GROUP BY 1, 2, 3")
def facet_hist(t):
    return t("lineitem").facet("l_linestatus", "l_returnflag").histplot("l_quantity", 10)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def scatter_hue(t):
    return t("orders").scatterplot("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT o_orderdate, o_totalprice, o_orderstatus, o_orderpriority FROM orders")
def lineplot(t):
    return t("orders").lineplot("o_orderdate", "o_totalprice", hue="o_orderstatus", style="o_orderpriority")


@query("SELECT DISTINCT p_brand FROM part")
def unique_values(t):
    return t("part")._get_unique_values("p_brand")


# User functions.


@query("SELECT p_partkey, floor(p_retailprice / 25) * 25 AS p_retailprice FROM part")
def udf_bins(t):
    from cloister.functions.udf import ApplyBins

    return t("part").apply_udf("p_retailprice", ApplyBins(25)).select("p_partkey", "p_retailprice")


@query("SELECT c_custkey, abs(c_acctbal) AS c_acctbal FROM customer")
def udf_abs(t):
    from cloister.functions.udf import ApplyAbs

    return t("customer").apply_udf(["c_acctbal"], ApplyAbs()).select("c_custkey", "c_acctbal")


# Guards.


@query("SELECT 'lineitem' AS source, min(n) AS agg_size FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus)")
def guard_agg_size(t):
    f = t("lineitem").groupby("l_returnflag", "l_linestatus").agg(col("l_tax").mean())
    (stats,) = f.provenance().values()
    return t.session.spark.createDataFrame([("lineitem", int(stats.agg_size))], "source string, agg_size long")


@query("SELECT max(n) AS join_scaling FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def guard_join_scaling(t):
    o = t("orders")
    f = o.join(t("lineitem"), left_on="o_orderkey", right_on="l_orderkey")
    stats = f.provenance()[o.identifier]
    return t.session.spark.createDataFrame([(int(stats.join_scaling),)], "join_scaling long")


@query("SELECT c_custkey, NULL::VARCHAR AS c_name, NULL::VARCHAR AS who, c_acctbal FROM customer")
def sanitize_alias(t):
    c = t("customer", sanitized=("c_name",))
    return c.select("c_custkey", "c_name", col("c_name").alias("who"), "c_acctbal").fetch()


@query("SELECT c_mktsegment, NULL::VARCHAR AS low, NULL::VARCHAR AS top, NULL::VARCHAR AS usual, NULL::INT AS longest, count(DISTINCT c_name) AS names, NULL::DOUBLE AS most, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
def sanitize_aggregates(t):
    """Aggregates that show a value of a sensitive column are null under any name; counts and sums are not."""
    n, b = col("c_name"), col("c_acctbal")
    return t("customer", "c_custkey", sanitized=("c_name", "c_acctbal")).groupby("c_mktsegment").agg(
        n.min().alias("low"), n.last().str.to_uppercase().alias("top"), n.mode().alias("usual"), n.str.n_chars().max().alias("longest"), n.n_unique().cast("long").alias("names"), b.max().alias("most"), r(b.sum(), 2).alias("total")
    ).fetch()


@query("SELECT NULL::VARCHAR AS who, NULL::VARCHAR AS big, c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def sanitize_sql(t):
    from cloister.plans.sql import sql

    c = t("customer", sanitized=("c_name",)).rename({"c_name": "person"})
    return sql("WITH a AS (SELECT person AS p, c_mktsegment FROM {}) SELECT max(p) AS who, upper(min(p)) AS big, c_mktsegment, count(p) AS n FROM a GROUP BY c_mktsegment", c).fetch()


@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS mean_qty FROM lineitem GROUP BY l_returnflag")
def guard_fetch_safe(t):
    f = t("lineitem", policy=Policy(Aggregation(10))).groupby("l_returnflag").agg(r(col("l_quantity").mean()).alias("mean_qty"))
    return f.collect().fetch()


def _outcomes(t, cases):
    """What becomes of requests: their name, whether rows were released, and what the session logged."""
    rows = []
    for name, frame, session in cases:
        session.events.clear()
        found = frame.collect().fetch()
        rows.append((name, found is not None, [e["event"] for e in session.events if e["event"] in ("reject", "review", "warning")]))
    return t.session.spark.createDataFrame(rows, "name string, released boolean, log array<string>")


_FINE = "(SELECT min(n) >= {k} FROM (SELECT count(*) AS n FROM lineitem GROUP BY {by}))"


@query(
    f"""SELECT 'coarse' AS name, {_FINE.format(k=10, by='l_returnflag')} AS released, []::VARCHAR[] AS log UNION ALL SELECT 'fine', {_FINE.format(k=10, by='l_orderkey')}, ['reject']
    UNION ALL SELECT 'global', true, [] UNION ALL SELECT 'rows', false, ['reject'] UNION ALL SELECT 'reviewed', true, ['review'] UNION ALL SELECT 'denied', false, ['review'] UNION ALL SELECT 'logged', true, ['warning']
    UNION ALL SELECT 'user', true, [] UNION ALL SELECT 'other', false, ['reject'] UNION ALL SELECT 'two of three', true, [] UNION ALL SELECT 'three of three', false, ['reject']"""
)
def policy_outcomes(t):
    """Every rule and every action, on aggregations of ``lineitem``."""
    spark, cases = t.session.spark, []
    any_two = AtLeastNOf(2, (TrueRule(), UserId("ann"), FalseRule()))
    for name, policy, request, reviewer in (
        ("coarse", Policy(Aggregation(10), Action.REJECT), "flag", None), ("fine", Policy(Aggregation(10), Action.REJECT), "order", None), ("global", Policy(Aggregation(10), Action.REJECT), "all", None),
        ("rows", Policy(Aggregation(10), Action.REJECT), "rows", None), ("reviewed", Policy(Aggregation(10), Action.REVIEW), "rows", True), ("denied", Policy(Aggregation(10), Action.REVIEW), "rows", False),
        ("logged", Policy(Aggregation(10), Action.LOG), "rows", None), ("user", Policy(UserId("ann"), Action.REJECT), "rows", None), ("other", Policy(UserId("bob"), Action.REJECT), "rows", None),
        ("two of three", Policy(any_two, Action.REJECT), "rows", None), ("three of three", Policy(AtLeastNOf(3, any_two.of), Action.REJECT), "rows", None),
    ):
        session = GuardSession(spark, user="ann", reviewer=lambda request, answer=reviewer: bool(answer))
        f = session.send_df(spark.read.parquet(f"{t.sf_dir}/lineitem.parquet"), policy)
        q = col("l_quantity").mean().alias("q")
        frame = {"flag": lambda f=f: f.groupby("l_returnflag").agg(q), "order": lambda f=f: f.groupby("l_orderkey").agg(q), "all": lambda f=f: f.select(q), "rows": lambda f=f: f.select("l_tax")}[request]()
        cases.append((name, frame, session))
    return _outcomes(t, cases)


@query("SELECT 'waiting' AS name, 'pending' AS state, NULL::BIGINT AS rows UNION ALL SELECT 'allowed', 'allowed', (SELECT count(*) FROM orders WHERE o_totalprice > 100000) UNION ALL SELECT 'denied', 'denied', NULL")
def review_queue(t):
    """An analyst's results that wait for review; an owner in another session allows one and denies one, and the analyst fetches again."""
    from cloister.sources.scratch import scratch_path

    spark, folder = t.session.spark, scratch_path(t.session.spark, "reviews")
    analyst = GuardSession(spark, user="ann", reviews=folder)
    orders = analyst.send_df(spark.read.parquet(f"{t.sf_dir}/orders.parquet"), Policy(Aggregation(10), Action.REVIEW))
    frames = {name: orders.filter(col("o_totalprice") > least).collect() for name, least in (("waiting", 0), ("allowed", 100_000), ("denied", 200_000))}
    if any(f.fetch() is not None for f in frames.values()):
        raise AssertionError("released without an answer")
    owner = GuardSession(spark, user="olga", reviews=folder)
    asked = {r["name"] for r in owner.review_queue.requests()}
    for name, allow in (("allowed", True), ("denied", False)):
        if frames[name].identifier in asked:
            owner.answer(frames[name].identifier, allow)
    rows = [(name, owner.review_queue.state(f.identifier), None if (found := f.fetch()) is None else found.count()) for name, f in frames.items()]
    return spark.createDataFrame(rows, "name string, state string, rows long")


_SMALLEST = "(SELECT min(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus))::DOUBLE"
_ROWS = "(SELECT count(*) FROM lineitem)::DOUBLE"


@query(
    f"""SELECT mode, name, CASE name WHEN 'union' THEN {_SMALLEST} WHEN 'filter' THEN 1 WHEN 'global' THEN CASE mode WHEN 'strict' THEN {_ROWS} ELSE 'Infinity'::DOUBLE END WHEN 'one row' THEN CASE mode WHEN 'strict' THEN 1 ELSE 'Infinity'::DOUBLE END
        ELSE CASE mode WHEN 'strict' THEN 1 ELSE {_SMALLEST} END END AS agg_size, 1.0::DOUBLE AS join_scaling
    FROM (SELECT unnest(['strict', 'compatible']) AS mode), (SELECT unnest(['union', 'filter', 'global', 'one row', 'list', 'first', 'sql list']) AS name)"""
)
def guard_merged_stats(t):
    """Statistics of a union are the weaker of both sides'; row-wise operators leave them. A global aggregate stands for the rows that it reads, and
    lists and first values for one row; in the compatible mode the former is unbounded and the latter stand for their group."""
    from cloister.plans.sql import sql

    spark, rows = t.session.spark, []
    for mode in ("strict", "compatible"):
        session = GuardSession(spark, strict=mode == "strict")
        f = session.send_df(spark.read.parquet(f"{t.sf_dir}/lineitem.parquet"), OPEN, order_by=("l_orderkey",))
        coarse, fine = (f.groupby(*keys).agg(col("l_tax").mean().alias("m")).select("m") for keys in (["l_returnflag"], ["l_returnflag", "l_linestatus"]))
        groups = f.groupby("l_returnflag", "l_linestatus")
        found = {
            "union": coarse.vstack(fine), "filter": f.filter(col("l_tax") > 0.01).sort("l_tax").limit(9), "global": f.select(col("l_tax").mean()), "one row": f.limit(1).select(col("l_tax").mean()),
            "list": groups.agg(col("l_tax").list()), "first": groups.agg(col("l_tax").mean().alias("m"), (col("l_tax").first() + 1).alias("f")),
            "sql list": sql("SELECT l_returnflag, l_linestatus, size(collect_list(l_tax)) AS n FROM {} GROUP BY l_returnflag, l_linestatus", f),
        }
        rows += [(mode, n, float(s.agg_size), float(s.join_scaling)) for n, x in found.items() for s in x.provenance().values()]
    return spark.createDataFrame(rows, "mode string, name string, agg_size double, join_scaling double")


@query("SELECT 'a' AS name, (SELECT count(*) FROM part WHERE p_size > 20) AS rows, true AS listed UNION ALL SELECT 'b', (SELECT count(*) FROM nation), false")
def session_store(t):
    """Saved results are found by a new session; deleted ones are gone."""
    from cloister.sources.scratch import scratch_path

    spark, store = t.session.spark, scratch_path(t.session.spark, "store")
    first = GuardSession(spark, store=store)
    a = first.send_df(spark.read.parquet(f"{t.sf_dir}/part.parquet"), OPEN).filter(col("p_size") > 20).collect()
    b = first.send_df(spark.read.parquet(f"{t.sf_dir}/nation.parquet"), OPEN).select("n_name").collect()
    for x in (a, b):
        x.save()
    rows_b = b.fetch().count()
    again = GuardSession(spark, store=store)
    again.delete(b.identifier)
    names = {x["name"] for x in GuardSession(spark, store=store).list_dfs().collect()}
    rows = [("a", GuardSession(spark, store=store).get_df(a.identifier).fetch().count(), a.identifier in names), ("b", rows_b, b.identifier in names)]
    return spark.createDataFrame(rows, "name string, rows long, listed boolean")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_and_arrow_sources(t):
    """Half a table from CSV files, half from an Arrow table, put together."""
    from cloister.sources.scratch import scratch_path

    spark, path = t.session.spark, scratch_path(t.session.spark, "csv")
    nation = spark.read.parquet(f"{t.sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    nation.where("n_regionkey < 2").write.option("header", True).csv(path)
    read = t.session.read(path, "csv", OPEN, schema=nation.schema, header=True)
    sent = t.session.send_df(nation.where("n_regionkey >= 2").toArrow(), OPEN)
    return read.vstack(sent).cache()


# SQL.


@query("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal BETWEEN 0 AND 5000 GROUP BY o_orderpriority")
def sql_placeholders(t):
    from cloister.plans.sql import sql

    return sql('SELECT "o_orderpriority", count(*) AS n, Max(o_totalprice) AS top FROM {} INNER JOIN {} ON o_custkey = c_custkey WHERE c_acctbal BETWEEN 0 AND 5000 GROUP BY o_orderpriority', t("orders"), t("customer"))


@query("SELECT a.n_name, count(*) AS others FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY a.n_name")
def sql_self_join(t):
    from cloister.plans.sql import sql

    n = t("nation")
    return sql("SELECT a.n_name, count(*) AS others FROM {} a JOIN {} b ON a.n_regionkey = b.n_regionkey GROUP BY a.n_name", n, n)


@query("SELECT 'nation' AS source, (SELECT min(n) FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey)) AS agg_size")
def sql_guard(t):
    from cloister.plans.sql import sql

    (stats,) = sql("SELECT n_regionkey, count(*) AS n FROM {} GROUP BY n_regionkey", t("nation")).provenance().values()
    return t.session.spark.createDataFrame([("nation", int(stats.agg_size))], "source string, agg_size long")


# Arrays, tokens, learning, streams.


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, [p_retailprice, p_size::DOUBLE] AS value FROM part")
def arrays_flat(t):
    from cloister.operators.arrays import to_array

    df = t("part").df.select(F.col("p_retailprice"), F.col("p_size").cast("double"), F.col("p_partkey").cast("double"))
    indexed = to_array(df, [F.col("p_partkey")])
    return indexed.df.select("row", F.slice("value", 1, 2).alias("value"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, [embedding, list_transform(embedding, lambda x: vec_id::FLOAT)] AS value FROM embeddings")
def arrays_stack(t):
    """Whole vectors, each beside a vector of its number."""
    from cloister.operators.arrays import to_array

    df = t("embeddings").df.select("embedding", F.transform("embedding", lambda x: F.col("vec_id").cast("float")).alias("id"))
    return to_array(df, [F.col("id")[0]]).df


@query(
    """WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row, [p_partkey::DOUBLE, p_retailprice] AS v FROM part), n AS (SELECT count(*) AS n FROM part)
    SELECT row, v AS value, 'append' AS kind FROM a UNION ALL SELECT row + n, v, 'append' FROM a, n UNION ALL SELECT row, list_transform(v, lambda x: x::FLOAT::DOUBLE), 'float' FROM a"""
)
def arrays_append_cast(t):
    """An array appended to itself, and cast to single precision; with the shape that the operators report."""
    from cloister.operators.arrays import to_array

    a = to_array(t("part").df.select(F.col("p_partkey").cast("double"), "p_retailprice"), [F.col("p_partkey")])
    both, single = a.append(a), a.to("float")
    if both.shape != (2 * a.height, 2) or single.dtype != "float":
        raise AssertionError(f"shape {both.shape}, type {single.dtype}")
    return both.df.withColumn("kind", F.lit("append")).union(single.to("double").df.withColumn("kind", F.lit("float")))


@query("SELECT [p_partkey, p_size] AS value, 'shuffle' AS kind FROM part UNION ALL SELECT [p_partkey, p_size], 'split' FROM part")
def arrays_shuffle(t):
    """All rows of a shuffled array and of a shuffled split, once each."""
    from cloister.operators.arrays import to_array, train_test_split

    a = to_array(t("part").df.select("p_partkey", F.col("p_size").cast("long")), [F.col("p_partkey")])
    train, test = train_test_split(a, test_size=0.25, shuffle=True, random_state=3)
    return a.shuffle(5).df.select("value", F.lit("shuffle").alias("kind")).union(train.df.union(test.df).select("value", F.lit("split")))


@query("SELECT CASE WHEN i < floor((SELECT count(*) FROM part) * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(p_partkey) AS keys FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) GROUP BY 1")
def split_fixed(t):
    from cloister.operators.arrays import to_array, train_test_split

    a = to_array(t("part").df.select("p_partkey"), [F.col("p_partkey")])
    train, test = train_test_split(a, test_size=0.2)
    both = train.df.withColumn("part", F.lit("train")).union(test.df.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value")[0]).alias("keys"))


@query()
def tokenise(t):
    """All ids and masks of the whole texts of ``documents``."""
    import public_tokenizers

    from cloister.operators.arrays import TokenizerConfig, encode

    return encode(t("documents").df.select("text"), TokenizerConfig(public_tokenizers.path("byte_bpe_50k.json")))


@query("SELECT o_orderpriority, true AS near, true AS noised FROM orders GROUP BY o_orderpriority")
def dp_release(t):
    """The number of orders of each priority with Gaussian noise, half of a budget of 1 spent on it: near the exact count by ten deviations, but not equal to it."""
    from cloister.operators.privacy import PrivacyContext, release_column, sigma

    counts = t("orders").groupby("o_orderpriority").count().df
    context = PrivacyContext(1.0, t("orders").df.count())
    noisy = release_column(counts.withColumn("noisy", F.col("count")), "noisy", context, 1.0, 0.5)
    off = F.abs(F.col("noisy") - F.col("count"))
    return noisy.select("o_orderpriority", (off < 10 * sigma(0.5, context.delta, 1.0)).alias("near"), (off > 0).alias("noised"))


@query(
    """WITH k AS (SELECT 0.8 AS epsilon, 1 / (10.0 * count(*)) AS delta FROM lineitem), f AS (SELECT sqrt(3) * sqrt(2 * ln(1.25 / delta)) / (epsilon + 1e-8) AS one FROM k)
    SELECT l_returnflag, l_linestatus, round(one * (40 * 1.5 + 3), 6) AS revenue_sigma, round(one, 6) AS n_sigma, round(one * 5, 6) AS gap_sigma, true AS near, true AS noised FROM lineitem, f GROUP BY l_returnflag, l_linestatus, one"""
)
def private_group_sums(t):
    """Sums of clamped and scaled columns for each group, with noise for what one row can move: of (clamped quantity x 1.5 + clamped discount x 10) 63, of a count
    1, and of a difference between sums over disjoint rows, not over the same, 5."""
    from cloister.operators.privacy import PrivacyContext
    from cloister.operators.sensitivity import PrivateTable

    df = t("lineitem").df
    table = PrivateTable.of(df, PrivacyContext(1.0, df.count()))
    cheap, dear = table.split(F.col("l_extendedprice") < 30000)
    revenue = table.sum(table.col("l_quantity").clamp(0, 40) * 1.5 + table.col("l_discount").clamp(-0.3, 0.3) * 10)
    tax = table.col("l_tax").clamp(0, 0.05) * 100
    found = table.release(0.8, ["l_returnflag", "l_linestatus"], revenue=revenue, n=table.count(), gap=cheap.sum(tax) - dear.sum(tax))
    q, sign = F.least(F.greatest(F.col("l_quantity"), F.lit(0)), F.lit(40)), F.when(F.col("l_extendedprice") < 30000, 1).otherwise(-1)
    exact = df.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(q * 1.5 + F.greatest(F.lit(-0.3), F.least(F.lit(0.3), F.col("l_discount"))) * 10).alias("e_revenue"), F.count(F.lit(1)).alias("e_n"), F.sum(sign * F.least(F.col("l_tax"), F.lit(0.05)) * 100).alias("e_gap")
    )
    off = [F.abs(F.col(c) - F.col(f"e_{c}")) / F.col(f"{c}_sigma") for c in ("revenue", "n", "gap")]
    both = found.join(exact, ["l_returnflag", "l_linestatus"])
    return both.select("l_returnflag", "l_linestatus", *[F.round(f"{c}_sigma", 6).alias(f"{c}_sigma") for c in ("revenue", "n", "gap")], (F.greatest(*off) < 10).alias("near"), (F.least(*off) > 0).alias("noised"))


@query()
def dp_sgd(t):
    """Private linear regression of a part's scaled price on its scaled size."""
    from cloister.operators.learning import SGD, Dataset, Learner, Model

    p = t("part").minmax_scale(["p_retailprice", "p_size", "p_partkey"]).df
    data = Dataset.build(p, ["p_size", "p_partkey"], "p_retailprice", 100.0, F.xxhash64("p_partkey"))
    learner = Learner(Model.zeros(2), data, SGD(0.2, 0.9), max_batch_size=500)
    learner.fit(nb_epochs=3, eps=5.0)
    loss, spread = learner.test(data, "l2", 0.5)
    w = learner.model.weights[0]
    return t.session.spark.createDataFrame([(float(w[0]), float(w[1]), float(w[2]), loss, spread, data.context.spent)], "w0 double, w1 double, bias double, loss double, spread double, spent double")


@query(
    """WITH z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, l_extendedprice / 1000 AS y FROM lineitem), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS m FROM z)
    SELECT round(any_value(s), 4) AS slope, round(any_value(m), 4) AS bias, round(avg(least((y - m - s * x) ** 2, 10)), 3) AS loss FROM z, f"""
)
def sgd_least_squares(t):
    """Linear regression without noise: on a scaled input, steps of one half over all rows end at the least squares."""
    from cloister.operators.learning import SGD, Dataset, Learner, Model

    q = col("l_quantity")
    f = t("lineitem").select(((q - q.mean()) / q.std(0)).alias("x"), (col("l_extendedprice") / 1000).alias("y"))
    data = Dataset.build(f.df, ["x"], "y", None)
    learner = Learner(Model.zeros(1), data, SGD(0.5), max_batch_size=1 << 40)
    learner.fit(nb_epochs=2, eps=None)
    loss, _ = learner.test(data, "l2")
    slope, bias = learner.model.weights[0]
    return t.session.spark.createDataFrame([(round(float(slope), 4), round(float(bias), 4), round(loss, 3))], "slope double, bias double, loss double")


_LEAST_SQUARES = """WITH z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, l_extendedprice / 1000 AS y FROM lineitem)
    SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS bias{more} FROM z"""


def _scaled_line(t, limit=None):
    """The price of lineitem by its scaled quantity, as samples."""
    from cloister.operators.learning import Dataset

    q = col("l_quantity")
    f = t("lineitem").select((q * 0 + col("l_orderkey") * 8 + col("l_linenumber")).cast("long").alias("id"), ((q - q.mean()) / q.std(0)).alias("x"), (col("l_extendedprice") / 1000).alias("y"))
    return Dataset.build(f.df, ["x"], "y", limit, F.col("id"))


@query(
    """WITH p AS (SELECT p_retailprice / 700 + p_size / 9 AS y, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS x FROM part)
    SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS bias, (SELECT count(*) FROM part) AS height, 'double' AS dtype FROM p"""
)
def tensor_dataset(t):
    """Columns made arrays, arrays tensors, tensors a data set, and that trained on to its least squares."""
    from cloister.operators.arrays import to_array
    from cloister.operators.learning import SGD, Dataset, Learner, Model

    size = col("p_size")
    p = t("part").select("p_partkey", ((size - size.mean()) / size.std(0)).alias("x"), (col("p_retailprice") / 700 + size / 9).alias("y"))
    x, y = (to_array(p.df.select(c, F.col("p_partkey").cast("double")), [F.col("p_partkey")]) for c in ("x", "y"))
    x, y = (replace(a, df=a.df.select("row", F.slice("value", 1, 1).alias("value")), inner=(1,)).to_tensor() for a in (x, y))
    learner = Learner(Model.zeros(1), Dataset.of_tensors([x], y, None), SGD(0.5), max_batch_size=1 << 40)
    learner.fit(2, None)
    slope, bias = learner.model.weights[0]
    return t.session.spark.createDataFrame([(round(float(slope), 6), round(float(bias), 6), x.shape[0], y.dtype)], "slope double, bias double, height long, dtype string")


@query(_LEAST_SQUARES.format(more=", 2 AS steps"))
def train_resumed(t):
    """A training that stops after its first epoch; another learner finds the checkpoint in the store and ends at the least squares."""
    from cloister.operators.learning import SGD, Checkpoints, Learner, Model
    from cloister.sources.scratch import scratch_path

    spark, data = t.session.spark, _scaled_line(t)
    kept = Checkpoints(spark, scratch_path(spark, "checkpoints"))
    Learner(Model.zeros(1), data, SGD(0.5), max_batch_size=1 << 40).fit(1, None, keep=kept)
    learner = Learner(Model(kept.last().weights * 0), data, SGD(123.0), max_batch_size=1 << 40)
    learner.fit(2, None, resume=True, keep=kept)
    slope, bias = learner.model.weights[0]
    return spark.createDataFrame([(round(float(slope), 4), round(float(bias), 4), learner.steps)], "slope double, bias double, steps int")


@query(_LEAST_SQUARES.format(more=", 'ok' AS status, 2 AS steps, round((SELECT avg(least((w.y - q.m - q.s * w.x) ** 2, 10)) FROM z w, (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS m FROM z) q), 3) AS loss"))
def registry_runs(t):
    """A training and a test in the background, polled through the store: the least squares of lineitem and their clipped loss."""
    from cloister.operators.learning import Model, Registry, TrainConfig
    from cloister.sources.scratch import scratch_path

    spark = t.session.spark
    registry = Registry(spark, scratch_path(spark, "registry"))
    registry.send_dataset("line", _scaled_line(t))
    registry.send_model("price", Model.zeros(1))
    trained = registry.wait(registry.train(TrainConfig("price", "line", 2, None, 1 << 40, optimizer="SGD", options={"lr": 0.5})), 600)
    tested = registry.wait(registry.test("price", "line", "l2"), 600)
    slope, bias = registry.fetch_model("price").weights[0]
    row = (round(float(slope), 4), round(float(bias), 4), trained["status"], trained.get("step"), round(tested.get("value", -1.0), 3))
    return spark.createDataFrame([row], "slope double, bias double, status string, steps int, loss double")


@query(
    """WITH z AS (SELECT l_quantity / 50 AS x, l_discount * 10 AS y FROM lineitem), g AS (SELECT -2 * y * x AS gx, -2 * y AS gb FROM z), c AS (SELECT *, least(1, 0.8 / (sqrt(gx * gx + gb * gb) + 1e-6)) AS f FROM g)
    SELECT 'SGD' AS optimizer, round(-0.5 * sum(f * gx) / count(*), 9) AS slope, round(-0.5 * sum(f * gb) / count(*), 9) AS bias FROM c
    UNION ALL SELECT 'Adam', round(-0.5 * (sum(f * gx) / count(*)) / (abs(sum(f * gx) / count(*)) + 1e-8), 9), round(-0.5 * (sum(f * gb) / count(*)) / (abs(sum(f * gb) / count(*)) + 1e-8), 9) FROM c"""
)
def clipped_step(t):
    """One step of the private training with its noise left out: per-sample gradients clipped to norm 0.8, for both optimisers."""
    from cloister.operators.learning import SGD, Adam, Dataset, Model, gradient_sum

    f = t("lineitem").select((col("l_orderkey") * 8 + col("l_linenumber")).alias("id"), (col("l_quantity") / 50).alias("x"), (col("l_discount") * 10).alias("y"))
    data = Dataset.build(f.df, ["x"], "y", 1.0, F.col("id"))
    rows = []
    for optimizer in (SGD(0.5), Adam(0.5)):
        model = Model.zeros(1)
        total, n = gradient_sum(data.df, model, 0.8)
        w = optimizer.step(model.weights, total / n)[0]
        rows.append((type(optimizer).__name__, round(float(w[0]), 9), round(float(w[1]), 9)))
    return t.session.spark.createDataFrame(rows, "optimizer string, slope double, bias double")


def _permuted_sql(size: int, seed: int, epoch: int) -> str:
    """The batches of lineitem by the arithmetic that ``cloister.operators.permute`` states, with walks as a recursion."""
    from cloister.operators.permute import PRIME, Permutation

    step = "SELECT i, y // s AS l, y % s AS r, s, n FROM {}"
    for a, b, c in Permutation.of(1, seed, epoch).keys:  # keys do not depend on the number of rows
        step = f"SELECT i, r AS l, (l + t * ((t + {c}) % {PRIME}) % {PRIME}) % s AS r, s, n FROM (SELECT *, (r % {PRIME} * {a} + {b}) % {PRIME} AS t FROM ({step}))"
    once = lambda source: f"SELECT i, l * s + r AS y, s, n FROM ({step.format(source)})"
    return f"""WITH RECURSIVE rows AS (SELECT row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber) - 1 AS i, l_orderkey, l_linenumber FROM lineitem),
    size AS (SELECT count(*) AS n, CASE WHEN floor(sqrt(count(*) - 1))::BIGINT ** 2 > count(*) - 1 THEN floor(sqrt(count(*) - 1))::BIGINT ELSE floor(sqrt(count(*) - 1))::BIGINT + 1 END AS s FROM lineitem),
    start AS (SELECT i, i AS y, s, n FROM rows, size),
    walk AS ({once('start')} UNION ALL {once('(SELECT * FROM walk WHERE y >= n)')})
    SELECT y // {size} AS batch, count(*) AS n, sum(l_orderkey)::BIGINT AS keys, sum(l_linenumber)::BIGINT AS lines FROM walk JOIN rows USING (i) WHERE y < n AND y // {size} < n // {size} GROUP BY 1"""


@query(_permuted_sql(700, 11, 3))
def permuted_batches(t):
    """Batches of exactly 700 rows of lineitem for the fourth epoch of seed 11; the rows left over are in none."""
    from cloister.operators.ordered import row_index
    from cloister.operators.permute import Permutation

    rows = row_index(t("lineitem").df.select("l_orderkey", "l_linenumber"), [F.col("l_orderkey") * 8 + F.col("l_linenumber")])
    n = rows.count()
    batch = F.call_function("div", Permutation.of(n, 11, 3).column(F.col("index")), F.lit(700).cast("long"))
    dealt = rows.select(batch.alias("batch"), "l_orderkey", "l_linenumber").where(F.col("batch") < n // 700)
    return dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.sum("l_linenumber").alias("lines"))


@query(
    """WITH c AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM orders) AS epsilon FROM orders GROUP BY 1), s AS (SELECT *, sum(epsilon) OVER (ORDER BY epsilon, o_orderpriority) AS total FROM c)
    SELECT o_orderpriority, total < 0.7 AS allowed, round(CASE WHEN total < 0.7 THEN total ELSE (SELECT max(total) FROM s WHERE total < 0.7) END, 6) AS spent FROM s"""
)
def budget_ledger(t):
    """Two sessions take turns to spend from one stored budget of 0.7, for each priority its share of all orders, smallest first; each sees what the other spent."""
    from cloister.operators.privacy import BudgetExceeded, BudgetLedger, PrivacyContext
    from cloister.sources.scratch import scratch_path

    spark, f = t.session.spark, t("orders")
    n, folder = f.df.count(), scratch_path(t.session.spark, "budget")
    shares = f.groupby("o_orderpriority").count().df.orderBy("count", "o_orderpriority").collect()  # a row for each priority
    writers = [PrivacyContext(0.7, n, ledger=BudgetLedger(spark, folder)) for _ in range(2)]
    rows = []
    for k, r in enumerate(shares):
        context, allowed = writers[k % 2], True
        try:
            context.spend(r["count"] / n)
        except BudgetExceeded:
            allowed = False
        rows.append((r["o_orderpriority"], allowed, round(PrivacyContext(0.7, n, ledger=BudgetLedger(spark, folder)).spent, 6)))
    return spark.createDataFrame(rows, "o_orderpriority string, allowed boolean, spent double")


@query()
def embedding_classifier(t):
    """A network on whole texts of ``documents``, trained without noise to tell whether a text is English: hashed words looked up in a table,
    normalised, averaged, and a softmax; returns the clipped loss and the accuracy before and after."""
    from cloister.operators.layers import Embedding, LayerNorm, Linear, MeanPool, Network
    from cloister.operators.learning import Adam, Dataset, Learner

    words = F.filter(F.split(F.lower("text"), "[^a-z\u00e0-\u00ff]+"), lambda w: w != "")
    tokens = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2048)).cast("int"))
    docs = t("documents").df.select("doc_id", tokens.alias("tokens"), (F.col("lang") == "en").cast("int").alias("y"))
    data = Dataset.build(docs, ["tokens"], "y", None, F.col("doc_id"))
    learner = Learner(Network([Embedding(2048, 8), LayerNorm(8), MeanPool(), Linear(8, 2)], seed=1), data, Adam(0.02), max_batch_size=max(data.n // 4, 1), seed=1)
    before = [value for value, _ in learner.tests(data, ["cross_entropy", "accuracy"])]
    learner.fit(3, None)
    after = [value for value, _ in learner.tests(data, ["cross_entropy", "accuracy"])]
    return t.session.spark.createDataFrame([("before", *before), ("after", *after)], "at string, loss double, accuracy double")


@query("SELECT 'accuracy' AS metric, round(avg(CAST(l_returnflag = 'N' AS INT)), 6) AS value FROM lineitem UNION ALL SELECT 'l2', round(avg(least((l_quantity / 10 - 1) ** 2, 10)), 6) FROM lineitem")
def clipped_metrics(t):
    """Metrics of fixed models: the share that a constant class gets right, and the clipped squared error of a constant."""
    import numpy as np

    from cloister.operators.learning import Dataset, Learner, Model

    df = t("lineitem").df.select((F.col("l_returnflag") == "N").cast("double").alias("c"), (F.col("l_quantity") / 10).alias("q"), F.lit(0.0).alias("x"))
    classes, values = Dataset.build(df, ["x"], "c", None), Dataset.build(df, ["x"], "q", None)
    one = Learner(Model(np.array([[0.0, 0.0], [0.0, 1.0]]), "cross_entropy"), classes).test(classes, "accuracy")[0]
    two = Learner(Model(np.array([[0.0, 1.0]])), values).test(values, "l2")[0]
    return t.session.spark.createDataFrame([("accuracy", round(one, 6)), ("l2", round(two, 6))], "metric string, value double")


@query("SELECT 'model' AS name, 2.5::DOUBLE AS value UNION ALL SELECT 'rows', (SELECT count(*) FROM nation)::DOUBLE UNION ALL SELECT 'spent', 0.25")
def registry_store(t):
    """A model, a data set and what is spent of its budget, found again by another registry."""
    import numpy as np

    from cloister.operators.learning import Dataset, Model, Registry
    from cloister.sources.scratch import scratch_path

    spark, store = t.session.spark, scratch_path(t.session.spark, "registry")
    first = Registry(spark, store)
    data = Dataset.build(t("nation").df, ["n_nationkey"], "n_regionkey", 1.0)
    first.send_model("m", Model(np.array([[2.5, 0.0]])))
    first.send_dataset("d", data)
    data.context.spend(0.25)
    again = Registry(spark, store)
    found = again.datasets["d"]
    rows = [("model", float(again.fetch_model("m").weights[0, 0])), ("rows", float(found.df.count())), ("spent", found.context.spent)]
    return spark.createDataFrame(rows, "name string, value double")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS ts, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_tumble(t):
    """Closed windows of a stream of files, emitted once the watermark has passed them."""
    from cloister.sources.scratch import scratch_path
    from cloister.streaming.windows import drain, read_files, windowed

    spark = t.session.spark
    source = scratch_path(spark, "stream-in")
    events = spark.read.parquet(f"{t.sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(source)
    stream = read_files(spark, source, events.schema)
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    drain(windowed(stream, "ts", "1d", count().alias("n"), r(col("value").sum(), 2).alias("total"), by=("event_type",)), out, state)
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register a guarded table, aggregate it, let its policy judge the result, and fetch that."""
    return QUERIES["guard_fetch_safe"](spark, sf_dir)
