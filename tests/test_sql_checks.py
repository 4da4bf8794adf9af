"""What SQL over guarded frames accepts and what it rejects, wherever it is hidden."""

import pytest
from pyspark.sql import functions as F

from cloister.plans.sql import sql
from cloister.policy import Policy, TrueRule
from cloister.session import GuardSession, RequestRejected


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.range(6).selectExpr("id", "id % 2 AS k", "cast(id AS string) AS name", "array(id, id + 1) AS xs", "timestamp_seconds(id) AS ts")
    return GuardSession(spark).send_df(df, Policy(TrueRule()))


CALL = "{}('java.lang.System', 'getProperty', 'user.dir')"
PLACES = {
    "select": "SELECT {f} AS d FROM {{}}",
    "where": "SELECT id FROM {{}} WHERE {f} IS NOT NULL",
    "nested": "SELECT coalesce(upper(concat('a', {f})), 'x') AS d FROM {{}}",
    "group": "SELECT count(*) AS n FROM {{}} GROUP BY {f}",
    "having": "SELECT k FROM {{}} GROUP BY k HAVING max({f}) > 'a'",
    "order": "SELECT k FROM {{}} ORDER BY {f}",
    "limit": "SELECT k FROM {{}} LIMIT length({f})",
    "join": "SELECT a.id FROM {{}} a JOIN (SELECT 1 AS id) b ON a.id = length({f})",
    "scalar subquery": "SELECT (SELECT max({f})) AS d FROM {{}}",
    "in subquery": "SELECT id FROM {{}} WHERE name IN (SELECT {f})",
    "exists": "SELECT id FROM {{}} WHERE EXISTS (SELECT 1 WHERE {f} = 'a')",
    "cte": "WITH x AS (SELECT {f} AS d) SELECT x.d FROM x, {{}}",
    "cte in a subquery": "SELECT (WITH x AS (SELECT {f} AS d) SELECT d FROM x) AS d FROM {{}}",
    "window": "SELECT sum(id) OVER w AS s FROM {{}} WINDOW w AS (PARTITION BY {f})",
    "lambda": "SELECT transform(xs, x -> {f}) AS d FROM {{}}",
    "values": "SELECT d FROM {{}}, VALUES ({f}) AS v(d)",
    "lateral": "SELECT d FROM {{}}, LATERAL (SELECT {f} AS d)",
    "lateral view": "SELECT d FROM {{}} LATERAL VIEW explode(array({f})) v AS d",
    "many columns": "SELECT " + ", ".join(f"id + {i} AS c{i}" for i in range(60)) + ", {f} AS d FROM {{}}",
    "pivot": "SELECT * FROM (SELECT k, {f} AS d FROM {{}}) PIVOT (count(d) FOR k IN (0, 1))",
}


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("call", ["reflect", "java_method", "try_reflect", "Reflect"])
def test_java_calls_are_rejected(frame, place, call):
    with pytest.raises(RequestRejected):
        sql(PLACES[place].format(f=CALL.format(call)), frame)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT TRANSFORM(id) USING 'cat' AS (d) FROM {}", "SELECT IDENTIFIER('reflect')('java.lang.System', 'lineSeparator') AS d FROM {}", "SELECT * FROM IDENTIFIER('hidden'), {}", "SELECT h.* FROM hidden h, {}",
        "SELECT * FROM hidden, {} WHERE EXISTS (WITH hidden AS (SELECT 1) SELECT 1)", "WITH a AS (SELECT * FROM hidden), hidden AS (SELECT 1 AS x) SELECT a.* FROM a, {}", "SELECT * FROM global_temp.hidden, {}",
        "SELECT * FROM range(5), {}", "SELECT * FROM parquet.`/etc`, {}", "SELECT input_file_name() AS d FROM {}", "SELECT current_user() AS d FROM {}", "SELECT current_user AS d FROM {}", "SELECT version() AS d FROM {}",
        "SELECT raise_error(name) AS d FROM {}", "SELECT assert_true(id > 3, name) AS d FROM {}", "SELECT own_function(id) AS d FROM {}", "SELECT spark_catalog.default.abs(id) AS d FROM {}", "INSERT INTO hidden SELECT * FROM {}",
        "CREATE TABLE t AS SELECT * FROM {}", "DROP VIEW hidden -- {}", "SET x = 1 -- {}", "SELECT * FROM {} FOR VERSION AS OF 1", "EXPLAIN SELECT * FROM {}", "SHOW TABLES -- {}", "SELECT :x AS d FROM {}",
    ],
)
def test_rejected(spark, frame, text):
    spark.range(3).createOrReplaceTempView("hidden")
    spark.udf.register("own_function", lambda x: 1, "int")
    with pytest.raises(RequestRejected):
        sql(text, frame)


def test_shadowed_functions_are_rejected(spark):
    own = spark.newSession()
    mine = GuardSession(own).send_df(own.range(2).selectExpr("cast(id AS string) AS name"), Policy(TrueRule()))
    assert sql("SELECT soundex(name) AS d FROM {}", mine).fetch().first()["d"] == "0"
    own.udf.register("soundex", lambda x: "own", "string")
    with pytest.raises(RequestRejected, match="not accepted"):
        sql("SELECT soundex(name) AS d FROM {}", mine)


def test_frames_with_functions_of_their_own_are_accepted(spark, frame):
    own = F.udf(lambda x: f"<{x}>", "string")
    mine = frame.session.send_df(spark.range(2).select(own("id").alias("d")), Policy(TrueRule()))
    assert [r["d"] for r in sql("SELECT d FROM {} ORDER BY d", mine).fetch().collect()] == ["<0>", "<1>"]


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("SELECT k, count(*) AS n, sum(id) FILTER (WHERE id > 1) AS s FROM {} GROUP BY k HAVING count(*) > 1 ORDER BY k LIMIT 5", [(0, 3, 6), (1, 3, 8)]),
        ("WITH a AS (SELECT id FROM {} WHERE id BETWEEN 1 AND 2), b(x) AS (SELECT id * 2 FROM a) SELECT x FROM b ORDER BY x", [(2,), (4,)]),
        ("SELECT max(CASE WHEN name LIKE '5%' THEN extract(SECOND FROM ts)::int END) AS m, typeof(max(name)) AS t FROM {}", [(5, "string")]),
        ("SELECT sum(id) OVER (PARTITION BY k ORDER BY id) AS s FROM {} ORDER BY k, id LIMIT 3", [(0,), (2,), (6,)]),
        ("SELECT x FROM {} LATERAL VIEW explode(xs) v AS x WHERE id = 3 ORDER BY x", [(3,), (4,)]),
        ("SELECT aggregate(transform(xs, x -> x + 1), 0L, (a, x) -> a + x) AS t FROM {} WHERE id = (SELECT max(v) FROM VALUES (1), (2) AS z(v))", [(7,)]),
        ("SELECT k FROM {} UNION SELECT 7 ORDER BY k", [(0,), (1,), (7,)]),
        ("SELECT DISTINCT nvl(nullif(k, 1), 9) AS d, trim(BOTH FROM ' a ') AS t FROM {} ORDER BY d", [(0, "a"), (9, "a")]),
        ("FROM {} |> WHERE id > 4 |> SELECT id", [(5,)]),
        ("SELECT * FROM (SELECT k, id FROM {}) PIVOT (sum(id) FOR k IN (0 AS even, 1 AS odd))", [(6, 9)]),
    ],
)
def test_accepted(frame, text, rows):
    assert [tuple(r) for r in sql(text, frame).fetch().collect()] == rows
