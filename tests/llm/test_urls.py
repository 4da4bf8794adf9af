import random

import pytest

from cloister.llm import urls
from cloister.llm.urls import RULES, build_cascade, judge_by_join, judge_urls


def brute(url, rules=RULES, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


def _pages(spark, found):
    return spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(found)], "page_id long, url string, rule string, host string")


URLS = [
    None, "", "nonsense", "http://", "http:///x", "https://Example.NET/en/1?q#f", "https://a.b.example.net/en", "http://x.net", "http://x.net/", "http://net/",
    "http://example.com/de/", "http://notexample.com/de/x", "http://sub.example.com/de/x#y", "http://a.org/fr/?x", "http://a.org/fr", "http://a.org?/fr/",
    "http://É.org/fr/ü", "http://u@x.net:80/", "http://a..net/", "http://.net/x", "x://y://z.net/", "http://" + "a." * 3000 + "net/" + "p" * 50_000,
]


def test_judged_as_by_hand(spark):
    found = URLS + ["http://x.net/"] * 3 + [f"http://{h}.{t}{p}" for h in ("example", "a.example", "EXAMPLE") for t in ("net", "com", "org") for p in ("", "/", "/en/", "/de/a", "/fr/")]
    for judged in (
        judge_urls(_pages(spark, found)),
        judge_by_join(_pages(spark, found), spark.createDataFrame(RULES, "action string, host string, path string")),
    ):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect()}
        assert got == {i: brute(u) for i, u in enumerate(found)}
    assert judge_urls(_pages(spark, [])).collect() == []
    assert judge_urls(_pages(spark, ["http://x.net/"]), rules=()).first()["verdict"] == "allow"


def test_cascade_is_exact(spark):
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(20_000)]
    listed = set(rng.sample(keys, 900)) | {f"absent{i}" for i in range(50)}
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), universe)
    got = {r["key"] for r in universe.where(cascade.listed(universe["key"])).collect()}
    assert got == listed & set(keys)
    assert len(cascade.levels) > 1
    assert sum(level.bits for level in cascade.levels) < 20 * len(listed)


def test_list_beyond_bound(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_LISTED", 2)
    with pytest.raises(ValueError, match="judge_by_join"):
        build_cascade(spark.range(3).selectExpr("string(id) as key"), spark.range(9).selectExpr("string(id) as key"))


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_many_rules(spark, monkeypatch, most):
    """Thousands of rules by the cascade, and by the join beyond its bound."""
    monkeypatch.setattr(urls, "MAX_LISTED", most)
    rng = random.Random(8)
    rules = tuple({(h, p): (rng.choice(["block", "allow"]), h, p) for h, p in ((f"h{rng.randrange(3000)}.com", rng.choice(["/", "/a/", "/b/c/"])) for _ in range(3000))}.values())
    found = [f"http://{rng.choice(['', 'www.'])}h{rng.randrange(6000)}.com{rng.choice(['', '/', '/a/x', '/b/c/d?e', '/b'])}" for _ in range(2000)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(_pages(spark, found), rules).collect()}
    listed: dict[str, list] = {}
    for a, h, p in rules:
        listed.setdefault(h, []).append((a, h, p))
    for i, u in enumerate(found):
        host = u.split("/")[2]
        assert got[i] == brute(u, tuple(listed.get(host.removeprefix("www."), ())))


def test_a_level_is_one_literal(spark):
    from pyspark.sql import functions as F

    from cloister.llm.urls import BloomLevel

    level = BloomLevel(bits=64, hashes=5, salt=1, data=bytes([15]) * 16)
    df = spark.createDataFrame([("a",), (None,)], "k string")
    found = df.select(level.has(F.col("k")).alias("has"))
    assert found._jdf.queryExecution().analyzed().toString().count("0x" + "0F" * 16) + found._jdf.queryExecution().analyzed().toString().count("\x0f" * 16) == 1
    assert found.first()["has"] is True
