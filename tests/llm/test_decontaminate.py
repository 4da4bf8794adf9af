import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloister.llm.decontaminate import build_automaton, find_contamination, scan, window_shards

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width):
    ws = words(text)
    hit, found = set(), set()
    for item, body in items:
        iw = words(body)
        runs = [iw[i : i + width] for i in range(max(1, len(iw) - width + 1))] if iw else []
        for run in runs:
            for i in range(len(ws) - len(run) + 1):
                if ws[i : i + len(run)] == run:
                    hit |= set(range(i, i + len(run)))
                    found.add(str(item))
    return len(ws), len(hit), sorted(found)


TEXT = st.lists(st.sampled_from(["a", "B", "ab", "é", "İ", "7", "-", " ", ", ", "\n", "中", "\x00", "\x7f"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 12), TEXT), max_size=4), st.integers(1, 4))
def test_scan_against_brute_force(text, items, width):
    shards = list(window_shards(((str(i), t) for i, t in items), width))
    n, hit, found, spans = scan(text, [build_automaton(s) for s in shards])
    assert (n, hit, sorted(found)) == brute(text, items, width)
    raw = text.encode()
    assert sum(len(words(raw[a:b].decode())) for a, b in spans) == hit


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 1])
def test_operator(spark, automaton_bytes):
    rows = [
        (1, "x One two; THREE four y", "clash"), (2, None, "clash"), (3, "", "clash"), (4, "nothing here", "clash"), (5, "go", "clash"), (5, "go", "clash"),
        (6, "w " * 300_000 + "one two three", "clash"), (7, "five six seven one two three", "c"), (None, "go go", "c"),
    ]
    items = [(10, "one two three four"), (9, "go"), (8, None), (7, "!!"), (9, "go"), (11, "five six seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in find_contamination(docs, bench, width=3, automaton_bytes=automaton_bytes).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted([(r[0], *brute(r[1], items, 3)) for r in rows], key=key)
    nothing = find_contamination(docs, bench.limit(0), width=3).collect()
    assert len(nothing) == len(rows) and not any(r["n_hit"] for r in nothing)
    assert find_contamination(docs.limit(0), bench).collect() == []


def test_items_without_id_hit_as_the_sql_says(spark, tmp_path):
    import duckdb

    from cloister.llm.decontaminate import OP2_SQL, op2_decontaminate

    bench = [(None, "a b c d e f g h i j"), (None, "go on"), (3, "go on"), (4, None)]
    docs = [(1, "x A b c d e f g h i j y"), (2, "we go on, go on"), (3, None), (4, "a b c")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in op2_decontaminate(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(OP2_SQL).fetchall())
    assert [r[2:4] for r in got] == [(10, 1), (4, 2), (0, 0), (0, 0)]
