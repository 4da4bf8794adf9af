"""The filter audit against documents sent through every order of filters one by one, and its SQL."""

import itertools
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloister.llm.audit import OP13_SQL, Polynomial, audit, audit_part, op13_filter_audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    least, marks, out = {}, defaultdict(lambda: [False, False]), []
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    for doc_id, quality, toxic in labels:
        marks[doc_id] = [marks[doc_id][0] or quality == 1, marks[doc_id][1] or toxic == 1]
    parts = defaultdict(list)
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = doc_id is not None and doc_id > least[text]
        parts[lang or ""].append((frozenset(k for k, v in fails.items() if v), *(marks[doc_id] if doc_id is not None else (False, False))))
    for part, rows in parts.items():
        removed_by, lines = defaultdict(int), []
        for order in itertools.permutations("ABCDE"):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[0]]
                redundant = sum(f in r[0] for r in gone)
                left, gone = [r for r in left if f not in r[0]], gone + lost
                removed_by[f] += len(lost)
                lines.append((part, "".join(order), step, len(left), len(lost), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in lost), sum(r[2] for r in lost), f))
        out += [(*line[:-1], removed_by[line[-1]]) for line in lines]
    return sorted(out)


def tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def found(spark, folder):
    return sorted(tuple(r[c] for c in COLUMNS) for r in op13_filter_audit(spark, folder).collect())


def by_sql(folder, files=""):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{files}')")
    return sorted(c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall())


def test_edge_cases(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (3, long, "de"), (3, long, "de"), (1, long, "de"), (None, long, "en"), (None, long, None), (4, None, "en"), (5, "", ""), (6, "", None), (7, "a " * 300, "en"),
        (8, "ABC" + long, "en"), (9, long.upper() + " #", "fr"), (10, "x y z " * 200, "fr"), (11, "\x0b\t \n", "fr"), (12, long + "\x00|", "fr"), (13, "ÄÖ" * 100, "fr"), (14, "A" * 3 + "b" * 97, "fr"), (15, "A" * 4 + "b" * 96, "fr"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 1), (7, 1, 1), (8, 0, 0), (99, 1, 1)]
    folder = tables(spark, tmp_path, docs, labels)
    assert found(spark, folder) == brute(docs, labels) == by_sql(folder, "/*.parquet")


def test_whole_small_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found(spark, folder) == brute(docs, labels) == by_sql(folder)


def test_empty_and_clashing_columns(spark, tmp_path):
    assert found(spark, tables(spark, tmp_path / "none", [], [])) == []
    docs = [(1, "a", "en"), (2, "a", "en")]
    folder = tables(spark, tmp_path / "some", docs, [])
    extra = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as mask", "'x' as part", "2 as n", "'y' as _same", "true as good")
    extra.write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.createDataFrame([(1, 1, 1, "x")], "doc_id long, quality int, toxic int, part string").write.parquet(f"{tmp_path}/more/labels.parquet")
    assert found(spark, f"{tmp_path}/more") == brute(docs, [(1, 1, 1)])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 7), st.integers(0, 9)))
def test_polynomial(counts):
    """Corners are unions of filters, and the integral is the mean over orders of what a filter removes."""
    f = Polynomial.removal(counts)
    union = lambda s: sum(n for m, n in counts.items() if m & s)
    assert [f.corner(s) for s in range(8)] == [union(s) for s in range(8)]
    for i in range(3):
        gains = [union(sum(1 << j for j in order[: order.index(i) + 1])) - union(sum(1 << j for j in order[: order.index(i)])) for order in itertools.permutations(range(3))]
        assert f.diagonal_integral(i) == Fraction(sum(gains), 6)


def test_other_numbers_of_filters(spark):
    rows = audit(spark.createDataFrame([(None, 3, 2, 1, 0), (None, 3, 1, 0, 0), (None, 1, 4, 0, 2), (None, 0, 5, 0, 0)], "part string, mask int, n long, good long, toxic long"), "XY").collect()
    got = {(r["filter_order"], r["step"]): (r["part"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}
    assert got == {("XY", 1): (None, 5, 7, 0, 4, 1, 2, 11), ("XY", 2): (None, 5, 0, 3, 0, 0, 0, 3), ("YX", 1): (None, 9, 3, 0, 0, 1, 0, 3), ("YX", 2): (None, 5, 4, 3, 4, 0, 2, 11)}
    with pytest.raises(KeyError):
        audit_part({"n": {}})
