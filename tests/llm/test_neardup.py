import random
import re

import pytest

from cloister.llm import neardup
from cloister.llm.components import connected_components
from cloister.llm.neardup import near_duplicates


def shingles(text, k):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {(doc, len(sets[i]), least[root(i)], doc == least[root(i)]) for i, (doc, _) in enumerate(rows)}


def _families(seed, families, size, n_words, edits):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(families):
        base = [word() for _ in range(n_words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("size", "n_words", "edits"), [(2, 30, 3), (40, 60, 4), (60, 40, 3), (3, 5, 1), (4, 2, 1)])
def test_against_brute_force(spark, monkeypatch, size, n_words, edits):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 20)  # so that groups are cut into several blocks
    rows = _families(size, max(2, 120 // size), size, n_words, edits)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=80)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 80)


def test_edges(spark):
    rows = [
        (5, "A b c d e"), (3, "a\tB  c\nd e "), (9, None), (8, ""), (7, "  \n"), (2, "one"), (4, "ONE"), (1, "é É"), (6, "É é"), (3, "a\tB  c\nd e "),
        (10, "same " * 50_000), (11, "same " * 49_000),
    ]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, component_id int, bands string")
    got = sorted(tuple(r) for r in near_duplicates(docs, words=4).collect())
    assert got == sorted([
        (1, 1, 1, True), (2, 1, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 2, False), (5, 2, 3, False), (6, 1, 6, True), (7, 0, 7, True),
        (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False),
    ])
    assert near_duplicates(docs.limit(0)).collect() == []
    null = near_duplicates(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).first()
    assert (null["component_id"], null["kept"]) == (None, True)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5000, i) for i in range(5001, 6000)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            la, lb = want.setdefault(a, {a}), want.setdefault(b, {b})
            if la is not lb:
                la |= lb
                for x in lb:
                    want[x] = la
    assert got == {k: min(v) for k, v in want.items()}


def test_repeated_ids_are_one_document(spark, tmp_path):
    import duckdb

    from cloister.llm.neardup import OP3_SQL, op3_near_duplicates

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a.replace("a7 ", "z ")
    rows = [(1, a), (3, a), (2, b), (3, b), (5, c), (5, c), (9, near), (9, None), (8, "lone words of their own"), (8, "other words than those"), (8, ""), (7, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op3_near_duplicates(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(OP3_SQL).fetchall(), key=str)
    assert {(d, c) for d, n, c, _ in got if n} == {(1, 1), (3, 1), (2, 1), (5, 5), (9, 1), (8, 8), (None, None)}


def test_hot_id_with_many_texts(spark):
    rows = [(1, f"hot text number {i} of this one doc {i}") for i in range(800)] + [(2, "hot text number 3 of this one doc 3"), (4, "quite another text than all those")]
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (4, 4)}


@pytest.mark.parametrize("leaders", [0, 8])
def test_group_around_a_centre(spark, monkeypatch, leaders):
    """Copies of one text that are near it but often not near each other, found with and without leaders."""
    monkeypatch.setattr(neardup, "LEADERS", leaders)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 30)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    rows = [(200, " ".join(base))]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=80)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 80)
