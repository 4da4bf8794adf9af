"""Vector codes against a plain version in Python's integers, and against the SQL on edge cases."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from cloister.llm import codebooks
from cloister.llm.codebooks import OP12_SQL, compress, decompress, nearest_entries, op12_vector_codes, with_group_sums

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, m: v[m * width : (m + 1) * width]
    books = [[cut(v, m) for _, v, _ in kept[:entries]] for m in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: [min((far(cut(v, m), e), k) for k, e in enumerate(books[m])) for m in range(parts)]
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for m, (_, k) in enumerate(near(v)):
                groups[m, k].append(cut(v, m))
        for (m, k), own in groups.items():
            books[m][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    coded = [(i, "".join(f"{k:02x}" for _, k in near(v)), sum(d for d, _ in near(v)), label) for i, v, label in kept]
    totals = defaultdict(int)
    for _, _, error, label in coded:
        totals[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[label], digest) for i, c, e, label in coded), key=repr)


def table(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def found(spark, folder):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in op12_vector_codes(spark, folder).collect()), key=repr)


def by_sql(folder):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    return sorted((tuple(r) for r in c.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({OP12_SQL})").fetchall()), key=repr)


@pytest.mark.parametrize("n", [1, 5, 64, 150])
def test_against_plain_python(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 32)], int(rng.integers(3)) if rng.random() < 0.8 else None) for i in rng.permutation(n)]
    rows += [(9000 + k, list(rows[0][1]), 7) for k in range(20)]  # equal vectors
    folder = table(spark, rows, tmp_path)
    assert found(spark, folder) == brute(rows) == by_sql(folder)


def test_nulls_repeats_and_extremes(spark, tmp_path):
    v = [0.25, -0.004] * 8
    rows = [(1, v, 0), (1, v, 0), (1, [-x for x in v], None), (None, v, None), (2, None, 0), (3, [None, *v[1:]], 0), (4, [math.nan, *v[1:]], 0), (5, [math.inf, *v[1:]], 0), (6, [1000.0, *v[1:]], 0), (7, [], 0)][:9]
    folder = table(spark, rows, tmp_path)
    assert found(spark, folder) == brute(rows) == by_sql(folder)


def test_empty_and_unusable(spark, tmp_path):
    assert found(spark, table(spark, [], tmp_path / "none")) == []
    assert found(spark, table(spark, [(1, None, 1), (2, [math.nan] * 16, 1)], tmp_path / "nulls")) == []
    for rows in ([(1, [1.0] * 15, 1)], [(1, [], 1)], [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)]):
        with pytest.raises(ValueError, match="length"):
            compress(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(Exception, match="64 rows|256"):
        compress(spark.createDataFrame([], SCHEMA), entries=257)
    with pytest.raises(OverflowError):
        compress(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA))


def test_ties_take_the_first_entry_and_distances_are_exact():
    books = np.array([[[3], [1], [1]]])
    codes, error = nearest_entries(np.array([[2], [1], [0]]), books)
    assert codes.ravel().tolist() == [0, 1, 1] and error.ravel().tolist() == [1, 0, 1]
    big = int(codebooks.largest_component(2))
    codes, error = nearest_entries(np.array([[big, -big]]), np.array([[[-big, big], [big - 1, -big]]]))
    assert codes.tolist() == [[1]] and error.tolist() == [[1]]


def test_other_columns_and_decompression(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 16)], 0, "x", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, _x string, error int")
    coded, books = compress(df)
    assert coded.columns == ["vec_id", "label", "code", "error"]
    back = {r["vec_id"]: r for r in decompress(coded, books).collect()}
    assert all(r["error"] == 0 and r["vector"] == rows[i][1] for i, r in back.items()) and len(back) == 300  # each part takes four values


@pytest.mark.parametrize("share", [1, 3, 10**6])
def test_group_sums_by_either_way(spark, monkeypatch, share):
    monkeypatch.setattr(codebooks, "HOT_SHARE", share)
    rows = [(i, None if i % 7 == 0 else 0 if i % 3 else i % 50, i) for i in range(400)]
    got = with_group_sums(spark.createDataFrame(rows, "id long, k int, v long"), "k", "v", "s").collect()
    sums = defaultdict(int)
    for _, k, v in rows:
        sums[k] += v
    assert sorted((r["id"], r["s"]) for r in got) == [(i, sums[k]) for i, k, _ in rows]
