import math
import os

import numpy as np
import pytest

from cloister.llm import ann
from cloister.llm.ann import fit_cells, fit_quantiser, search
from cloister.llm.shards import ManifestConflict, Shard, ShardStore, load_in_arrivals, plan_merges, tier


def _vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x[2000:2400] = x[7]  # a hot vector
    x[2400:2900] = x[8] + rng.normal(scale=1e-3, size=(500, 32)).astype(np.float32)  # and one with near copies
    got = {}
    for r in search(_vectors(spark, list(enumerate(x))), "vec_id % 20 = 0", k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = x.astype(np.float64)
    hit = 0
    for q in range(0, 4000, 20):
        score = exact @ exact[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(4000), -score))[:10]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11))
        assert all(math.isclose(s, score[i], abs_tol=1e-12) for _, i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hit += len({i for _, i, _ in rows} & set(want.tolist()))
    assert hit >= 0.97 * 2000


def test_odd_vectors(spark):
    rows = [(0, [1, 0, 0]), (1, [2, 0, 0]), (2, None), (3, [0, 0, 0]), (4, [math.nan, 1, 1]), (5, [math.inf, 1, 1]), (6, [None, 1, 1]), (7, [1, 1]), (20, [1, 0, 0]), (1, [2, 0, 0]), (None, [1, 1, 1])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(_vectors(spark, rows), "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, 1.0), (20, 1, 1, 2.0), (20, 2, 0, 1.0)]
    assert search(_vectors(spark, []), "vec_id = 0").collect() == []
    assert search(_vectors(spark, [(3, [1, 2])]), "vec_id = 3").collect() == []
    assert search(_vectors(spark, [(3, [1, 2]), (4, [1, 3])]), "vec_id = 99").collect() == []


def test_anisotropic_codes_lower_the_parallel_error():
    x = np.random.default_rng(2).normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    errors = []
    for threshold in (0.0, 0.3):
        quantiser = fit_quantiser(x, threshold=threshold)
        back = quantiser.centres[np.arange(16), quantiser.encode(x)].reshape(len(x), -1)
        errors.append(float((((x - back) * x).sum(1) ** 2).mean()))
    assert errors[1] < errors[0]


def test_tiers_and_plans():
    assert tier(100, 100) == 0 and tier(80, 100) == 0 and tier(60, 100) == 1 and tier(20, 100) == 2
    shards = [Shard(f"a{i}", 10, 1) for i in range(9)] + [Shard("big", 90, 1), Shard("mid", 40, 1)]
    groups = plan_merges(shards, 100)
    assert {s.path for g in groups for s in g} <= {f"a{i}" for i in range(9)}
    assert all(4 <= len(g) and sum(s.bytes for s in g) <= 125 for g in groups)
    assert plan_merges(shards[-2:], 100) == []


def _names(store):
    return sorted(s.path for s in store.shards())


def test_store(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=40_000, fan_in=4)
    assert store.read() is None and store.compact() == 0 and store.vacuum() == 0
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 9 = 0, NULL, sha2(string(id), 256)) AS text", "'x' AS _shard_note").repartition(3)
    versions = [store.append(docs.where(f"doc_id % 5 = {k}")) for k in range(5)]
    assert versions == [1, 2, 3, 4, 5] and len(store.shards()) == 15
    assert store.append(docs.limit(0)) >= 5
    before = store.version()
    old = sorted(map(str, store.read(before).select("doc_id", "text").collect()))
    assert store.compact() > before
    assert len(store.shards()) < 15 and sum(s.rows for s in store.shards()) == 4000
    assert sorted(map(str, store.read().select("doc_id", "text").collect())) == old
    assert sorted(map(str, store.read(before).select("doc_id", "text").collect())) == old  # old versions can be read until vacuum
    again = _names(store)
    store.compact()
    assert _names(store) == again  # nothing is rewritten without need
    assert store.vacuum() > 0
    assert store.read().count() == 4000


def test_one_of_two_commits_wins(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(5).selectExpr("id AS doc_id"))
    base, live = store.version(), store.shards()
    store.commit(live, base)
    with pytest.raises(ManifestConflict):
        store.commit([], base)
    assert store.shards() == live and store.version() == base + 1
    assert not [f for f in os.listdir(tmp_path / "s/_manifests") if "draft" in f and not f.endswith(".crc")]


def test_arrivals_keep_every_row(spark, tmp_path):
    rows = [(i % 50, f"t{i}") for i in range(300)] + [(None, "n"), (None, None), (7, ""), (8, "long " * 100_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=2000)
    load_in_arrivals(store, table, "doc_id")
    assert sorted(map(str, store.read().select("doc_id", "text").collect())) == sorted(map(str, table.collect()))
    clash = ShardStore(spark, f"file://{tmp_path}/c")
    clash.append(table.selectExpr("doc_id", "text AS _shard"))
    assert sorted(map(str, clash.read().select("_shard").collect())) == sorted(map(str, table.selectExpr("text AS _shard").collect()))
    other = ShardStore(spark, f"file://{tmp_path}/t")
    load_in_arrivals(other, table.where("doc_id is null"), "doc_id")
    assert other.read().count() == 2


def test_cells_prune_clusters_only():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 32))
    clustered = middle[rng.integers(0, 40, 4000)] + rng.normal(scale=0.1, size=(4000, 32))
    _, few = fit_cells(clustered, 64, 10)
    _, many = fit_cells(rng.normal(size=(4000, 32)), 64, 10)
    assert few <= 12 < many <= 64


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_over_cells_and_blocks(spark, monkeypatch, clustered):
    for name, value in (("LEAST_CELL", 100), ("VECTOR_BLOCK", 200), ("QUERY_BLOCK", 20)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    if clustered:
        x = rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)] + 0.2 * x
    x[1000:1900] = x[5] + rng.normal(scale=1e-3, size=(900, 32))  # a cell with a third of the rows
    found = {}
    for r in search(_vectors(spark, list(enumerate(x.astype(np.float32)))), "vec_id % 20 = 0", k=10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact, hit = x.astype(np.float32).astype(np.float64), 0
    for q in range(0, 3000, 20):
        score = exact @ exact[q]
        score[q] = -np.inf
        hit += len(found[q] & set(np.lexsort((np.arange(3000), -score))[:10].tolist()))
    assert hit >= 0.97 * 1500
