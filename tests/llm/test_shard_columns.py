import pytest

from cloister.llm.shards import ShardStore


def test_compaction_keeps_columns_of_every_arrival(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    tables = [
        spark.createDataFrame([(1, "a")], "doc_id long, text string"),
        spark.createDataFrame([(2, "b", "en")], "doc_id long, text string, lang string"),
        spark.createDataFrame([(3, 0.5)], "doc_id long, score double"),
        spark.createDataFrame([(4, "d", "de")], "doc_id long, text string, lang string"),
    ]
    for table in tables:
        store.append(table.coalesce(1))
    store.compact()
    assert store.vacuum() > 0
    assert len(store.shards()) == 1
    got = sorted(tuple(r) for r in store.read().select("doc_id", "text", "lang", "score").collect())
    assert got == [(1, "a", None, None), (2, "b", "en", None), (3, None, None, 0.5), (4, "d", "de", None)]


def test_clashing_types_and_metadata_columns(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([(1, "a", "m")], "doc_id long, text string, _metadata string").coalesce(1))
    store.append(spark.createDataFrame([(2, None, None)], "doc_id long, text string, _metadata string").coalesce(1))
    with pytest.raises(ValueError, match="text is string"):
        store.append(spark.createDataFrame([(3, 1)], "doc_id long, text long"))
    assert store.version() == 2
    assert sorted((r["doc_id"], r["_metadata"]) for r in store.read().select("doc_id", "_metadata").collect()) == [(1, "m"), (2, None)]


def test_version_before_stays_readable(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=10_000)
    for k in range(4):
        store.append(spark.range(k * 10, k * 10 + 10).selectExpr("id AS doc_id").coalesce(1))
    store.compact()
    assert store.vacuum(versions=2) == 0 and store.read(4).count() == store.read(5).count() == 40
    assert store.vacuum() == 4 and store.read().count() == 40
