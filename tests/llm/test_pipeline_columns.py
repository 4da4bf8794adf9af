"""Columns with the names that stages use inside keep their values."""

import pytest

import corpus_pipeline

NAMES = ["_row", "_row_", "_0", "_1", "first", "n_shingles", "component_id", "kept", "rejected", "score", "_task", "_local", "ids", "n_hit", "a.b"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_clashing_columns(spark, stage):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = dict(corpus_pipeline.STAGES)[stage]
    if stage == "near_duplicates":
        docs = docs.limit(60)
    wide = docs
    for name in NAMES:
        wide = wide.selectExpr("*", f"concat('mine ', doc_id) AS `{name}`")
    found = plain(spark, wide, folder)
    assert found.columns == wide.columns
    rows = found.collect()
    assert all(r[n] == f"mine {r['doc_id']}" for r in rows for n in NAMES)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in plain(spark, docs, folder).collect()} and rows
