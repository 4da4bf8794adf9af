import corpus_pipeline as cp
import pytest

from cloister.llm.decontaminate import find_contamination
from cloister.llm.langid import fit_languages, identify_languages
from cloister.llm.quality import fit_quality, score_quality
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_neardup import brute as brute_neardup

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_take_effect(spark, docs):
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns, name
    language = identify_languages(docs, fit_languages(docs)).where("not rejected")
    assert _ids(cp.language_id(spark, docs, DIR)) == _ids(language)
    good = score_quality(docs, fit_quality(docs, spark.read.parquet(f"{DIR}/labels.parquet"))).where("predicted = 1")
    assert _ids(cp.quality(spark, docs, DIR)) == _ids(good)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _ids(cp.near_duplicate(spark, docs, DIR)) == sorted(d for d, _, _, kept in brute_neardup(rows, 5, 80) if kept)
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert _ids(cp.decontamination(spark, docs, DIR)) == sorted(d for d, t in rows if not brute_contamination(t, items, 10)[1])
    assert find_contamination(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).where("n_hit > 0").count() > 0


def test_run_on_odd_rows(spark, docs, tmp_path):
    odd = spark.createDataFrame(
        [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "The of and this is a text of the word", "en", "s", 1), (5, None, "en", "s", 1)], docs.schema
    )
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{DIR}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.union(docs.where("doc_id < 20")).union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.groupBy("doc_id", "piece").count().where("count > 1 and doc_id is not null").count() == 0
    for sequence in got.groupBy("sequence_id").agg({"length": "sum"}).collect():
        assert sequence["sum(length)"] <= 1024


def test_run_on_empty_tables(spark, docs, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_superseded_tables_are_deleted(spark, monkeypatch, tmp_path):
    from cloister.sources import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda session: f"file://{tmp_path}")
    got = cp.run(spark, DIR)
    left = [p.name.rsplit("-", 1)[0] for p in (tmp_path / "cloister").iterdir() if p.is_dir()]
    assert left == ["pipeline-packing"]
    assert got.count() > 0


def test_language_and_quality_stages_against_plain_scoring(spark, docs):
    """The stages keep what plain Python computes from their models."""
    import numpy as np

    from cloister.llm import quality
    from tests.llm.test_classifiers import naive_grams

    model = fit_languages(docs)
    kept = {r["doc_id"] for r in cp.language_id(spark, docs, DIR).collect()}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    for doc, text in rows:
        grams = naive_grams(text)
        if not grams:
            assert doc not in kept
            continue
        z = model.table[grams].astype(float).sum(axis=0) / len(grams) + model.bias
        odds = np.exp(z - z.max())
        score, rare = odds.max() / odds.sum(), model.known[grams].astype(float).mean() - model.least_known[len(grams).bit_length() - 1]
        if min(abs(score - model.least), abs(rare)) > 1e-4:
            assert (doc in kept) == (score >= model.least and rare >= 0)
    fitted = fit_quality(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    good = {r["doc_id"] for r in cp.quality(spark, docs, DIR).collect()}
    for doc, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        x = (quality.document_features(data, np.array([0, len(data)]), fitted.vectors)[0] - fitted.mean) / fitted.scale
        z = np.maximum(x @ fitted.first[0] + fitted.first[1], 0) @ fitted.second[0] + fitted.second[1]
        score = 1 / (1 + np.exp((z[0] - z[1]) / fitted.temperature))
        if abs(score - quality.LEAST_SCORE) > 1e-4:
            assert (doc in good) == (score >= quality.LEAST_SCORE)
