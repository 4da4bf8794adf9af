import corpus_pipeline as cp
import pytest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def _texts(df):
    return sorted(r["text"] or "" for r in df.select("text").collect())


@pytest.mark.parametrize("ids", ["CAST(NULL AS long)", "CAST(5 AS long)"])
def test_decisions_are_each_rows_own(spark, docs, ids):
    """Rows of null or of one repeated id, fitted on nothing else, are kept and dropped as under ids of their own."""
    for stage, least in ((cp.language_id, 0), (cp.quality, 1), (cp.decontamination, 1)):
        odd = docs.limit(0).union(spark.createDataFrame([(None, "123 !!", "en", "s", 6)], docs.schema))
        labelled = docs.union(odd.selectExpr("9000L", "text", "lang", "source", "n_chars"))
        other = docs.union(odd).selectExpr(f"{ids} AS doc_id", "text", "lang", "source", "n_chars")
        fit = {"fit_languages": lambda d, f=cp.fit_languages: f(labelled), "fit_quality": lambda d, l, f=cp.fit_quality: f(labelled, l)}
        with pytest.MonkeyPatch.context() as patch:
            for name, function in fit.items():
                patch.setattr(cp, name, function)
            want, got = _texts(stage(spark, labelled, DIR)), _texts(stage(spark, other, DIR))
        assert got == want
        assert len(got) < 201 - least


def test_near_duplicates_drop_rows_not_ids(spark, docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (1, b), (None, b), (None, c), (None, c), (8, ""), (8, None), (None, "")]
    table = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], docs.schema)
    got = [(r["doc_id"], r["text"] or "") for r in cp.near_duplicate(spark, table, DIR).collect()]
    assert sorted(got, key=str) == sorted([(5, a), (1, b), (None, c), (8, ""), (None, "")], key=str)
