"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Language ID, quality, near-duplicates and decontamination keep rows of ``documents`` with its columns;
the last stage packs what is left into sequences and returns one row for each piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloister.llm.common import by_ids, materialise, read_table, scratch_path, texts
from cloister.llm.decontaminate import contamination_scanner
from cloister.llm.langid import fit_languages, language_scorer
from cloister.llm.neardup import near_duplicates
from cloister.llm.packing import pack_documents
from cloister.llm.quality import LEAST_SCORE, fit_quality, quality_scorer
from cloister.sources.scratch import remove_path, transient
from cloister.sources.ship import ship_package

#: No SQL form: the classifiers are trained and the packing is a search.  Tests hold stages against brute force.
ORACLE_SQL = None


#: Bytes of an Arrow batch in the stages, as executors hold what several operators keep; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """``BATCH_BYTES`` where the session has Spark's own limit of 64 MB."""
    if spark.conf.get(_BYTES) == "67108864b":
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def _kept(docs: DataFrame, scorer: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """Rows of ``docs`` that ``keep`` marks in what ``scorer`` says of their own texts, whatever their ids; no shuffle.
    ``scorer`` takes batches of ids and texts and returns their rows in order."""

    @F.arrow_udf("boolean")
    def kept(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = (pa.RecordBatch.from_arrays([pa.nulls(len(v), pa.int64()), v], names=["doc_id", "text"]) for v in values)
        for found in scorer(rows):
            yield keep(found)

    texts(docs, "doc_id", "text")  # sets the size of Arrow batches
    return docs.where(kept("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text the language model rejects; null, empty and letterless texts are rejected.  Each row is judged by its
    own text, so a null or repeated doc_id changes nothing."""
    _small_batches(spark)
    score = language_scorer(fit_languages(docs))

    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in score(pd.DataFrame({"doc_id": 0, "text": b.column(1).to_pandas()}) for b in batches):
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return _kept(docs, scorer, lambda found: pc.invert(found.column("rejected")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text has a predicted quality of 0, each by its own text; without labels nothing is learned and the
    network's first weights decide."""
    _small_batches(spark)
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return _kept(docs, quality_scorer(model), lambda found: pc.greater_equal(found.column("score"), LEAST_SCORE))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest doc_id, of each group of rows with near copies of a text; null ids come last.
    Texts without words have no copies, but of rows that also share their doc_id one is kept."""
    _small_batches(spark)
    row = "_row"  # rows are told apart by a key of their own
    while row.lower() in {c.lower() for c in docs.columns}:
        row += "_"
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    plain = keyed.select(F.col(row).alias("_row"), "doc_id", "text")
    found = near_duplicates(plain, words=5, percent=80, doc_id="_row").select(F.col("doc_id").alias("_row"), "n_shingles", "component_id")
    found = materialise(found.join(plain.select("_row", "doc_id"), "_row"), "copies")
    wordless = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = [F.when(~wordless, F.col("component_id")), F.when(wordless, F.col("doc_id"))]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("first"))
    kept = found.groupBy(*(g.alias(f"_{k}") for k, g in enumerate(group))).agg(first.alias("first")).select("first._row")
    gone = found.select("_row").join(kept, "_row", "left_anti").select(F.col("_row").alias(row))
    return by_ids(keyed, gone, "left_anti", row).select([F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a window of a benchmark item, with or without an id; each row by its own whole text, so null, empty
    and wordless texts and repeated rows stay."""
    _small_batches(spark)
    scanner = contamination_scanner(spark, read_table(spark, sf_dir, "benchmark"))
    return _kept(docs, scanner, lambda found: pc.equal(found.column("n_hit"), 0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens; a null or empty text is a piece of one, repeated rows are packed each."""
    _small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote besides its result, and the result before it, are deleted once it is done."""
    ship_package(spark)
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with transient():
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if last:
            remove_path(spark, last)
        last = path
    return docs
