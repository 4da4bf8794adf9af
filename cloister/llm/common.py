"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloister.sources.scratch import materialise, scratch_path

#: At most so many ids are broadcast.
BROADCAST_IDS = 1_000_000


#: Rows of texts that a Python worker gets at once, unless the session sets another number.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts(docs: DataFrame, doc_id: str | None, text: str) -> DataFrame:
    """``doc_id`` as a long and ``text`` of a table, for Python workers.

    Sets the session's Arrow batch to ``BATCH_ROWS`` rows if it is Spark's own default, so that a worker's memory does
    not depend on how long ten thousand texts are.
    """
    if docs.sparkSession.conf.get(_BATCH) == "10000":
        docs.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    ids = [] if doc_id is None else [F.col(doc_id).cast("long").alias("doc_id")]
    return docs.select(*ids, F.col(text).alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_ids(rows: DataFrame, ids: DataFrame, how: str, column: str = "doc_id") -> DataFrame:
    """Rows whose id is ("left_semi") or is not ("left_anti") in ``ids``.  Ids are written and counted: few of them
    go to the rows, which then stay where they are; many are joined by a shuffle of both."""
    ids = materialise(ids.select(column).distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


__all__ = ["by_ids", "materialise", "read_table", "scratch_path", "texts"]
