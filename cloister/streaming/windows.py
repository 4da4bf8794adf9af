"""Time windows over streams, with the expressions of the batch operators; beyond what batch frames offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloister.functions.expr import Compile, Expr, duration_micros


def read_files(spark: SparkSession, folder: str, schema: T.StructType, format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(folder)


def _aggregates(exprs: tuple[Expr, ...]) -> list[Column]:
    if not all(e.aggregated for e in exprs):
        raise ValueError("a stream's windows take aggregates")
    return [e.build(Compile("agg")).alias(e.name) for e in exprs]


def windowed(df: DataFrame, index: str, every: str, *exprs: Expr, period: str | None = None, late: str = "10m", by: tuple[str, ...] = (), least: int | None = None) -> DataFrame:
    """Aggregates by window and ``by``; rows later than ``late`` behind the newest are dropped.  ``least`` releases only windows of
    at least so many rows, the aggregation rule of a policy applied to a stream."""
    micros = lambda d: f"{duration_micros(d)} microseconds"
    w = F.window(index, micros(period or every), micros(every))
    out = df.withWatermark(index, micros(late)).groupBy(w, *by).agg(*_aggregates(exprs), F.count(F.lit(1)).alias("__rows"))
    if least is not None:
        out = out.where(F.col("__rows") >= least)
    return out.select(F.col("window.start").alias(index), *by, *[e.name for e in exprs])


def sessions(df: DataFrame, index: str, gap: str, *exprs: Expr, late: str = "10m", by: tuple[str, ...] = ()) -> DataFrame:
    w = F.session_window(index, f"{duration_micros(gap) // 10**6} seconds")
    out = df.withWatermark(index, f"{duration_micros(late)} microseconds").groupBy(w, *by).agg(*_aggregates(exprs))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *[e.name for e in exprs])


def drain(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; exactly once into parquet files."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
