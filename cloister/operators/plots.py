"""Tables behind plots: what a drawing library needs, aggregated on the cluster."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloister.functions.expr import col
from cloister.operators.ordered import group_quantiles

ESTIMATORS = ("mean", "count", "max", "min", "std", "sum", "median")


def estimates(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """``keys, value``: one estimate for each group, of all rows without keys."""
    found = {"mean": F.avg, "count": lambda c: F.count(F.lit(1)), "max": F.max, "min": F.min, "std": F.stddev_samp, "sum": F.sum}
    if name not in ESTIMATORS:
        raise ValueError(f"estimator must be one of {', '.join(ESTIMATORS)}")
    if name != "median":
        return df.groupBy(*keys).agg(found[name](F.col(column)).cast("double").alias("value"))
    medians = group_quantiles(df, [F.col(k) for k in keys], F.col(column), {"value": (0.5, "linear")})
    if not keys:
        return df.limit(0).agg(F.count(F.lit(1))).select().join(medians, F.lit(True), "left")  # one row, also without values
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).join(medians, same, "left").select(*keys, "value")


def known(df: DataFrame, *names: str | None) -> list[str]:
    used = [n for n in dict.fromkeys(names) if n is not None]
    for name in used:
        if name not in df.columns:
            raise ValueError(f"column {name} not found in the frame")
    return used


def histogram(df: DataFrame, x: str, bins: float = 10, y: str | None = None) -> DataFrame:
    """Counts by bins of width ``bins`` of x, and by values of y if given, as ``bin, (y,) count``; nulls are left out."""
    known(df, x, y)
    binned = df.where(F.col(x).isNotNull()).select((F.floor(F.col(x) / bins) * bins).cast("double").alias("bin"), *([F.col(y)] if y else []))
    return binned.groupBy("bin", *([y] if y else [])).agg(F.count(F.lit(1)).alias("count")).orderBy("bin", *([y] if y else []))


def histogram_grid(df: DataFrame, x: str, y: str, bins: float = 10, values: Sequence | None = None) -> DataFrame:
    """A row for each y, a column for each bin of x."""
    return histogram(df, x, bins, y).groupBy(y).pivot("bin", list(values) if values else None).sum("count").orderBy(y)


def bars(df: DataFrame, x: str | None = None, y: str | None = None, hue: str | None = None, estimator: str = "mean") -> DataFrame:
    """``x, (hue,) value``: one estimate for each x (and hue); with one axis only, the estimate of all its rows."""
    if x is None and y is None:
        raise ValueError("give x or y")
    known(df, x, y, hue)
    if x is None or y is None:
        name = x or y
        return estimates(df.where(F.col(name).isNotNull()), [], name, estimator)
    keys = [x, *([hue] if hue else [])]
    return estimates(df, keys, y, estimator).orderBy(*keys)


def lines(df: DataFrame, x: str, y: str, hue: str | None = None, size: str | None = None, style: str | None = None, units: str | None = None) -> DataFrame:
    return df.select(*known(df, x, y, hue, size, style, units))


def points(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    return df.select(*known(df, x, y, hue))


def boxes(frame, y: str, x: str | None = None) -> DataFrame:
    """``(x,) min, q25, median, q75, max, iqr`` of a guarded frame; no outliers, for they would show single rows."""
    known(frame.df, x, y)
    v = col(y)
    rows = frame.filter(v.is_not_null())
    aggregates = [v.min().alias("min"), v.quantile(0.25).alias("q25"), v.median().alias("median"), v.quantile(0.75).alias("q75"), v.max().alias("max")]
    out = (rows.groupby(x).agg(*aggregates) if x else rows.select(*aggregates)).df
    out = out.withColumn("iqr", F.col("q75") - F.col("q25"))
    return out.orderBy(x) if x else out


def pie(df: DataFrame, parts: str, labels: str) -> DataFrame:
    """``label, percent``; a null label is "null"."""
    known(df, parts, labels)
    total = df.agg(F.sum(parts).alias("__total"))
    share = F.try_divide(F.col(parts) * 100.0, F.col("__total"))
    return df.crossJoin(F.broadcast(total)).select(F.coalesce(F.col(labels).cast("string"), F.lit("null")).alias("label"), share.alias("percent"))


def facet_counts(df: DataFrame, x: str, bins: float, col: str | None = None, row: str | None = None) -> DataFrame:
    keys = known(df, col, row)
    binned = df.where(F.col(x).isNotNull()).withColumn("bin", (F.floor(F.col(x) / bins) * bins).cast("double"))
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")).orderBy(*keys, "bin")


def facet_bars(df: DataFrame, x: str, y: str, estimator: str = "mean", col: str | None = None, row: str | None = None) -> DataFrame:
    keys = [*known(df, col, row), x]
    return estimates(df, keys, y, estimator).orderBy(*keys)


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(*known(df, column)).distinct().orderBy(column)
