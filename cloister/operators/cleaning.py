"""Fills, reshaping and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloister.functions.expr import Expr, col

_NUMERIC = T.NumericType


def fill_null(df: DataFrame, value) -> DataFrame:
    """``value`` for nulls of columns that it fits: numbers in numeric ones, also given as text in text ones."""
    out = []
    for f in df.schema:
        fits = (
            isinstance(f.dataType, T.BooleanType) if isinstance(value, bool)
            else isinstance(f.dataType, (_NUMERIC, T.StringType)) if isinstance(value, (int, float))
            else isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
        )
        c = F.col(f"`{f.name}`")
        out.append(F.coalesce(c, F.lit(value).try_cast(f.dataType)).alias(f.name) if fits else c)
    return df.select(*out)


def fill_nan(df: DataFrame, value) -> DataFrame:
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        out.append(F.when(F.isnan(c), F.lit(value)).otherwise(c).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c)
    return df.select(*out)


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] | None, variable_name: str = "variable", value_name: str = "value") -> DataFrame:
    values = list(value_vars) if value_vars else [c for c in df.columns if c not in id_vars]
    return df.unpivot(list(id_vars), values, variable_name, value_name)


def to_dummies(df: DataFrame, column: str, values: Sequence | None = None, limit: int = 1000) -> DataFrame:
    """A 0/1 column for each value of ``column``, which it replaces; values are looked up if not given, at most ``limit``."""
    if values is None:
        found = df.select(column).distinct().orderBy(column).limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"{column} has more than {limit} values")
        values = [r[0] for r in found]
    flags = [F.col(column).eqNullSafe(F.lit(v)).cast("int").alias(f"{column}_{'null' if v is None else v}") for v in values]
    return df.select(*[c for c in df.columns if c != column], *flags)


def scale_columns(names: str | Sequence[str], schema: T.StructType, formula) -> list[Expr]:
    """One expression for each column; an unknown column is an error."""
    names = [names] if isinstance(names, str) else list(names)
    for name in names:
        if name not in schema.names:
            raise ValueError(f"column {name} not found in the frame")
    return [formula(col(name)).alias(name) for name in names]


def minmax(x: Expr) -> Expr:
    return (x - x.min()) / (x.max() - x.min())


def mean_range(x: Expr) -> Expr:
    return (x - x.mean()) / (x.max() - x.min())


def max_abs(x: Expr, signed: bool = True) -> Expr:
    return (x if signed else x.abs()) / x.abs().max()


def zscore(x: Expr) -> Expr:
    return (x - x.mean()) / x.std()


def median_quantile(x: Expr) -> Expr:
    return (x - x.median()) / (x.quantile(0.75) - x.quantile(0.25))
