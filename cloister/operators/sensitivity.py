"""Sensitivities carried by column expressions, through arithmetic and grouping, to the noise of a release.

A ``Bounded`` column knows the interval that its values lie in.  Summed up over groups it knows how far one sample moves a
group's sum, and further arithmetic on sums keeps that up to date: terms of the same samples add up, terms of disjoint samples
count once.  A release adds noise for it on the executors, so neither values nor groups pass the driver; what has no bound is refused.

Data sets are neighbours if one has the samples of one unit more than the other.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloister.operators.privacy import PrivacyContext, sigma

#: Which of two parts of a table a row is in, at each split.
Region = tuple[tuple[int, bool], ...]


def _disjoint(a: Region, b: Region) -> bool:
    """Whether the two paths part ways at a split that both took."""
    other = dict(b)
    return any(split in other and other[split] != side for split, side in a)


@dataclass(frozen=True)
class Bounded:
    """A numeric column whose values are from ``low`` to ``high`` or null; None for an end that is not known."""

    column: Column
    low: float | None = None
    high: float | None = None

    @property
    def size(self) -> float | None:
        """The largest absolute value."""
        return None if self.low is None or self.high is None else max(abs(self.low), abs(self.high))

    def clamp(self, low: float, high: float) -> Bounded:
        """Values beyond an end become that end; NaN becomes null."""
        if not (math.isfinite(low) and math.isfinite(high) and low <= high):
            raise ValueError("the ends must be finite and in order")
        value = self.column.cast("double")
        held = F.when(~F.isnan(value), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))
        ends = (low if self.low is None else min(max(self.low, low), high), high if self.high is None else max(min(self.high, high), low))
        return Bounded(held, *map(float, ends))

    def _pair(self, other, f, ends) -> Bounded:
        if not isinstance(other, Bounded):
            if not math.isfinite(other):
                raise ValueError("constants must be finite")
            other = Bounded(F.lit(float(other)), float(other), float(other))
        known = None not in (self.low, self.high, other.low, other.high)
        return Bounded(f(self.column, other.column), *(ends(self, other) if known else (None, None)))

    def __add__(self, other) -> Bounded:
        return self._pair(other, lambda a, b: a + b, lambda a, b: (a.low + b.low, a.high + b.high))

    def __sub__(self, other) -> Bounded:
        return self._pair(other, lambda a, b: a - b, lambda a, b: (a.low - b.high, a.high - b.low))

    def __mul__(self, other) -> Bounded:
        def ends(a: Bounded, b: Bounded) -> tuple[float, float]:
            corners = [x * y for x in (a.low, a.high) for y in (b.low, b.high)]
            return min(corners), max(corners)

        return self._pair(other, lambda a, b: a * b, ends)

    def __truediv__(self, factor: float) -> Bounded:
        return self * (1 / factor)

    __radd__, __rmul__ = __add__, __mul__

    def abs(self) -> Bounded:
        if self.size is None:
            return Bounded(F.abs(self.column))
        return Bounded(F.abs(self.column), 0.0 if self.low <= 0 <= self.high else min(abs(self.low), abs(self.high)), self.size)


@dataclass(frozen=True)
class PrivateSum:
    """A sum over the rows of a group.  ``bound``: how far one unit moves it, None if not known; ``regions``: the parts of the table that it reads."""

    column: Column
    bound: float | None
    regions: frozenset[Region]

    def _join(self, other: PrivateSum, column: Column) -> PrivateSum:
        if None in (self.bound, other.bound):
            bound = None
        elif all(_disjoint(a, b) for a in self.regions for b in other.regions):
            bound = max(self.bound, other.bound)
        else:
            bound = self.bound + other.bound
        return PrivateSum(column, bound, self.regions | other.regions)

    def __add__(self, other) -> PrivateSum:
        return self._join(other, self.column + other.column) if isinstance(other, PrivateSum) else replace(self, column=self.column + other)

    def __sub__(self, other) -> PrivateSum:
        return self._join(other, self.column - other.column) if isinstance(other, PrivateSum) else replace(self, column=self.column - other)

    def __mul__(self, factor: float) -> PrivateSum:
        return replace(self, column=self.column * factor, bound=None if self.bound is None else self.bound * abs(factor))

    def __truediv__(self, factor: float) -> PrivateSum:
        return self * (1 / factor)

    def clamp(self, low: float, high: float) -> PrivateSum:
        width = float(high - low)
        return replace(self, column=F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), self.column)), bound=width if self.bound is None else min(width, self.bound))


@dataclass(frozen=True)
class PrivateTable:
    """Rows of which each unit has ``rows_per_unit`` at most.  ``condition`` says which rows belong to this part of the table."""

    df: DataFrame
    context: PrivacyContext
    rows_per_unit: int = 1
    condition: Column | None = None
    region: Region = ()

    @staticmethod
    def of(df: DataFrame, context: PrivacyContext, unit: str | None = None, rows_per_unit: int = 1) -> PrivateTable:
        """A table whose rows are samples; or, with ``unit``, whose units are protected: of each only ``rows_per_unit`` rows count, chosen by a hash.
        A unit with more rows than fit in a task is no limit to that, as rows are ranked after those that cannot be chosen are gone from each task."""
        if unit is None:
            return PrivateTable(df, context)
        order = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        first = Window.partitionBy(unit, "__task").orderBy("__hash")
        dealt = df.withColumns({"__hash": order, "__task": F.spark_partition_id()}).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= rows_per_unit)
        kept = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(unit).orderBy("__hash"))).where(F.col("__n") <= rows_per_unit)
        return PrivateTable(kept.drop("__hash", "__task", "__n"), context, rows_per_unit)

    def col(self, name: str) -> Bounded:
        return Bounded(F.col(f"`{name}`"))

    def where(self, condition: Column) -> PrivateTable:
        """Fewer rows move no sum farther."""
        return replace(self, condition=condition if self.condition is None else self.condition & condition)

    def split(self, condition: Column) -> tuple[PrivateTable, PrivateTable]:
        """The rows where it holds, and all others; no row is in both."""
        key, holds = secrets.randbits(62), F.coalesce(condition, F.lit(False))
        return tuple(replace(self.where(c), region=(*self.region, (key, side))) for side, c in ((True, holds), (False, ~holds)))

    def sum(self, value: Bounded) -> PrivateSum:
        """The sum of the values of this part's rows, nulls as zeros."""
        column = F.coalesce(value.column.cast("double"), F.lit(0.0))
        column = column if self.condition is None else F.when(self.condition, column).otherwise(0.0)
        return PrivateSum(F.coalesce(F.sum(column), F.lit(0.0)), None if value.size is None else value.size * self.rows_per_unit, frozenset([self.region]))

    def count(self) -> PrivateSum:
        return self.sum(Bounded(F.lit(1.0), 1.0, 1.0))

    def release(self, epsilon: float, by: Sequence[str] = (), keys: DataFrame | None = None, **sums: PrivateSum) -> DataFrame:
        """``by``, and for each of ``sums`` its noisy value and, as ``<name>_sigma``, the noise's deviation; ``epsilon`` pays for all of them.

        A unit's rows may be in ``rows_per_unit`` groups, which its bound allows for.  Which groups exist is told by the data, unless ``keys``
        has the ones that are asked for: those without rows then have noise as well, and others are left out.
        """
        unknown = [name for name, s in sums.items() if s.bound is None]
        if unknown:
            raise ValueError(f"the sensitivity of {', '.join(unknown)} is not known: clamp its columns first")
        if not sums:
            raise ValueError("nothing is released")
        found = self.df.groupBy(*by).agg(*[s.column.alias(name) for name, s in sums.items()])
        if keys is not None:
            own = keys.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in by]).distinct()
            empty = self.df.where(F.lit(False)).agg(*[s.column.alias(f"__{name}") for name, s in sums.items()]).first()  # what a group without rows has
            same = [F.col(f"`__{k}`").eqNullSafe(F.col(f"`{k}`")) for k in by]
            values = [F.coalesce(F.col(f"`{name}`"), F.lit(empty[f"__{name}"])).alias(name) for name in sums]
            found = own.join(found, same, "left").select(*[F.col(f"`__{k}`").alias(k) for k in by], *values)
        self.context.spend(epsilon)
        out = [F.col(f"`{k}`") for k in by]
        for name, s in sums.items():
            std = sigma(epsilon, self.context.delta, s.bound * math.sqrt(len(sums)))
            draws = sum((F.randn(secrets.randbits(62)) for _ in range(3)), F.randn(secrets.randbits(62)))
            out += [(F.col(f"`{name}`") + draws / 2 * std).alias(name), F.lit(std).alias(f"{name}_sigma")]
        return found.select(*out)
