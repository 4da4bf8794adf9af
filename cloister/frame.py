"""Guarded frames: lazy DataFrames that know where their rows come from."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lineage
from .functions import scans
from .functions.expr import BLOCK, HALO, ORDER, PLACE, Compile, Expr, Whole, as_expr, col, count, count_rows, duration_micros, expand, lit
from .operators import cleaning, ordered, plots, windows
from .session import GuardSession, RequestRejected, UnsupportedOperation

Names = str | Sequence[str]

#: Values of a column that ``partition_by`` looks up.
MOST_PARTS = 1000
#: Rows that a cross join may have.
CROSS_ROWS = 1_000_000_000


def _names(value: Names | None) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def _flat(values: Sequence) -> list:
    return [x for v in values for x in (v if isinstance(v, (list, tuple)) else [v])]


def _estimated(estimator: str, column: str | None) -> dict[str, str | None]:
    """An estimate that is one of the column's values shows it."""
    return {"value": column} if estimator in ("min", "max", "median") else {}


class GuardedFrame:
    """A lazy table.  ``order`` names the columns that give its rows an order ("-name" for descending)."""

    def __init__(self, session: GuardSession, df: DataFrame, provenance: lineage.Provenance, blacklist: frozenset[str] = frozenset(), order: tuple[str, ...] = (), identifier: str | None = None, query: str = ""):
        self.session, self.df, self.provenance, self.blacklist, self.order, self.identifier, self.query = session, df, lineage.once(provenance), blacklist, order, identifier, query

    def _with(self, df: DataFrame, step: str, provenance: lineage.Provenance | None = None, blacklist: frozenset[str] | None = None, order: tuple[str, ...] | None = None) -> GuardedFrame:
        order = self.order if order is None else order
        if any(o.lstrip("-") not in df.columns for o in order):
            order = ()
        return GuardedFrame(self.session, df, provenance or self.provenance, self.blacklist if blacklist is None else blacklist, order, None, f"{self.query}.{step}")

    # Container protocol and schema.

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def dtypes(self) -> list[tuple[str, str]]:
        return self.df.dtypes

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def __contains__(self, name: str) -> bool:
        return name in self.df.columns

    def __bool__(self) -> bool:
        raise TypeError("the truth of a lazy frame is not known")

    def __getitem__(self, name):
        return self.select(*_names(name))

    def clone(self) -> GuardedFrame:
        return GuardedFrame(self.session, self.df, self.provenance, self.blacklist, self.order, self.identifier, self.query)

    __copy__ = clone

    def __deepcopy__(self, memo) -> GuardedFrame:
        return self.clone()

    def pipe(self, f: Callable, *args, **kwargs):
        return f(self, *args, **kwargs)

    # Running.

    def collect(self) -> GuardedFrame:
        return self.session.collect(self)

    def fetch(self) -> DataFrame | None:
        frame = self if self.identifier else self.collect()
        return self.session.fetch(frame.identifier)

    def save(self) -> None:
        self.session.save((self if self.identifier else self.collect()).identifier)

    def delete(self) -> None:
        self.session.delete(self.identifier)

    def cache(self) -> GuardedFrame:
        return self._with(self.df.cache(), "cache()")

    def with_context(self, *args):
        raise UnsupportedOperation("with_context")

    # Expressions.

    def _order(self) -> tuple[Column, ...]:
        return tuple(F.col(f"`{o[1:]}`").desc() if o.startswith("-") else F.col(f"`{o}`") for o in self.order)

    def _order_keys(self) -> tuple[Column, ...]:
        return tuple(F.col(f"`{o.lstrip('-')}`") for o in self.order)

    def _need_order(self) -> list[Column]:
        if not self.order:
            raise ValueError("this operator depends on the order of rows: sort the frame or give order_by")
        return list(self._order())

    def order_by(self, *names: str) -> GuardedFrame:
        """Name the columns that give rows their order, without sorting."""
        return self._with(self.df, f"order_by({', '.join(names)})", order=tuple(names))

    def _exprs(self, values: Sequence) -> list[Expr]:
        found = expand([as_expr(v) if isinstance(v, (str, Expr)) else lit(v) for v in _flat(values)], self.df.schema)
        for e in found:
            for root in e.roots:
                if root not in self.df.columns:
                    raise ValueError(f"column {root} not found in the frame")
        return found

    def _rows(self, exprs: Sequence[Expr]) -> tuple[DataFrame, list[Column]]:
        """The frame, joined with the one-row table of the aggregates that ``exprs`` hold, and their columns.  Where they depend
        on the order of the whole frame, rows are dealt to blocks and the columns are computed there."""
        sizes: dict[str, int] = {}

        def is_large(keys: tuple[Column, ...]) -> bool:
            name = ", ".join(map(str, keys))
            if name not in sizes:
                sizes[name] = ordered.largest_group(self.df, keys)
            return sizes[name] > ordered.BLOCK_ROWS

        backward = tuple(self._reverse_order()) if self.order else ()
        context = Compile("row", self._order(), backward, whole=Whole(), sides=[], passes=[], large=is_large)
        columns = [e.build(context) for e in exprs]
        df, whole = self.df, context.whole
        for own in context.passes:
            df = ordered.in_segments(df, own, self._order())
        if whole.used:
            df = ordered.row_index(df, self._order(), PLACE)
        if context.aggregates:
            source = ordered.with_sides(df, [], context.sides)
            df = df.crossJoin(F.broadcast(source.agg(*[c.alias(n) for n, c in context.aggregates])))  # one row
        if whole.used:
            df = ordered.in_blocks(df, whole, context.prepared)
            names = [f"__c{i}" for i in range(len(columns))]
            df = df.select("*", *[c.alias(n) for c, n in zip(columns, names, strict=True)]).where(~F.col(HALO))
            return df, [F.col(n) for n in names]
        for name, column in context.prepared:
            df = df.withColumn(name, column)
        return df, columns

    def _sensitive(self, exprs: Sequence[Expr], base: frozenset[str]) -> frozenset[str]:
        """Columns that show a sensitive one, under whatever name.  An aggregate that shows no value, such as a sum, is
        sensitive only if it has the name of a sensitive column."""
        found = set(base)
        for e in exprs:
            shown = {n for r in e.shown for n in ([o.lstrip("-") for o in self.order] if r == ORDER else [r])}
            if shown & self.blacklist or (e.aggregated and e.name in self.blacklist):
                found.add(e.name)
            else:
                found.discard(e.name)
        return frozenset(found)

    def select(self, *values) -> GuardedFrame:
        exprs = self._exprs(values)
        if any(e.table for e in exprs):
            if len(exprs) > 1:
                raise ValueError(f"{exprs[0].name} makes a table of its own and must be selected alone")
            return exprs[0].table(self)
        step = f"select({', '.join(e.name for e in exprs)})"
        sensitive = self._sensitive(exprs, frozenset())
        if exprs and all(e.aggregated for e in exprs):
            context = Compile("agg", self._order_keys(), sides=[])
            columns = [e.build(context).alias(e.name) for e in exprs]
            df = ordered.with_sides(self.df, [], context.sides).agg(*columns)
            return self._with(df, step, self._credited(exprs, self._all_rows()), sensitive, ())
        df, columns = self._rows(exprs)
        return self._with(df.select(*[c.alias(e.name) for c, e in zip(columns, exprs, strict=True)]), step, blacklist=sensitive)

    def _all_rows(self) -> Callable[[], float]:
        """What an aggregate of all rows stands for: their number, or without ``strict`` any number."""
        return (lambda: self.df.count()) if self.session.strict else (lambda: math.inf)

    def _credited(self, exprs: Sequence[Expr], size: Callable[[], float]) -> lineage.Provenance:
        """Provenance of aggregates over groups of ``size()`` rows; in a ``strict`` session values of single rows make it that of rows."""
        return self.provenance if self.session.strict and any(e.raw for e in exprs) else lineage.aggregated(self.provenance, size)

    def with_columns(self, *values) -> GuardedFrame:
        exprs = self._exprs(values)
        df, columns = self._rows(exprs)
        new = {e.name: c for e, c in zip(exprs, columns, strict=True)}
        kept = [new.pop(n).alias(n) if n in new else F.col(f"`{n}`") for n in self.df.columns]
        out = df.select(*kept, *[c.alias(n) for n, c in new.items()])
        return self._with(out, f"with_columns({', '.join(e.name for e in exprs)})", blacklist=self._sensitive(exprs, self.blacklist))

    def with_column(self, value: Expr) -> GuardedFrame:
        return self.with_columns(value)

    def filter(self, predicate: Expr) -> GuardedFrame:
        df, (condition,) = self._rows([predicate])
        return self._with(df.where(condition).select(*[F.col(f"`{c}`") for c in self.df.columns]), "filter()")

    where = filter

    def drop(self, *names) -> GuardedFrame:
        return self._with(self.df.drop(*_flat(names)), f"drop({', '.join(_flat(names))})", blacklist=self.blacklist - set(_flat(names)))

    def rename(self, mapping: dict[str, str]) -> GuardedFrame:
        order = tuple(("-" if o.startswith("-") else "") + mapping.get(o.lstrip("-"), o.lstrip("-")) for o in self.order)
        return self._with(self.df.withColumnsRenamed(mapping), "rename()", blacklist=frozenset(mapping.get(b, b) for b in self.blacklist), order=order)

    def _unique_counts(self, value: Expr) -> GuardedFrame:
        rows = self.with_columns(value.alias("__value"))
        counts = rows.df.groupBy("__value").agg(F.count(F.lit(1)).alias("counts"))
        if self.order:
            up = [not o.startswith("-") for o in self.order]
            pick = F.min if all(up) else F.max
            counts = rows.df.groupBy("__value").agg(F.count(F.lit(1)).alias("counts"), pick(F.struct(*self._order_keys())).alias("__first"))
            counts = counts.orderBy(F.col("__first").asc() if all(up) else F.col("__first").desc())
        size = lambda: lineage.smallest_group(rows.df, [F.col("__value")])
        return self._with(counts.select(F.col("counts").alias(value.name)), f"unique_counts({value.name})", lineage.aggregated(self.provenance, size), frozenset(), ())

    def _arg_where(self, predicate: Expr) -> GuardedFrame:
        rows = self.with_columns(predicate.alias("__holds"))
        found = ordered.row_index(rows.df, self._need_order(), PLACE).where("__holds").select(F.col(PLACE).alias(predicate.name))
        return self._with(found, f"arg_where({predicate.name})", blacklist=rows._sensitive([predicate], frozenset()), order=(predicate.name,))

    def rows(self, places: Sequence[int]) -> GuardedFrame:
        """The rows at these places, from 0 in the frame's order; negative ones count from the end."""
        df = ordered.row_index(self.df, self._need_order(), PLACE)
        if any(p < 0 for p in places):
            total = self.df.count()
            places = [p + total if p < 0 else p for p in places]
        return self._with(df.where(F.col(PLACE).isin([int(p) for p in places])).drop(PLACE), f"rows({list(places)})")

    # Arithmetic of whole frames.

    def _arithmetic(self, other, f: Callable[[Column, Column], Column], sign: str) -> GuardedFrame:
        """Numeric columns with a number, or with the columns of another frame at the same place in order of rows and columns."""
        numeric = [c.name for c in self.df.schema if isinstance(c.dataType, T.NumericType)]
        if not isinstance(other, GuardedFrame):
            return self._with(self.df.select(*[f(F.col(f"`{c}`"), F.lit(other)).alias(c) if c in numeric else F.col(f"`{c}`") for c in self.df.columns]), f"{sign} {other}")
        if len(other.df.columns) != len(self.df.columns):
            raise ValueError("frames of different numbers of columns")
        a = ordered.row_index(self.df, self._need_order(), PLACE)
        b = ordered.row_index(other.df, other._need_order(), PLACE).toDF(PLACE, *[f"__b{i}" for i in range(len(other.df.columns))])
        out = [f(F.col(f"`{c}`"), F.col(f"__b{i}")).alias(c) if c in numeric else F.col(f"`{c}`") for i, c in enumerate(self.df.columns)]
        theirs = {mine for mine, c in zip(self.df.columns, other.df.columns, strict=True) if c in other.blacklist}
        return self._with(a.join(b, PLACE, "left").select(PLACE, *out).drop(PLACE), f"{sign} frame", lineage.merged(self.provenance, other.provenance), self.blacklist | theirs)

    def __add__(self, other) -> GuardedFrame:
        return self._arithmetic(other, lambda a, b: a + b, "+")

    def __sub__(self, other) -> GuardedFrame:
        return self._arithmetic(other, lambda a, b: a - b, "-")

    def __mul__(self, other) -> GuardedFrame:
        return self._arithmetic(other, lambda a, b: a * b, "*")

    def __truediv__(self, other) -> GuardedFrame:
        return self._arithmetic(other, lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "/")

    # Order and limits.

    def sort(self, by, reverse: bool | Sequence[bool] = False, nulls_last: bool = False) -> GuardedFrame:
        exprs = self._exprs([by])
        flags = [reverse] * len(exprs) if isinstance(reverse, bool) else list(reverse)
        df, columns = self._rows(exprs)
        keys = []
        for c, down in zip(columns, flags, strict=True):
            keys.append((c.desc_nulls_last() if nulls_last else c.desc_nulls_first()) if down else (c.asc_nulls_last() if nulls_last else c.asc_nulls_first()))
        order = tuple(("-" if down else "") + e.name for e, down in zip(exprs, flags, strict=True))
        return self._with(df.orderBy(*keys).select(*[F.col(f"`{c}`") for c in self.df.columns]), f"sort({', '.join(order)})", order=order)

    def limit(self, n: int = 5) -> GuardedFrame:
        df = self.df.orderBy(*self._order()) if self.order else self.df
        return self._with(df.limit(n), f"limit({n})")

    head = limit

    def tail(self, n: int = 5) -> GuardedFrame:
        reversed_ = self.df.orderBy(*self._reverse_order()).limit(n)
        return self._with(reversed_.orderBy(*self._need_order()), f"tail({n})")

    def _reverse_order(self) -> list[Column]:
        self._need_order()
        return [F.col(f"`{o[1:]}`").asc() if o.startswith("-") else F.col(f"`{o}`").desc() for o in self.order]

    def slice(self, offset: int, length: int | None = None) -> GuardedFrame:
        if offset < 0:
            return self.tail(-offset)._with(self.tail(-offset).df.limit(length if length is not None else -offset), f"slice({offset}, {length})")
        df = self.df.orderBy(*self._need_order()).offset(offset)
        return self._with(df if length is None else df.limit(length), f"slice({offset}, {length})")

    def reverse(self) -> GuardedFrame:
        order = tuple(o[1:] if o.startswith("-") else f"-{o}" for o in self.order)
        return self._with(self.df.orderBy(*self._reverse_order()), "reverse()", order=order)

    def first(self) -> GuardedFrame:
        return self.limit(1)

    def last(self) -> GuardedFrame:
        return self.tail(1)

    def shift(self, periods: int = 1) -> GuardedFrame:
        return self.shift_and_fill(periods, None)

    def shift_and_fill(self, periods: int, fill_value) -> GuardedFrame:
        df = ordered.shift_rows(self.df, self._need_order(), periods, fill_value)
        return self._with(df, f"shift({periods})", order=("__ord",))

    def take_every(self, n: int) -> GuardedFrame:
        return self._with(ordered.every_nth(self.df, self._need_order(), n), f"take_every({n})")

    def with_row_count(self, name: str = "index") -> GuardedFrame:
        return self._with(ordered.row_index(self.df, self._need_order(), name), f"with_row_count({name})", order=(name,))

    def unique(self, maintain_order: bool = True, subset: Names | None = None, keep: str = "first") -> GuardedFrame:
        return self._with(ordered.unique(self.df, _names(subset) or None, keep, self._order_keys()), "unique()")

    distinct = unique

    def sample(self, fraction: float, seed: int = 0) -> GuardedFrame:
        """About this share of the rows, chosen by a hash of their values and the seed: the same on any cluster."""
        pick = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in self.df.columns]), F.lit(1_000_000_007)) < fraction * 1_000_000_007
        return self._with(self.df.where(pick), f"sample({fraction})")

    def shuffle(self, seed: int = 0) -> GuardedFrame:
        return self._with(self.df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in self.df.columns])), "shuffle()", order=())

    # Cleaning and reshaping.

    def fill_null(self, value) -> GuardedFrame:
        return self._with(cleaning.fill_null(self.df, value), "fill_null()")

    def fill_nan(self, value) -> GuardedFrame:
        return self._with(cleaning.fill_nan(self.df, value), "fill_nan()")

    def drop_nulls(self, subset: Names | None = None) -> GuardedFrame:
        return self._with(self.df.na.drop("any", subset=_names(subset) or None), "drop_nulls()")

    def interpolate(self) -> GuardedFrame:
        numeric = [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType) and f.name not in [o.lstrip("-") for o in self.order]]
        return self._with(ordered.interpolate_rows(self.df, self._need_order(), numeric), "interpolate()")

    def unnest(self, names: Names) -> GuardedFrame:
        names = _names(names)
        fields = {f.name for n in names if n in self.blacklist for f in self.df.schema[n].dataType}
        return self._with(self.df.select(*[F.col(f"`{c}`.*") if c in names else F.col(f"`{c}`") for c in self.df.columns]), "unnest()", blacklist=(self.blacklist - set(names)) | fields)

    def explode(self, columns: Names) -> GuardedFrame:
        """List elements as rows, several columns side by side; an empty or null list gives a row with nulls."""
        names = _names(columns)
        if len(names) == 1:
            return self._with(self.df.withColumn(names[0], F.explode_outer(names[0])), "explode()")
        zipped = self.df.withColumn("__z", F.explode_outer(F.arrays_zip(*names)))
        return self._with(zipped.select(*[F.col(f"__z.{c}").alias(c) if c in names else F.col(f"`{c}`") for c in self.df.columns]), "explode()")

    def melt(self, id_vars: Names, value_vars: Names | None = None, variable_name: str = "variable", value_name: str = "value") -> GuardedFrame:
        values = _names(value_vars) or [c for c in self.df.columns if c not in _names(id_vars)]
        sensitive = self.blacklist & set(_names(id_vars)) | ({value_name} if self.blacklist & set(values) else set())
        return self._with(cleaning.melt(self.df, _names(id_vars), values, variable_name, value_name), "melt()", blacklist=frozenset(sensitive))

    def to_dummies(self, column: str, values: Sequence | None = None) -> GuardedFrame:
        if column in self.blacklist and values is None:
            raise RequestRejected(f"the values of {column} must not become column names")
        df = cleaning.to_dummies(self.df, column, values)
        sensitive = self.blacklist | ({c for c in df.columns if c.startswith(f"{column}_")} if column in self.blacklist else set())
        return self._with(df, f"to_dummies({column})", blacklist=frozenset(sensitive))

    def _scaled(self, names: Names, formula) -> GuardedFrame:
        return self.with_columns(*cleaning.scale_columns(names, self.df.schema, formula))

    def minmax_scale(self, cols: Names) -> GuardedFrame:
        return self._scaled(cols, cleaning.minmax)

    def mean_scale(self, cols: Names) -> GuardedFrame:
        return self._scaled(cols, cleaning.mean_range)

    def max_abs_scale(self, cols: Names, signed: bool = True) -> GuardedFrame:
        return self._scaled(cols, lambda x: cleaning.max_abs(x, signed))

    def zscore_scale(self, cols: Names) -> GuardedFrame:
        return self._scaled(cols, cleaning.zscore)

    def median_quantile_scale(self, cols: Names) -> GuardedFrame:
        return self._scaled(cols, cleaning.median_quantile)

    def apply_udf(self, columns: Names, udf: Callable[[Expr], Expr]) -> GuardedFrame:
        """Replace numeric columns by an expression of themselves, in their own type.  ``udf`` builds an expression of this
        library, so nothing but its column functions can run on the data; nulls stay null."""
        out = []
        for name in _names(columns):
            if name not in self.df.columns:
                raise ValueError(f"column {name} not found in the frame")
            dtype = self.df.schema[name].dataType
            if not isinstance(dtype, T.NumericType):
                raise TypeError(f"column {name} is not numeric")
            result = udf(col(name))
            if not isinstance(result, Expr):
                raise TypeError("the function must return an expression")
            out.append(result.cast(dtype).alias(name))
        return self.with_columns(*out)

    # Aggregation.

    def groupby(self, *by, maintain_order: bool = False) -> GuardedGroup:
        return GuardedGroup(self, self._exprs(by))

    def _over_all(self, f: Callable[[Column], Column], kinds: tuple[type, ...], step: str) -> GuardedFrame:
        out = [f(F.col(f"`{c.name}`")).alias(c.name) if isinstance(c.dataType, kinds) else F.lit(None).cast(c.dataType).alias(c.name) for c in self.df.schema]
        return self._with(self.df.agg(*out), f"{step}()", lineage.aggregated(self.provenance, self._all_rows()), order=())

    def sum(self):
        return self._over_all(F.sum, (T.NumericType,), "sum")

    def min(self):
        return self._over_all(F.min, (T.DataType,), "min")

    def max(self):
        return self._over_all(F.max, (T.DataType,), "max")

    def mean(self):
        return self._over_all(F.avg, (T.NumericType,), "mean")

    def median(self):
        return self.quantile(0.5, "linear")

    def std(self, ddof: int = 1):
        return self._over_all(F.stddev_samp if ddof == 1 else F.stddev_pop, (T.NumericType,), "std")

    def var(self, ddof: int = 1):
        return self._over_all(F.var_samp if ddof == 1 else F.var_pop, (T.NumericType,), "var")

    def quantile(self, q: float, interpolation: str = "nearest"):
        """Exact; ``nearest``, ``lower`` and ``higher`` keep the columns' types, other interpolations give doubles."""
        numeric = [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType)]
        found = ordered.column_quantiles(self.df, numeric, q, interpolation)
        keeps = interpolation in ("nearest", "lower", "higher")
        out = [(F.col(f"`{f.name}`").cast(f.dataType) if keeps else F.col(f"`{f.name}`")).alias(f.name) if f.name in numeric else F.lit(None).cast(f.dataType).alias(f.name) for f in self.df.schema]
        return self._with(found.select(*out), "quantile()", lineage.aggregated(self.provenance, self._all_rows()), order=())

    def null_count(self):
        return self._over_all(lambda c: F.sum(c.isNull().cast("long")), (T.DataType,), "null_count")

    def describe(self) -> GuardedFrame:
        """``describe`` and a column for each column: count (with nulls), null_count, mean, std, min, max from one
        aggregation, and the median by rank, of all columns together.  Numeric columns give doubles; others give text, with their counts, min and max."""
        rows = ("count", "null_count", "mean", "std", "min", "max", "median")
        of = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        numbers = [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType)]
        medians = ordered.column_quantiles(self.df, numbers, 0.5, "linear").toDF(*[f"__m{i}" for i in range(len(numbers))])
        aggs = []
        for f in self.df.schema:
            c = F.col(f"`{f.name}`")
            numeric = isinstance(f.dataType, T.NumericType)
            kind = "double" if numeric else "string"
            values = [F.count(F.lit(1)).cast(kind), F.sum(c.isNull().cast("long")).cast(kind)]
            ordered_ = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
            values += [of[r](c).cast(kind) if numeric or (ordered_ and r in ("min", "max")) else F.lit(None).cast(kind) for r in rows[2:6]]
            aggs.append(F.array(*values).alias(f.name))
        one = self.df.agg(*aggs).crossJoin(F.broadcast(medians))  # one row each
        all_ = [F.concat(F.col(f"`{f.name}`"), F.array(F.col(f"__m{numbers.index(f.name)}") if f.name in numbers else F.lit(None).cast("string"))).alias(f.name) for f in self.df.schema]
        one = one.select(*all_).select(F.posexplode(F.array(*[F.lit(r) for r in rows])).alias("__i", "describe"), "*")
        df = one.select("describe", *[F.element_at(F.col(f"`{c}`"), F.col("__i") + 1).alias(c) for c in self.df.columns])
        return self._with(df, "describe()", lineage.aggregated(self.provenance, self._all_rows()), order=())

    def partition_by(self, column: str, values: Sequence | None = None) -> dict:
        """A frame for each value of a column; without ``values`` they are looked up, of which there may be ``MOST_PARTS``."""
        if column in self.blacklist:
            raise RequestRejected(f"the values of {column} must not be shown")
        if values is None:
            values = [r[0] for r in self.df.select(column).distinct().orderBy(column).limit(MOST_PARTS + 1).collect()]
            if len(values) > MOST_PARTS:
                raise ValueError(f"{column} has more than {MOST_PARTS} values: name those that are wanted")
        return {v: self._with(self.df.where(F.col(column).eqNullSafe(F.lit(v))), f"partition({column})") for v in values}

    # Time groups.

    def groupby_rolling(self, index_column: str, period: str, offset: str | None = None, closed: str = "right", by: Names | None = None) -> GuardedRolling:
        return GuardedRolling(self, index_column, period, offset, closed, _names(by))

    def groupby_dynamic(self, index_column: str, every: str, period: str | None = None, offset: str | None = None, truncate: bool = True, include_boundaries: bool = False, closed: str = "left", by: Names | None = None) -> GuardedGroup:
        """Groups by time windows of length ``period`` (``every`` if not given) that start every ``every``, moved by ``offset``;
        ``closed`` names the ends that belong to a window, months and years follow the calendar.  The window's start replaces
        the index, or with ``truncate=False`` its first row's time; ``include_boundaries`` adds both ends."""
        if closed not in ("left", "right", "both", "none"):
            raise ValueError("closed must be left, right, both or none")
        return GuardedDynamic(self, index_column, windows.Steps.of(every, period, offset), closed, truncate, include_boundaries, self._exprs(_names(by)))

    # Joins.

    def _first_times(self, index: str) -> GuardedFrame:
        columns = [F.col("__first").alias(c) if c == index else F.col(f"`{c}`") for c in self.df.columns if c != "__first"]
        return self._with(self.df.select(*columns), "first times", blacklist=self.blacklist - {"__first"} | ({index} if "__first" in self.blacklist else set()))

    def join(self, other: GuardedFrame, left_on=None, right_on=None, on=None, how: str = "inner", suffix: str = "_right", allow_parallel: bool = True, force_parallel: bool = False, join_nulls: bool = False) -> GuardedFrame:
        """Equi-join on names or expressions.  Right key columns are dropped, other clashing names get ``suffix``;
        an outer join's keys are coalesced.  A cross join of more than ``CROSS_ROWS`` rows is refused."""
        if other.session is not self.session:
            raise ValueError("both frames must belong to the same session")
        if how == "cross":
            right = other.df.withColumnsRenamed({c: c + suffix for c in other.df.columns if c in self.df.columns})
            n, m = self.df.count(), other.df.count()
            if n * m > CROSS_ROWS:
                raise ValueError(f"a cross join of {n} by {m} rows has more than {CROSS_ROWS}: join on a key")
            mine, theirs = lineage.scaled(self.provenance, lambda: m), lineage.scaled(other.provenance, lambda: n)
            return self._with(self.df.crossJoin(right), "join(cross)", lineage.merged(mine, theirs), self.blacklist | self._renamed(other, suffix, ()))
        left_keys = self._exprs([on if on is not None else left_on])
        right_keys = other._exprs([on if on is not None else right_on])
        if len(left_keys) != len(right_keys) or not left_keys:
            raise ValueError("give on, or left_on and right_on of the same length")
        dropped = {k.name for k in right_keys if k.roots == (k.name,)}
        names = [f"__rk{i}" for i in range(len(right_keys))]
        kept = [c for c in other.df.columns if c not in dropped]
        context = Compile("row")
        l_cols = [k.build(context) for k in left_keys]
        r_cols = [k.build(context) for k in right_keys]
        right = other.df.select(*[c.alias(n) for c, n in zip(r_cols, names, strict=True)], *[F.col(f"`{c}`").alias(c + suffix if c in self.df.columns else c) for c in kept])
        left = self.df.select("*", *[c.alias(f"__lk{i}") for i, c in enumerate(l_cols)])
        equal = [F.col(f"__lk{i}").eqNullSafe(F.col(n)) if join_nulls else F.col(f"__lk{i}") == F.col(n) for i, n in enumerate(names)]
        kind = {"inner": "inner", "left": "left", "outer": "full", "semi": "left_semi", "anti": "left_anti"}.get(how)
        if kind is None:
            raise ValueError("how must be inner, left, outer, semi, anti or cross")
        matches = lineage.key_matches(self.df, other.df, l_cols, r_cols, join_nulls)
        joined = left.join(right, functools.reduce(lambda a, b: a & b, equal), kind)
        if how in ("semi", "anti"):
            provenance = lineage.merged(self.provenance, lineage.scaled(other.provenance, lambda: 0))
            return self._with(joined.select(*[F.col(f"`{c}`") for c in self.df.columns]), f"join({how})", provenance)
        of = {k.name: (f"__lk{i}", names[i]) for i, k in enumerate(left_keys)} if how == "outer" else {}
        out = [F.coalesce(*of[c]).alias(c) if c in of else F.col(f"`{c}`") for c in self.df.columns]
        out += [F.col(f"`{c + suffix if c in self.df.columns else c}`") for c in kept]
        provenance = lineage.merged(lineage.scaled(self.provenance, lambda: matches()[0]), lineage.scaled(other.provenance, lambda: matches()[1]))
        # The keys of an outer join also show the right side's keys.
        keys = {k.name for k, theirs in zip(left_keys, right_keys, strict=True) if k.name in of and set(theirs.shown) & other.blacklist}
        return self._with(joined.select(*out), f"join({how})", provenance, self.blacklist | keys | self._renamed(other, suffix, dropped))

    def _renamed(self, other: GuardedFrame, suffix: str, dropped) -> frozenset[str]:
        return frozenset(c + suffix if c in self.df.columns else c for c in other.blacklist if c not in dropped)

    def join_asof(self, other: GuardedFrame, left_on: str | None = None, right_on: str | None = None, on: str | None = None, by_left: Names | None = None, by_right: Names | None = None, by: Names | None = None, strategy: str = "backward", suffix: str = "_right", tolerance=None, allow_parallel: bool = True, force_parallel: bool = False) -> GuardedFrame:
        """Nearest match by an ordered key; see ``cloister.operators.ordered.asof_join``."""
        if other.session is not self.session:
            raise ValueError("both frames must belong to the same session")
        left_on, right_on = on or left_on, on or right_on
        lefts, rights = _names(by if by is not None else by_left), _names(by if by is not None else by_right)
        if isinstance(tolerance, str):
            tolerance = f"INTERVAL '{duration_micros(tolerance) / 1e6}' SECOND"
        df = ordered.asof_join(self.df, other.df, left_on, right_on, lefts, rights, strategy, tolerance, suffix)

        @functools.cache
        def uses() -> int:
            tagged = other.df.withColumn("__rid", F.xxhash64(*[F.col(f"`{c}`") for c in other.df.columns]))
            found = ordered.asof_join(self.df, tagged, left_on, right_on, lefts, rights, strategy, tolerance, suffix)
            return found.where("__rid IS NOT NULL").groupBy("__rid").count().agg(F.max("count")).first()[0] or 1

        provenance = lineage.merged(self.provenance, lineage.scaled(other.provenance, uses))
        return self._with(df, "join_asof()", provenance, self.blacklist | self._renamed(other, suffix, set(rights)))

    def vstack(self, other: GuardedFrame) -> GuardedFrame:
        """Rows of both; names and types must be the same."""
        if self.df.dtypes != other.df.dtypes:
            raise ValueError("vstack needs the same column names and types")
        return self._with(self.df.unionAll(other.df), "vstack()", lineage.merged(self.provenance, other.provenance), self.blacklist | other.blacklist)

    def concat_diagonal(self, other: GuardedFrame) -> GuardedFrame:
        return self._with(self.df.unionByName(other.df, allowMissingColumns=True), "concat_diagonal()", lineage.merged(self.provenance, other.provenance), self.blacklist | other.blacklist)

    def concat_horizontal(self, other: GuardedFrame) -> GuardedFrame:
        """Columns side by side, by place in each frame's order; the shorter one is filled with nulls."""
        a = ordered.row_index(self.df, self._need_order(), "__ord")
        b = ordered.row_index(other.df, other._need_order(), "__ord")
        return self._with(a.join(b, "__ord", "full").drop("__ord"), "concat_horizontal()", lineage.merged(self.provenance, other.provenance), self.blacklist | other.blacklist)

    # Plot tables.

    def _plot(self, df: DataFrame, step: str, keys: Sequence[Column] | None = None, shows: dict[str, str | None] | None = None) -> GuardedFrame:
        """``shows``: the columns of the table that show values of a column of the frame under another name."""
        sensitive = self.blacklist | {new for new, source in (shows or {}).items() if source in self.blacklist}
        if keys is None:
            return self._with(df, step, blacklist=sensitive, order=())
        size = (lambda: lineage.smallest_group(self.df, keys)) if keys else self._all_rows()
        return self._with(df, step, lineage.aggregated(self.provenance, size), sensitive, ())

    def histplot(self, x: str, y: str | None = None, bins: float = 10) -> GuardedFrame:
        keys = [F.floor(F.col(x) / bins), *([F.col(y)] if y else [])]
        return self._plot(plots.histogram(self.df, x, bins, y), "histplot()", keys, {"bin": x})

    def barplot(self, x: str | None = None, y: str | None = None, hue: str | None = None, estimator: str = "mean") -> GuardedFrame:
        keys = [F.col(k) for k in ([x, *([hue] if hue else [])] if x and y else [])]
        return self._plot(plots.bars(self.df, x, y, hue, estimator), "barplot()", keys, _estimated(estimator, y or x))

    def lineplot(self, x: str, y: str, hue=None, size=None, style=None, units=None) -> GuardedFrame:
        return self._plot(plots.lines(self.df, x, y, hue, size, style, units), "lineplot()")

    def scatterplot(self, x: str, y: str, hue: str | None = None) -> GuardedFrame:
        return self._plot(plots.points(self.df, x, y, hue), "scatterplot()")

    def boxplot(self, y: str, x: str | None = None) -> GuardedFrame:
        return self._plot(plots.boxes(self, y, x), "boxplot()", [F.col(x)] if x else [], dict.fromkeys(("min", "q25", "median", "q75", "max", "iqr"), y))

    def pieplot(self, parts: str, labels: str) -> GuardedFrame:
        return self._plot(plots.pie(self.df, parts, labels), "pieplot()", shows={"label": labels, "percent": parts})

    def facet(self, col: str | None = None, row: str | None = None) -> Facet:
        plots.known(self.df, col, row)
        return Facet(self, col, row)

    def _get_unique_values(self, column: str) -> GuardedFrame:
        return self._plot(plots.unique_values(self.df, column), "unique_values()", [F.col(column)])


class Facet:
    """Plot tables for each value of up to two columns, which become further keys of one job."""

    def __init__(self, frame: GuardedFrame, col: str | None, row: str | None):
        self.frame, self.col, self.row = frame, col, row

    def _keys(self) -> list[Column]:
        return [F.col(c) for c in (self.col, self.row) if c]

    def histplot(self, x: str, bins: float = 10) -> GuardedFrame:
        df = plots.facet_counts(self.frame.df, x, bins, self.col, self.row)
        return self.frame._plot(df, "facet.histplot()", [*self._keys(), F.floor(F.col(x) / bins)], {"bin": x})

    def barplot(self, x: str, y: str, estimator: str = "mean") -> GuardedFrame:
        df = plots.facet_bars(self.frame.df, x, y, estimator, self.col, self.row)
        return self.frame._plot(df, "facet.barplot()", [*self._keys(), F.col(x)], _estimated(estimator, y))

    def scatterplot(self, x: str, y: str, hue: str | None = None) -> GuardedFrame:
        return self.frame._plot(self.frame.df.select(*plots.known(self.frame.df, self.col, self.row, x, y, hue)), "facet.scatterplot()")

    lineplot = scatterplot


class GuardedGroup:
    def __init__(self, frame: GuardedFrame, keys: list[Expr]):
        self.frame, self.keys = frame, keys

    def _key_columns(self) -> list[Column]:
        context = Compile("row")
        return [k.build(context).alias(k.name) for k in self.keys]

    def agg(self, *values) -> GuardedFrame:
        frame = self.frame
        exprs = frame._exprs(values)
        if any(e.placed for e in exprs):
            frame = frame._with(ordered.row_index(frame.df, frame._need_order(), PLACE), "places")
        context = Compile("agg", frame._order_keys(), sides=[])
        columns = [e.build(context) if e.aggregated or e.listed else F.collect_list(e.build(context)) for e in exprs]
        df = ordered.with_sides(frame.df, self._key_columns(), context.sides).groupBy(*self._key_columns()).agg(*[c.alias(e.name) for c, e in zip(columns, exprs, strict=True)])
        provenance = frame.provenance
        if all(e.aggregated for e in exprs):
            provenance = frame._credited(exprs, lambda: lineage.smallest_group(frame.df, self._key_columns()))
        sensitive = frame._sensitive([*self.keys, *exprs], frozenset())
        return frame._with(df, f"groupby({', '.join(k.name for k in self.keys)}).agg({', '.join(e.name for e in exprs)})", provenance, sensitive, ())

    def count(self) -> GuardedFrame:
        return self.agg(count())

    def _picked(self, n: int, order: Sequence[Column], step: str) -> GuardedFrame:
        w = Window.partitionBy(*self._key_columns()).orderBy(*order)
        df = self.frame.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
        return self.frame._with(df, step)

    def head(self, n: int = 5) -> GuardedFrame:
        return self._picked(n, self.frame._need_order(), f"groupby().head({n})")

    def tail(self, n: int = 5) -> GuardedFrame:
        return self._picked(n, self.frame._reverse_order(), f"groupby().tail({n})")


class GuardedDynamic(GuardedGroup):
    """Rows dealt to every time window that they are in."""

    def __init__(self, frame: GuardedFrame, index: str, steps: windows.Steps, closed: str, truncate: bool, boundaries: bool, by: list[Expr]):
        kind = frame.df.schema[index].dataType
        time = lambda c: F.timestamp_micros(c).cast(kind)
        dealt = frame._with(windows.dealt(frame.df, index, steps, closed), "dynamic()")
        self.index, self.truncate = index, truncate
        keys = [Expr(lambda c, n=n: time(F.col(n)), name) for n, name in (("__start", "_lower_boundary"), ("__end", "_upper_boundary")) if boundaries]
        super().__init__(dealt, [*by, *keys, Expr(lambda c: time(F.col("__start")), index, shown=(index,))])

    def agg(self, *values) -> GuardedFrame:
        if self.truncate:
            return super().agg(*values)
        return super().agg(*values, col(self.index).min().alias("__first"))._first_times(self.index)


#: Groups of more rows than this may have long time windows.
LONG_GROUP = 20_000
#: Aggregates of time windows whose work need not grow with the window, and the types of their values.
SCANNED = {F.sum: "sum", F.avg: "avg", F.min: "min", F.max: "max", count_rows: "count"}
_FLOATS, _WHOLE = (T.FloatType, T.DoubleType), (T.ShortType, T.IntegerType, T.LongType)
SCANNED_TYPES = {"sum": (T.DoubleType, *_WHOLE), "avg": (*_FLOATS, *_WHOLE), "min": (T.DoubleType,), "max": (T.DoubleType,)}


class GuardedRolling:
    """Aggregates over the rows of a trailing time window of each row (index in microseconds; ``closed`` names the ends that count)."""

    def __init__(self, frame: GuardedFrame, index: str, period: str, offset: str | None, closed: str, by: list[str]):
        if closed not in ("left", "right", "both", "none"):
            raise ValueError("closed must be left, right, both or none")
        self.frame, self.index, self.by = frame, index, by
        length = duration_micros(period)
        start = duration_micros(offset) if offset else -length
        self.low = start + (0 if closed in ("left", "both") else 1)
        self.high = start + length - (0 if closed in ("right", "both") else 1)

    def _key(self) -> Column:
        return F.unix_micros(F.col(f"`{self.index}`").cast("timestamp"))

    def agg(self, *values) -> GuardedFrame:
        frame = self.frame
        rows = ordered.in_time_blocks(frame.df, self.by, self._key(), self.low, self.high)
        w = Window.partitionBy(BLOCK, *self.by).orderBy(self._key()).rangeBetween(self.low, self.high)
        exprs = frame._exprs(values)
        if not all(e.aggregated for e in exprs):
            raise ValueError("rolling groups take aggregates")

        long_windows = ordered.largest_group(frame.df, [F.col(f"`{c}`") for c in self.by]) > LONG_GROUP
        asked: list[tuple[str, str, Column]] = []
        whole = True  # all aggregates are of kinds that a scan knows

        class Rolling(Compile):
            def aggregate(self, column: Column) -> Column:
                nonlocal whole
                whole = False
                return column.over(w)

            def aggregate_of(self, f, value: Column) -> Column:
                kind = SCANNED.get(f) if long_windows else None
                if kind is None or not (kind == "count" or isinstance(frame.df.select(value).schema[0].dataType, SCANNED_TYPES[kind])):
                    return self.aggregate(f(value))
                asked.append((f"__r{len(asked)}", kind, value))
                return F.col(asked[-1][0])

        columns = [e.build(Rolling("agg", frame._order_keys())).alias(e.name) for e in exprs]
        own = ~F.col(HALO)
        if asked and whole:
            df = self._scanned(rows, asked).select(*[F.col(f"__by{i}").alias(c) for i, c in enumerate(self.by)], F.col("__index").alias(self.index), *columns)
        else:
            long_windows = False
            columns = [e.build(Rolling("agg", frame._order_keys())).alias(e.name) for e in exprs]
            df = rows.select(*self.by, self.index, *columns, own.alias("__own")).where("__own").drop("__own")

        def size() -> int:
            return self._scanned(rows, [("n", "count", F.lit(0))]).agg(F.min("n")).first()[0] or 0

        sensitive = frame._sensitive([*map(col, self.by), *exprs], frozenset())
        return frame._with(df, "groupby_rolling().agg()", frame._credited(exprs, size), sensitive, ())

    def _scanned(self, rows: DataFrame, asked: Sequence[tuple[str, str, Column]]) -> DataFrame:
        """The own rows of blocks, ``__by0, ..., __index``, with aggregates of their windows whose work grows with the rows, however long windows are."""
        names = [f"__by{i}" for i in range(len(self.by))]
        own = [F.col(f"`{c}`").alias(n) for n, c in zip(names, self.by, strict=True)]
        values = [(F.lit(0).cast("long") if kind == "count" else value.cast("double" if isinstance(rows.select(value).schema[0].dataType, (T.FloatType, T.DoubleType)) else "long")).alias(n) for n, kind, value in asked]
        narrow = rows.select(BLOCK, HALO, self._key().alias("__t"), *own, F.col(f"`{self.index}`").alias("__index"), *values)
        out = T.StructType([T.StructField(f.name, T.DoubleType() if (f.name, "avg") in {(n, k) for n, k, _ in asked} else f.dataType, True) for f in narrow.schema])
        low, high, kinds = self.low, self.high, [(n, k) for n, k, _ in asked]
        return narrow.groupBy(BLOCK, *names).applyInArrow(lambda segment: scans.rolling(segment, low, high, kinds), out)


__all__ = ["Facet", "GuardedDynamic", "GuardedFrame", "GuardedGroup", "GuardedRolling"]
