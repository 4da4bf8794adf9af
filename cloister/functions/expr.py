"""Column expressions of guarded frames.

An expression compiles to a Spark ``Column`` in a context: an aggregate stays an aggregate in
``groupby().agg`` and in an all-aggregate ``select``, becomes a window aggregate under ``over``, and
otherwise refers to a one-row table of aggregates that the frame joins to its rows.  Each expression
knows whether it is aggregated, which the guard needs, the columns it comes from, and those whose values it may show.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scans


#: Stands for the frame's order columns among the columns that an expression shows, and for each selected column.
ORDER, EACH = "<order>", "<each>"

#: Columns of a row's place in the frame's order, of its block, and of whether it is a copy from another block.
PLACE, BLOCK, HALO = "__ord", "__block", "__halo"

#: An exponentially weighted mean sums runs of values within which weights differ by two to this power at most.
_WEIGHT_BITS = 500


@dataclass
class Compile:
    """How expressions become columns: ``mode`` is "row" or "agg"; ``aggregates`` collects what a row needs from the whole frame."""

    mode: str = "row"
    order: tuple[Column, ...] = ()
    backward: tuple[Column, ...] = ()  # the same order from its end
    partition: tuple[Column, ...] = ()
    windowed: bool = False
    current: str = ""  # the column that a selector of several columns stands for just now
    aggregates: list[tuple[str, Column]] = field(default_factory=list)
    prepared: list[tuple[str, Column]] = field(default_factory=list)  # columns that others are built on
    whole: Whole | None = None  # where windows over the whole frame go by blocks of rows
    sides: list[Side] | None = None  # tables by group that an aggregation is joined with
    passes: list[Pass] | None = None  # windows over groups too large for a task, which are computed before the others
    large: Callable[[tuple[Column, ...]], bool] = lambda keys: False  # whether some group of these keys is
    inside: Pass | None = None  # the pass that is being built

    def side(self, make: Callable, of: str, *request) -> Column | None:
        """One value for each group from a table that is computed apart: ``make(df, keys, {column: request, ...})`` has a column for each
        request on the same thing ``of``.  None where aggregates can't be joined with a table."""
        if self.sides is None or self.windowed:
            return None
        name = f"__side{sum(len(s.requests) for s in self.sides)}"
        for side in self.sides:
            if side.of == of:
                break
        else:
            side = Side(make, of, {})
            self.sides.append(side)
        side.requests[name] = request
        return self.aggregate(F.any_value(F.col(name)))

    def prepare(self, column: Column) -> Column:
        name = f"__{'p' if self.inside else 'w'}{len(self.prepared)}"
        self.prepared.append((name, column))
        return F.col(name)

    @property
    def by_blocks(self) -> bool:
        return self.whole is not None and (self.inside is not None or not self.partition)

    def groups(self) -> tuple[Column, ...]:
        return (F.col(BLOCK), *self.partition) if self.by_blocks else self.partition

    def pass_of(self, keys: tuple[Column, ...], always: bool = False) -> Pass | None:
        """The pass for windows over groups of these keys; None where a window of Spark's will do."""
        if self.passes is None or self.inside is not None or not (always or self.large(keys)):
            return None
        found = next((p for p in self.passes if list(map(str, p.keys)) == list(map(str, keys))), None)
        if found is None:
            found = Pass(len(self.passes), keys)
            self.passes.append(found)
        return found

    def aggregate(self, column: Column) -> Column:
        if self.inside is not None:
            self.inside.aggregates.append((f"__ga{len(self.inside.aggregates)}", column))
            return F.col(self.inside.aggregates[-1][0])
        if self.windowed:
            return column.over(Window.partitionBy(*self.partition))
        if self.mode == "agg":
            return column
        name = f"__agg{len(self.aggregates)}"
        self.aggregates.append((name, column))
        return F.col(name)

    def aggregate_of(self, f: Callable[[Column], Column], value: Column) -> Column:
        return self.aggregate(f(value))

    def ordered(self) -> Window:
        if not self.order:
            raise ValueError("this expression depends on the order of rows: give the frame an order (order_by=...)")
        if self.by_blocks:
            self.whole.used = True
            return Window.partitionBy(*self.groups()).orderBy(PLACE)
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def reversed(self) -> Window:
        """The rows from the last to the first: what follows a row is a running frame here, which costs one pass."""
        self.ordered()
        if self.by_blocks:
            return Window.partitionBy(*self.groups()).orderBy(F.desc(PLACE))
        return Window.partitionBy(*self.partition).orderBy(*(self.backward or [o.desc() for o in self.order]))

    def own(self, column: Column) -> Column:
        """The column in a block's own rows, null in those copied from its neighbours."""
        return F.when(~F.col(HALO), column) if self.by_blocks else column


@dataclass
class Side:
    make: Callable
    of: str
    requests: dict[str, tuple]


@dataclass
class Whole:
    """What expressions over a whole frame need of a block of rows: copies of rows ``before`` and ``after`` it, values folded over
    the blocks before (or after) it, and ranks.  No task holds more than a block and what is copied to it."""

    used: bool = False
    before: int = 0
    after: int = 0
    carries: list[tuple[str, Column, Callable, bool]] = field(default_factory=list)
    ranks: list[tuple[str, Column, bool]] = field(default_factory=list)
    places: list[tuple[str, list[Column]]] = field(default_factory=list)
    scans: list[tuple[str, Column, scans.Scan]] = field(default_factory=list)

    def scan(self, value: Column, run: scans.Scan) -> Column:
        """A function in Python of a block's values in order."""
        self.scans.append((f"__scan{len(self.scans)}", value, run))
        return F.col(self.scans[-1][0])

    def carry(self, of_block: Column, fold: Callable, backward: bool = False) -> Column:
        """``fold(state, value)`` of a block aggregate over the blocks before this one; null before the first."""
        self.carries.append((f"__carry{len(self.carries)}", of_block, fold, backward))
        return F.col(self.carries[-1][0])

    def rank(self, value: Column, reverse: bool) -> tuple[Column, Column, Column]:
        """(rows with an earlier value, rows with this value, distinct earlier values)."""
        self.used = True
        self.ranks.append((f"__rank{len(self.ranks)}", value, reverse))
        return tuple(F.col(f"{self.ranks[-1][0]}_{part}") for part in ("start", "n", "dense"))

    def place(self, keys: list[Column]) -> Column:
        """The place, from 0, in another order."""
        self.used = True
        self.places.append((f"__place{len(self.places)}", keys))
        return F.col(self.places[-1][0])


@dataclass
class Pass:
    """Windows over groups of ``keys``, of which some are large: rows are sorted by group and order and cut into blocks, so that a group
    may go on from one block to the next; aggregates of groups are joined to their rows."""

    number: int
    keys: tuple[Column, ...]
    whole: Whole = field(default_factory=Whole)
    prepared: list[tuple[str, Column]] = field(default_factory=list)
    aggregates: list[tuple[str, Column]] = field(default_factory=list)
    outputs: list[tuple[str, Column]] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [f"__g{i}" for i in range(len(self.keys))]


def latest(state, value):
    return state if value is None else value


def known(f: Callable) -> Callable:
    """A fold that skips nulls."""
    return lambda state, value: latest(state, value) if state is None or value is None else f(state, value)


def count_rows(_: Column) -> Column:
    return F.count(F.lit(1))


def round_double(value: Column, decimals: int) -> Column:
    """A double rounded as binary numbers are: the nearest whole number of 10^-decimals to the product in double precision, halves away from zero, and the
    sign kept, of zero too.  Spark's ``round`` goes by a double's decimal digits and has no negative zero."""
    scale = F.lit(10.0**decimals)
    scaled = F.abs(value) * scale
    whole = F.floor(scaled).cast("double")
    near = (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / scale
    return F.when(scaled < 2.0**52, F.signum(value) * near).otherwise(value)  # larger ones are whole


Build = Callable[[Compile], Column]


def lift(value) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


def as_expr(value) -> Expr:
    return value if isinstance(value, Expr) else col(value)


@dataclass(frozen=True)
class Expr:
    build: Build
    name: str = "literal"
    aggregated: bool = False
    roots: tuple[str, ...] = ()
    columns: Callable[[T.StructType], list[str]] | None = None  # of a selector of several columns
    suffix_: str = ""
    listed: bool = False  # lists a group's values: one row for each group, though not an aggregate to the guard
    placed: bool = False  # needs the places of rows
    table: Callable | None = None  # a function of the frame, for what is a table of its own
    shown: tuple[str, ...] = ()  # columns whose values the result may show; counts, sums, means and deviations show none
    raw: bool = False  # an aggregate that holds the value of a single row
    scanned: bool = False  # goes by blocks also over small groups

    # Naming.

    def alias(self, name: str) -> Expr:
        return replace(self, name=name)

    def suffix(self, text: str) -> Expr:
        return replace(self, name=self.name + text, suffix_=self.suffix_ + text)

    def keep_name(self) -> Expr:
        return replace(self, name=self.roots[0] if self.roots else self.name)

    # Building blocks.

    def map(self, f: Callable[[Column], Column]) -> Expr:
        return replace(self, build=lambda c: f(self.build(c)))

    def agg(self, f: Callable[[Column], Column]) -> Expr:
        def build(c: Compile) -> Column:
            inside = Compile("agg", c.order, current=c.current)
            return c.aggregate_of(f, self.build(inside))

        return replace(self, build=build, aggregated=True)

    def summary(self, f: Callable[[Column], Column]) -> Expr:
        """An aggregate that shows no value of its column."""
        return replace(self.agg(f), shown=())

    def window(self, f: Callable[[Column, Window], Column], before: int = 0, after: int = 0) -> Expr:
        """An order-dependent function of each row and so many rows before and after it."""

        def build(c: Compile) -> Column:
            w = c.ordered()
            if c.by_blocks:
                c.whole.before, c.whole.after = max(c.whole.before, before), max(c.whole.after, after)
            return f(self.build(c), w)

        return replace(self, build=build)

    def _binary(self, other, f: Callable[[Column, Column], Column]) -> Expr:
        other = lift(other)
        named = self if self.roots else other
        shown = (*self.shown, *other.shown)
        return Expr(lambda c: f(self.build(c), other.build(c)), named.name, self.aggregated and other.aggregated, (*self.roots, *other.roots), self.columns, self.suffix_, shown=shown, raw=self.raw or other.raw, scanned=self.scanned or other.scanned)

    def __add__(self, o):
        return self._binary(o, lambda a, b: a + b)

    def __radd__(self, o):
        return lift(o) + self

    def __sub__(self, o):
        return self._binary(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return lift(o) - self

    def __mul__(self, o):
        return self._binary(o, lambda a, b: a * b)

    def __rmul__(self, o):
        return lift(o) * self

    def __truediv__(self, o):
        """True division; a zero divisor gives null."""
        return self._binary(o, lambda a, b: F.try_divide(a.cast("double"), b.cast("double")))

    def __rtruediv__(self, o):
        return lift(o) / self

    def __floordiv__(self, o):
        return self._binary(o, lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double"))))

    def __mod__(self, o):
        return self._binary(o, lambda a, b: F.when(b != 0, F.pmod(a, F.when(b != 0, b))))

    def __pow__(self, o):
        return self._binary(o, F.pow)

    def __neg__(self):
        return self.map(lambda a: -a)

    def __eq__(self, o):  # type: ignore[override]
        return self.is_null() if o is None else self._binary(o, lambda a, b: a == b)

    def __ne__(self, o):  # type: ignore[override]
        return self.is_not_null() if o is None else self._binary(o, lambda a, b: a != b)

    def __lt__(self, o):
        return self._binary(o, lambda a, b: a < b)

    def __le__(self, o):
        return self._binary(o, lambda a, b: a <= b)

    def __gt__(self, o):
        return self._binary(o, lambda a, b: a > b)

    def __ge__(self, o):
        return self._binary(o, lambda a, b: a >= b)

    def __and__(self, o):
        return self._binary(o, lambda a, b: a & b)

    def __or__(self, o):
        return self._binary(o, lambda a, b: a | b)

    def __invert__(self):
        return self.map(lambda a: ~a)

    __hash__ = object.__hash__

    # Nulls, casts, choices.

    def is_null(self):
        return self.map(lambda a: a.isNull())

    def is_not_null(self):
        return self.map(lambda a: a.isNotNull())

    def is_nan(self):
        return self.map(F.isnan)

    def is_not_nan(self):
        return self.map(lambda a: ~F.isnan(a))

    def is_finite(self):
        return self.map(lambda a: ~F.isnan(a) & (F.abs(a) < math.inf))

    def is_infinite(self):
        return self.map(lambda a: F.abs(a) == math.inf)

    def fill_null(self, value):
        return self._binary(value, F.coalesce)

    def fill_nan(self, value):
        return self._binary(value, lambda a, b: F.when(F.isnan(a), b).otherwise(a))

    def cast(self, dtype, strict: bool = True):
        return self.map(lambda a: a.cast(dtype) if strict else a.try_cast(dtype))

    def zip_with(self, mask: Expr, other):
        """The value where ``mask`` holds, that of ``other`` elsewhere."""
        return when(mask).then(self).otherwise(other).alias(self.name)

    # Tables of their own, the only expression of a ``select``.

    def value_counts(self):
        """A row ``{value, counts}`` for each distinct value."""
        return replace(self, table=lambda frame: frame.select(self.alias("value")).groupby("value").agg(count().alias("counts")).select(struct("value", "counts").alias(self.name)))

    def unique_counts(self):
        """How often each distinct value occurs, ordered by first appearance if the frame has an order."""
        return replace(self, table=lambda frame: frame._unique_counts(self))

    def arg_where(self):
        """The places, from 0 in the frame's order, of the rows where the expression holds."""
        return replace(self, table=lambda frame: frame._arg_where(self))

    def groups(self):
        """The places, from 0 in the frame's order, of a group's rows, as a list; for ``groupby().agg``."""
        return replace(self, build=lambda c: c.aggregate(F.array_sort(F.collect_list(F.col(PLACE)))), listed=True, shown=(), placed=True)

    def is_in(self, values):
        return self.map(lambda a: a.isin(list(values)))

    def is_between(self, low, high):
        return (self >= low) & (self <= high)

    def clip(self, low, high):
        return self.map(lambda a: F.when(a < low, F.lit(low)).when(a > high, F.lit(high)).otherwise(a))

    # Aggregates.

    def sum(self):
        return self.summary(F.sum)

    def min(self):
        return self.agg(F.min)

    def max(self):
        return self.agg(F.max)

    def mean(self):
        return self.summary(F.avg)

    def median(self):
        return self.quantile(0.5, "linear")

    def std(self, ddof: int = 1):
        return self.summary(F.stddev_samp if ddof == 1 else F.stddev_pop)

    def var(self, ddof: int = 1):
        return self.summary(F.var_samp if ddof == 1 else F.var_pop)

    def quantile(self, q: float, interpolation: str = "nearest"):
        """Exact; a group's values are never gathered, but counted near the rank that is asked for."""
        ranks_of(q, interpolation)

        def build(c: Compile) -> Column:
            value = self.build(Compile("agg", c.order, current=c.current))
            found = c.side(lambda df, keys, asked: ordered().group_quantiles(df, keys, value, asked), f"quantiles of {value}", q, interpolation)
            return c.aggregate(quantile(value, q, interpolation)) if found is None else found

        return replace(self, build=build, aggregated=True)

    def count(self):
        """Length of the group, nulls included."""
        return self.summary(count_rows)

    def len(self):
        return self.count()

    def n_unique(self):
        """Distinct values; null is one of them."""
        return self.summary(lambda a: F.count_distinct(a) + F.max(a.isNull().cast("int")))

    def null_count(self):
        return self.summary(lambda a: F.sum(a.isNull().cast("long")))

    def list(self):
        return replace(self.agg(F.collect_list), raw=True)

    def _ordered_pick(self, pick):
        def build(c: Compile) -> Column:
            if not c.order:
                raise ValueError("first and last need an order of rows: give the frame an order (order_by=...)")
            return c.aggregate(pick(F.struct(self.build(Compile("agg", current=c.current)).alias("v")), F.struct(*c.order))["v"])

        return replace(self, build=build, aggregated=True, raw=True)

    def first(self):
        return self._ordered_pick(F.min_by)

    def last(self):
        return self._ordered_pick(F.max_by)

    def mode(self):
        """The most frequent value, the smallest of several."""
        return self.agg(lambda a: F.mode(a, deterministic=True))

    def product(self):
        return self.agg(F.product)

    def skew(self):
        return self.summary(F.skewness)

    def kurtosis(self):
        return self.summary(F.kurtosis)

    def dot(self, other):
        return (self * other).sum()

    def arg_max(self):
        """The value of the frame's first order column in the row of the largest value."""
        return self._arg(F.max_by)

    def arg_min(self):
        return self._arg(F.min_by)

    def _arg(self, pick):
        return replace(self, build=lambda c: c.aggregate(pick(c.order[0], self.build(Compile("agg", current=c.current)))), aggregated=True, shown=(*self.shown, ORDER), raw=True)

    def filter(self, predicate: Expr):
        """Null where the predicate does not hold, so that an aggregate above skips the row."""
        return replace(self, build=lambda c: F.when(predicate.build(c), self.build(c)), roots=(*self.roots, *predicate.roots), shown=(*self.shown, *predicate.shown))

    def sort_by(self, by: Expr, reverse: bool = False):
        """The group's values as a list in the order of another expression; rows that are equal in it keep the frame's order, if it has one, in reverse too."""

        def build(c: Compile) -> Column:
            inside = Compile("agg", current=c.current)
            k, v = by.build(inside).alias("k"), self.build(inside).alias("v")
            if c.order:
                rows = F.array_sort(F.collect_list(F.struct(F.struct(*c.order).alias("o"), k, v)))
                rows = F.transform(rows, lambda s, i: F.struct(s["k"].alias("k"), (-i if reverse else i).alias("n"), s["v"].alias("v")))
            else:
                rows = F.collect_list(F.struct(k, v))
            return c.aggregate(F.transform(F.sort_array(rows, not reverse), lambda s: s["v"]))

        return replace(self, build=build, listed=True)

    def _places_of_group(self, low: int, high: int, backward: bool, cut: Callable[[Column], Column], pick: Callable[[Column], Column] | None = None):
        """The group's values at places ``low`` to ``high`` in the frame's order (from its end if ``backward``), as a list: only
        those rows are gathered, but for windows, where ``cut`` does it."""
        whole = self._part_of_group(cut)

        def build(c: Compile) -> Column:
            if not c.order:
                return whole.build(c)
            value = self.build(Compile("agg", current=c.current))
            found = c.side(lambda df, keys, asked: ordered().group_places(df, keys, value, c.order, low, high, backward, list(asked)), f"places {low} {high} {backward} of {value}")
            if found is None:
                return whole.build(c)
            return F.coalesce(F.transform(found if pick is None else pick(found), lambda s: s["v"]), F.array())  # no row at these places

        return replace(self, build=build, listed=True)

    def _part_of_group(self, cut: Callable[[Column], Column]):
        """A part of the group's values, in the frame's order, as a list."""

        def build(c: Compile) -> Column:
            if not c.order:
                raise ValueError("this expression depends on the order of rows: give the frame an order (order_by=...)")
            pairs = F.array_sort(F.collect_list(F.struct(F.struct(*c.order).alias("k"), self.build(Compile("agg", current=c.current)).alias("v"))))
            return c.aggregate(F.transform(cut(pairs), lambda s: s["v"]))

        return replace(self, build=build, listed=True)

    def slice(self, offset: int, length: int):
        if offset >= 0:
            return self._places_of_group(offset + 1, offset + length, False, lambda a: F.slice(a, offset + 1, length))
        last = lambda a: F.slice(a, F.greatest(F.size(a) + offset + 1, F.lit(1)), F.lit(length))
        return self._places_of_group(1, -offset, True, last, last)

    def head(self, n: int = 5):
        return self.slice(0, n)

    def tail(self, n: int = 5):
        return self._places_of_group(1, n, True, lambda a: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n)))

    def take(self, indices: Sequence[int]):
        cut = lambda a: F.array_compact(F.array(*[F.try_element_at(a, F.lit(i + 1 if i >= 0 else i)) for i in indices]))
        if not indices or min(indices) < 0:
            return self._part_of_group(cut)
        at = lambda found, i: F.try_element_at(F.filter(found, lambda s: s["n"] == i + 1), F.lit(1))
        return self._places_of_group(min(indices) + 1, max(indices) + 1, False, cut, lambda found: F.array_compact(F.array(*[at(found, i) for i in indices])))

    def reverse(self):
        return self._part_of_group(F.reverse)


    # Windows.

    def over(self, *by):
        keys = [as_expr(b) for group in by for b in (group if isinstance(group, (list, tuple)) else [group])]

        def build(c: Compile) -> Column:
            by = tuple(k.build(c) for k in keys)
            own = c.pass_of(by, self.scanned)
            if own is None:
                return self.build(replace(c, windowed=True, partition=by))
            inner = replace(c, windowed=True, partition=tuple(map(F.col, own.names)), whole=own.whole, prepared=own.prepared, inside=own)
            own.outputs.append((f"__over{own.number}_{len(own.outputs)}", self.build(inner)))
            return F.col(own.outputs[-1][0])

        # A partition may be one row, so whatever is aggregated over it may be shown.
        roots = (*self.roots, *(r for k in keys for r in k.roots))
        return replace(self, build=build, roots=roots, aggregated=False, shown=(*roots, *self.shown))

    def shift(self, n: int = 1, fill=None):
        return self.window(lambda a, w: (F.lag(a, n, fill) if n >= 0 else F.lead(a, -n, fill)).over(w), max(n, 0), max(-n, 0))

    def diff(self, n: int = 1):
        return self.window(lambda a, w: a - F.lag(a, n).over(w), max(n, 0), max(-n, 0))

    def _running(self, f, fold: Callable, join: Callable[[Column, Column], Column]):
        """``f`` of the values so far; ``fold`` does the same to results of blocks, as ``join`` does to two columns."""

        def build(c: Compile) -> Column:
            a, w = self.build(c), c.ordered()
            so_far = f(c.own(a)).over(w.rowsBetween(Window.unboundedPreceding, 0))
            if c.by_blocks:
                carried = c.whole.carry(f(c.own(a)), known(fold))
                so_far = F.coalesce(join(carried, so_far), so_far, carried)
            return F.when(a.isNotNull(), so_far)

        return replace(self, build=build)

    def cumsum(self):
        return self._running(F.sum, lambda a, b: a + b, lambda a, b: a + b)

    def cummin(self):
        return self._running(F.min, min, F.least)

    def cummax(self):
        return self._running(F.max, max, F.greatest)

    def cumprod(self):
        return self._running(F.product, lambda a, b: a * b, lambda a, b: a * b)

    def cumcount(self):
        def build(c: Compile) -> Column:
            w = c.ordered()
            if not c.by_blocks:
                return F.row_number().over(w) - 1
            if c.inside is None:
                return F.col(PLACE)
            before = c.whole.carry(F.count(c.own(F.lit(1))), known(lambda a, b: a + b))
            return F.count(c.own(F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(before, F.lit(0)) - 1

        return replace(self, build=build)

    def _rolling(self, f, size: int, least: int | None):
        least = size if least is None else least

        def build(a: Column, w: Window) -> Column:
            frame = w.rowsBetween(-(size - 1), 0)
            return F.when(F.count(a).over(frame) >= least, f(a).over(frame))

        return self.window(build, size - 1)

    def rolling_sum(self, size, min_periods=None):
        return self._rolling(F.sum, size, min_periods)

    def rolling_mean(self, size, min_periods=None):
        return self._rolling(F.avg, size, min_periods)

    def rolling_min(self, size, min_periods=None):
        return self._rolling(F.min, size, min_periods)

    def rolling_max(self, size, min_periods=None):
        return self._rolling(F.max, size, min_periods)

    def rolling_std(self, size, min_periods=None):
        return self._rolling(F.stddev_samp, size, min_periods)

    def rolling_var(self, size, min_periods=None):
        return self._rolling(F.var_samp, size, min_periods)

    def rolling_median(self, size, min_periods=None):
        return self.rolling_quantile(0.5, size, "linear", min_periods)

    def rolling_quantile(self, q, size, interpolation="nearest", min_periods=None):
        """Short windows are sorted for each row; in longer ones values are found by their rank in a window, for a block of rows at once."""
        ranks_of(q, interpolation)
        value = self.cast("double")
        if size <= scans.SHORT_WINDOW:
            return value._rolling(lambda a: F.collect_list(a), size, min_periods).map(lambda values: quantile_of(F.array_sort(values), q, interpolation))
        run = scans.SlidingQuantile(size, size if min_periods is None else min_periods, q, interpolation)

        def build(c: Compile) -> Column:
            c.ordered()
            if not c.by_blocks:
                raise ValueError(f"quantiles of more than {scans.SHORT_WINDOW} rows are columns of a frame of rows")
            c.whole.before = max(c.whole.before, size - 1)
            return c.whole.scan(value.build(c), run)

        return replace(value, build=build, scanned=True)

    def cumulative_fold(self, start, step: Callable, merge: Callable, finish: Callable = lambda state: state, dtype: str = "double"):
        """``finish`` of a running state: ``step(state, value)`` for each known value so far, from ``start``.

        ``merge(a, b)`` is the state after the values of both, ``start`` its neutral element; so blocks are folded side by side, each row is
        looked at twice, and a state for each block passes the driver.  States are Python values of bounded size; steps may change their argument only if they return it.
        """

        def build(c: Compile) -> Column:
            c.ordered()
            if not c.by_blocks:
                raise ValueError("a fold is a column of a frame of rows")
            return c.whole.scan(self.build(c), scans.Fold(start, step, merge, finish, dtype))

        return replace(self, build=build, scanned=True)

    def ewm_mean(self, alpha: float, adjust: bool = True):
        """Exponentially weighted mean over the known values so far."""
        if not 0 < alpha <= 1:
            raise ValueError("alpha must be above 0 and at most 1")
        decay = 1 - alpha
        if not decay:
            return self.forward_fill().cast("double")
        length = max(1, int(_WEIGHT_BITS * math.log(2) / -math.log(decay)))  # known values of a run

        def build(c: Compile) -> Column:
            w, groups = c.ordered(), c.groups()
            so_far = w.rowsBetween(Window.unboundedPreceding, 0)
            a = c.prepare(c.own(self.build(c).cast("double")))
            n = c.prepare(F.count(a).over(so_far))
            run = c.prepare(F.floor((F.greatest(n, F.lit(1)) - 1) / length))
            place = F.greatest(n, F.lit(1)) - 1 - run * length
            # Within a run, a value's weight is taken from the run's start; the run before adds what is left of its sum.
            weighed = a * F.pow(F.lit(decay), -place)
            order = [F.col(PLACE)] if c.by_blocks else list(c.order)
            here = F.sum(weighed).over(Window.partitionBy(*groups, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            past = F.sum(weighed).over(Window.partitionBy(*groups).orderBy(run).rangeBetween(-1, -1))
            total = F.pow(F.lit(decay), place) * (F.coalesce(here, F.lit(0.0)) + F.coalesce(past, F.lit(0.0)) * decay**length)
            first = F.first(a, ignorenulls=True).over(so_far)
            if c.by_blocks:
                total, first = c.prepare(total), c.prepare(first)
                last = lambda v: F.max_by(v, F.when(~F.col(HALO), F.col(PLACE)))
                state = c.whole.carry(F.struct(last(total).alias("s"), last(n).alias("n"), last(first).alias("x")), lambda old, new: _ewm_state(old, new, decay))
                total = total + F.coalesce(F.pow(F.lit(decay), n) * state["s"], F.lit(0.0))
                first, n = F.coalesce(state["x"], first), n + F.coalesce(state["n"], F.lit(0))
            if adjust:
                mean = total * alpha / (1 - F.pow(F.lit(decay), n))
            else:
                mean = total * alpha + F.pow(F.lit(decay), n) * first
            return F.when(n > 0, mean)

        return replace(self, build=build)

    def cumulative_eval(self, f: Callable[[Column], Column]):
        """``f`` of the list of values so far, for small partitions: the work grows with the square of their size.  See ``cumulative_fold``."""
        return replace(self, build=lambda c: f(F.collect_list(self.build(c)).over(replace(c, whole=None).ordered().rowsBetween(Window.unboundedPreceding, 0))))

    def ewm_var(self, alpha: float):
        """Biased exponentially weighted variance: the weighted mean of squares less the squared weighted mean."""
        return (self * self).ewm_mean(alpha) - self.ewm_mean(alpha) ** 2

    def ewm_std(self, alpha: float):
        return self.ewm_var(alpha).map(lambda v: F.sqrt(F.greatest(v, F.lit(0.0))))

    def rank(self, method: str = "average", reverse: bool = False, seed: int = 0):
        def build(c: Compile) -> Column:
            value = self.build(replace(c, windowed=False))
            key = value.desc_nulls_last() if reverse else value.asc_nulls_last()
            if c.by_blocks and c.inside is None and method in ("ordinal", "random"):
                tie = [F.xxhash64(F.lit(seed), *c.order)] if method == "random" else []
                return F.when(value.isNotNull(), c.whole.place([key, *tie]) + 1)
            if c.by_blocks and c.inside is None and method in ("min", "max", "average", "dense"):
                start, n, dense = c.whole.rank(value, reverse)
                return F.when(value.isNotNull(), {"min": start + 1, "max": start + n, "average": start + (n + 1) / 2, "dense": dense + 1}[method])
            w = Window.partitionBy(*c.partition).orderBy(key)
            peers = F.count(F.lit(1)).over(Window.partitionBy(*c.partition, value))
            ranks = {
                "min": lambda: F.rank().over(w),
                "max": lambda: F.rank().over(w) + peers - 1,
                "average": lambda: F.rank().over(w) + (peers - 1) / 2,
                "dense": lambda: F.dense_rank().over(w),
                "ordinal": lambda: F.row_number().over(Window.partitionBy(*c.partition).orderBy(key, *c.order)),
                "random": lambda: F.row_number().over(Window.partitionBy(*c.partition).orderBy(key, F.xxhash64(F.lit(seed), *c.order))),
            }
            if method not in ranks:
                raise ValueError(f"method must be one of {', '.join(ranks)}")
            return F.when(value.isNotNull(), ranks[method]())

        return replace(self, build=build)

    def is_first(self):
        return replace(self, build=lambda c: F.row_number().over(Window.partitionBy(*c.partition, self.build(c)).orderBy(*c.order)) == 1)

    def is_unique(self):
        return replace(self, build=lambda c: F.count(F.lit(1)).over(Window.partitionBy(*c.partition, self.build(c))) == 1)

    def is_duplicated(self):
        return ~self.is_unique()

    def interpolate(self):
        def build(c: Compile) -> Column:
            value, w = self.build(c), c.ordered()
            row = F.col(PLACE) if c.by_blocks else F.row_number().over(w)
            at = F.when(value.isNotNull(), F.struct(row.alias("r"), value.cast("double").alias("v")))
            return between_known(value, row, _nearest_known(c, at, False), _nearest_known(c, at, True))

        return replace(self, build=build)

    def forward_fill(self):
        return replace(self, build=lambda c: _nearest_known(c, self.build(c), False))

    def backward_fill(self):
        return replace(self, build=lambda c: _nearest_known(c, self.build(c), True))

    # Mathematics.

    def abs(self):
        return self.map(F.abs)

    def sqrt(self):
        return self.map(F.sqrt)

    def exp(self):
        return self.map(F.exp)

    def log(self, base: float | None = None):
        return self.map(F.ln if base is None else lambda a: F.ln(a) / math.log(base))

    def log10(self):
        return self.map(F.log10)

    def round(self, decimals: int = 0):
        return self.map(lambda a: F.round(a, decimals))

    def floor(self):
        return self.map(F.floor)

    def ceil(self):
        return self.map(F.ceil)

    def sign(self):
        return self.map(F.signum)

    def sin(self):
        return self.map(F.sin)

    def cos(self):
        return self.map(F.cos)

    def tan(self):
        return self.map(F.tan)

    def hash(self, seed: int = 0):
        return self.map(lambda a: F.xxhash64(F.lit(seed), a))

    def reinterpret(self, signed: bool = False):
        """The bits of a long as an unsigned number, or of such a number as a long."""
        wrap = F.lit(2).cast("decimal(20,0)") * F.lit(2**63 - 1).cast("decimal(20,0)") + 2
        if signed:
            return self.map(lambda a: F.when(a > 2**63 - 1, a - wrap).otherwise(a).cast("long"))
        return self.map(lambda a: F.when(a < 0, a.cast("decimal(20,0)") + wrap).otherwise(a.cast("decimal(20,0)")).cast("decimal(20,0)"))

    def explode(self):
        return self.map(F.explode_outer)

    @property
    def str(self) -> StringNamespace:
        return StringNamespace(self)

    @property
    def dt(self) -> TimeNamespace:
        return TimeNamespace(self)

    @property
    def arr(self) -> ListNamespace:
        return ListNamespace(self)

    @property
    def struct(self) -> StructNamespace:
        return StructNamespace(self)


@dataclass(frozen=True)
class StringNamespace:
    e: Expr

    def contains(self, pattern: str, literal: bool = False):
        return self.e.map(lambda a: F.contains(a, F.lit(pattern)) if literal else a.rlike(pattern))

    def starts_with(self, s):
        return self.e.map(lambda a: a.startswith(s))

    def ends_with(self, s):
        return self.e.map(lambda a: a.endswith(s))

    def lengths(self):
        """Bytes."""
        return self.e.map(F.octet_length)

    def n_chars(self):
        return self.e.map(F.length)

    def to_lowercase(self):
        return self.e.map(F.lower)

    def to_uppercase(self):
        return self.e.map(F.upper)

    def strip(self):
        return self.e.map(lambda a: F.regexp_replace(a, r"^\s+|\s+$", ""))

    def lstrip(self):
        return self.e.map(lambda a: F.regexp_replace(a, r"^\s+", ""))

    def rstrip(self):
        return self.e.map(lambda a: F.regexp_replace(a, r"\s+$", ""))

    def replace(self, pattern: str, value: str):
        """The first match."""
        return self.e.map(lambda a: F.regexp_replace(a, f"(?s)^(.*?)(?:{pattern})", "$1" + value.replace("\\", "\\\\").replace("$", "\\$")))

    def replace_all(self, pattern: str, value: str):
        return self.e.map(lambda a: F.regexp_replace(a, pattern, value))

    def slice(self, offset: int, length: int | None = None):
        def part(a: Column) -> Column:
            start = F.lit(offset + 1) if offset >= 0 else F.greatest(F.length(a) + offset + 1, F.lit(1))
            return a.substr(start, F.lit(length) if length is not None else F.length(a))

        return self.e.map(part)

    def split(self, by: str):
        return self.e.map(lambda a: F.split(a, re.escape(by)))

    def extract(self, pattern: str, group: int = 1):
        return self.e.map(lambda a: F.when(a.rlike(pattern), F.regexp_extract(a, pattern, group)))

    def count_match(self, pattern: str):
        return self.e.map(lambda a: F.regexp_count(a, F.lit(pattern)))

    def concat(self, delimiter: str = "-"):
        """The group's values in order, joined."""
        return replace(
            self.e,
            build=lambda c: c.aggregate(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c.order, self.e.build(Compile("agg", current=c.current)).alias("__v")))), lambda s: s["__v"]), delimiter)),
            aggregated=True,
            raw=True,
        )

    def ljust(self, width: int, fill: str = " "):
        return self.e.map(lambda a: F.when(F.length(a) >= width, a).otherwise(F.rpad(a, width, fill)))

    def rjust(self, width: int, fill: str = " "):
        return self.e.map(lambda a: F.when(F.length(a) >= width, a).otherwise(F.lpad(a, width, fill)))

    def zfill(self, width: int):
        return self.rjust(width, "0")

    def encode(self, encoding: str):
        return self.e.map(lambda a: F.lower(F.hex(a)) if encoding == "hex" else F.base64(a.cast("binary")))

    def decode(self, encoding: str):
        return self.e.map(lambda a: (F.unhex(a) if encoding == "hex" else F.unbase64(a)).cast("string"))

    def strptime(self, dtype: str, fmt: str, strict: bool = True):
        """Parse to "date" or "timestamp" by a C-style format; null on failure if not strict."""
        pattern = java_pattern(fmt)
        parse = F.to_timestamp if strict else lambda a, p: F.try_to_timestamp(a, F.lit(p))
        return self.e.map(lambda a: parse(a, pattern).cast("date" if dtype.lower() == "date" else "timestamp"))


@dataclass(frozen=True)
class TimeNamespace:
    e: Expr

    def year(self):
        return self.e.map(F.year)

    def month(self):
        return self.e.map(F.month)

    def day(self):
        return self.e.map(F.dayofmonth)

    def hour(self):
        return self.e.map(F.hour)

    def minute(self):
        return self.e.map(F.minute)

    def second(self):
        return self.e.map(lambda a: F.second(a))

    def weekday(self):
        """Monday is 0."""
        return self.e.map(F.weekday)

    def week(self):
        return self.e.map(F.weekofyear)

    def ordinal_day(self):
        return self.e.map(F.dayofyear)

    def quarter(self):
        return self.e.map(F.quarter)

    def truncate(self, every: str):
        n, unit = split_duration(every)
        if n == 1:
            return self.e.map(lambda a: F.date_trunc(SPARK_UNITS[unit], a))
        return self.e.map(lambda a: F.window(a, f"{n} {SPARK_UNITS[unit]}").start)

    def epoch(self, unit: str = "s"):
        return self.e.map(lambda a: {"s": F.unix_seconds, "ms": F.unix_millis, "us": F.unix_micros}[unit](a.cast("timestamp")))

    def offset_by(self, by: str):
        n, unit = split_duration(by)
        return self.e.map(lambda a: a + F.expr(f"INTERVAL '{n}' {SPARK_UNITS[unit].upper()}"))

    def strftime(self, fmt: str):
        return self.e.map(lambda a: F.date_format(a, java_pattern(fmt)))


@dataclass(frozen=True)
class ListNamespace:
    e: Expr

    def lengths(self):
        return self.e.map(F.size)

    def sum(self):
        return self.e.map(lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double")))

    def mean(self):
        return self.e.map(lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.size(a)))

    def min(self):
        return self.e.map(F.array_min)

    def max(self):
        return self.e.map(F.array_max)

    def get(self, i: int):
        return self.e.map(lambda a: F.try_element_at(a, F.lit(i + 1 if i >= 0 else i)))

    def first(self):
        return self.get(0)

    def last(self):
        return self.get(-1)

    def sort(self, reverse: bool = False):
        return self.e.map(lambda a: F.sort_array(a, not reverse))

    def reverse(self):
        return self.e.map(F.reverse)

    def unique(self):
        return self.e.map(F.array_distinct)

    def join(self, separator: str):
        return self.e.map(lambda a: F.array_join(a, separator))

    def contains(self, value):
        return self.e.map(lambda a: F.array_contains(a, value))

    def slice(self, offset: int, length: int):
        return self.e.map(lambda a: F.slice(a, offset + 1, length))

    def eval(self, f: Callable[[Column], Column]):
        return self.e.map(lambda a: F.transform(a, f))

    def to_struct(self, width: int):
        return self.e.map(lambda a: F.struct(*[F.try_element_at(a, F.lit(i + 1)).alias(f"field_{i}") for i in range(width)]))


@dataclass(frozen=True)
class StructNamespace:
    e: Expr

    def field(self, name: str):
        return self.e.map(lambda a: a[name]).alias(name)


#: Duration units (fixed values of the accepted notation).
SPARK_UNITS = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "mo": "month", "q": "quarter", "y": "year", "ms": "millisecond", "us": "microsecond"}

#: C-style date fields and Java's letters for them.
_JAVA = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "j": "DDD", "f": "SSSSSS", "a": "EEE", "A": "EEEE", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "%": "%"}


def java_pattern(fmt: str) -> str:
    """A C-style date format in Java's notation; other letters are quoted."""
    text = ""
    for i, part in enumerate(re.split(r"%(.)", fmt)):
        if i % 2 and part not in _JAVA:
            raise ValueError(f"unknown date field %{part}")
        text += _JAVA[part] if i % 2 else re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", part)
    return text


def split_duration(text: str) -> tuple[int, str]:
    m = re.fullmatch(r"(-?\d+)([a-z]+)", text)
    if not m or m[2] not in SPARK_UNITS:
        raise ValueError(f"unknown duration {text!r}")
    return int(m[1]), m[2]


def duration_micros(text: str) -> int:
    """Length of a fixed duration; months and years have none."""
    n, unit = split_duration(text)
    sizes = {"us": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}
    if unit not in sizes:
        raise ValueError(f"{text} has no fixed length")
    return n * sizes[unit]


def quantile_of(sorted_values: Column, q: float, interpolation: str) -> Column:
    """Quantile of a sorted array of non-null values; null for an empty one."""
    n = F.size(sorted_values)
    place = (n - 1) * F.lit(float(q))
    at = lambda i: F.try_element_at(sorted_values, (i + 1).cast("int"))
    low, high = at(F.floor(place)), at(F.ceil(place))
    found = {
        "nearest": lambda: at(F.floor(place + 0.5)),
        "lower": lambda: low,
        "higher": lambda: high,
        "midpoint": lambda: (low + high) / 2,
        "linear": lambda: low + (high - low) * (place - F.floor(place)),
    }
    if interpolation not in found:
        raise ValueError(f"interpolation must be one of {', '.join(found)}")
    return F.when(n > 0, found[interpolation]())


def quantile(value: Column, q: float, interpolation: str = "nearest") -> Column:
    """Exact quantile as one aggregate, for windows and small groups: ``linear`` keeps distinct values with counts, others a list."""
    ranks = ranks_of(q, interpolation)
    if interpolation == "linear":
        return F.percentile(value.cast("double"), q)
    n = F.count(value)
    found = [F.try_element_at(F.array_sort(F.collect_list(value)), (rank(n) + 1).cast("int")).cast("double") for rank in ranks]
    return F.when(n > 0, functools.reduce(lambda a, b: a + b, found) / len(found))


def ranks_of(q: float, interpolation: str) -> list[Callable[[Column], Column]]:
    """The ranks, from 0, whose values' mean is the quantile of n values; ``nearest`` rounds half up."""
    place = lambda n: (n - 1) * F.lit(float(q))
    low, high = (lambda n: F.floor(place(n))), (lambda n: F.ceil(place(n)))
    ranks = {"nearest": [lambda n: F.floor(place(n) + 0.5)], "lower": [low], "higher": [high], "midpoint": [low, high], "linear": [low, high]}
    if interpolation not in ranks:
        raise ValueError(f"interpolation must be one of {', '.join(ranks)}")
    return ranks[interpolation]


def ordered():
    """The module of order-dependent operators, which itself needs this one."""
    from cloister.operators import ordered as module

    return module


def _ewm_state(old, new, decay: float):
    """(weighted sum, known values, first known value) after another block."""
    if old is None:
        return new
    return (old[0] * decay ** new[1] + new[0], old[1] + new[1], new[2] if old[2] is None else old[2])


def _nearest_known(c: Compile, value: Column, backward: bool) -> Column:
    """The last value so far that is not null, or the first to come."""
    w = c.reversed() if backward else c.ordered()
    found = F.last(c.own(value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if not c.by_blocks:
        return found
    pick = F.min_by if backward else F.max_by
    own = c.own(value)
    return F.coalesce(found, c.whole.carry(pick(own, F.when(own.isNotNull(), F.col(PLACE))), latest, backward))


def between_known(value: Column, row: Column, a: Column, b: Column) -> Column:
    """Linear fill of nulls between known values, by position; ``a`` and ``b`` are the known ``{r, v}`` before and after."""
    between = a["v"] + (b["v"] - a["v"]) * F.try_divide(row - a["r"], b["r"] - a["r"])
    return F.when(value.isNotNull(), value.cast("double")).otherwise(between)


def col(name: str) -> Expr:
    return Expr(lambda c: F.col(f"`{name}`"), name, False, (name,), shown=(name,))


def _several(columns: Callable[[T.StructType], list[str]]) -> Expr:
    return Expr(lambda c: F.col(f"`{c.current}`"), "*", False, (), columns, shown=(EACH,))


def cols(*names: str) -> Expr:
    return _several(lambda schema: list(names))


def all_columns() -> Expr:
    return _several(lambda schema: schema.names)


def exclude(*names: str) -> Expr:
    return _several(lambda schema: [n for n in schema.names if n not in names])


def of_types(*types: type[T.DataType]) -> Expr:
    return _several(lambda schema: [f.name for f in schema if isinstance(f.dataType, types)])


def nth(i: int) -> Expr:
    return _several(lambda schema: [schema.names[i]])


def lit(value) -> Expr:
    """A literal counts as aggregated: it tells nothing about a row."""
    return Expr(lambda c: F.lit(value), "literal", True)


def count() -> Expr:
    return Expr(lambda c: c.aggregate_of(count_rows, F.lit(0)), "count", True)


@dataclass(frozen=True)
class When:
    cases: tuple[tuple[Expr, Expr], ...]
    pending: Expr | None

    def then(self, value) -> When:
        return When((*self.cases, (self.pending, lift(value))), None)

    def when(self, condition: Expr) -> When:
        return When(self.cases, condition)

    def otherwise(self, value) -> Expr:
        value = lift(value)
        parts = [e for pair in self.cases for e in pair] + [value]

        def build(c: Compile) -> Column:
            out = functools.reduce(lambda acc, case: acc.when(case[0].build(c), case[1].build(c)), self.cases[1:], F.when(self.cases[0][0].build(c), self.cases[0][1].build(c)))
            return out.otherwise(value.build(c))

        return Expr(build, self.cases[0][1].name, all(p.aggregated for p in parts), tuple(r for p in parts for r in p.roots), shown=tuple(r for p in parts for r in p.shown), raw=any(p.raw for p in parts))


def when(condition: Expr) -> When:
    return When((), condition)


def _all(parts: Sequence[Expr], f: Callable[..., Column], name: str) -> Expr:
    return Expr(lambda c: f(*[p.build(c) for p in parts]), name, all(p.aggregated for p in parts), tuple(r for p in parts for r in p.roots), shown=tuple(r for p in parts for r in p.shown), raw=any(p.raw for p in parts))


def concat_str(parts: Sequence, separator: str = "") -> Expr:
    """Null if any part is null."""
    found = [as_expr(p) for p in parts]
    return _all(found, lambda *c: F.when(functools.reduce(lambda a, b: a & b, [x.isNotNull() for x in c]), F.concat_ws(separator, *c)), found[0].name)


def coalesce(*parts) -> Expr:
    return _all([as_expr(p) for p in parts], F.coalesce, as_expr(parts[0]).name)


def struct(*parts) -> Expr:
    found = [as_expr(p) for p in parts]
    return _all(found, lambda *c: F.struct(*[x.alias(p.name) for x, p in zip(c, found, strict=True)]), found[0].name)


def array(*parts) -> Expr:
    return _all([as_expr(p) for p in parts], F.array, as_expr(parts[0]).name)


def arange(low, high, step: int = 1) -> Expr:
    """The numbers from ``low`` to before ``high`` as a list; none if ``step`` leads away from it."""
    if not step:
        raise ValueError("the step must not be 0")

    def numbers(a: Column, b: Column) -> Column:
        a, b = a.cast("long"), b.cast("long")
        filled = F.sequence(a, b - (1 if step > 0 else -1), F.lit(step).cast("long"))
        return F.when(a < b if step > 0 else a > b, filled).when(a.isNotNull() & b.isNotNull(), F.array().cast("array<long>"))

    return _all([lift(low), lift(high)], numbers, "arange")


def expand(exprs: Sequence[Expr], schema: T.StructType) -> list[Expr]:
    """Selectors of several columns become one expression for each column."""
    out = []
    for e in exprs:
        if e.columns is None:
            out.append(e)
        for name in e.columns(schema) if e.columns else []:
            build = lambda c, e=e, name=name: e.build(replace(c, current=name))
            out.append(replace(e, build=build, name=name + e.suffix_, roots=(name, *e.roots), shown=tuple(name if r == EACH else r for r in e.shown), columns=None))
    return out
