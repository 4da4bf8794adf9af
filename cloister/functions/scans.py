"""Functions of the ordered values of a block of rows, in Python: quantiles of windows, and folds that merge.

Each gets one segment, the rows of one group in one block with the copies before it, and returns a value for each of its own rows.
What a fold carries into a block is found first, from pieces: rows of a block that follow each other in one task.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Windows of so many rows at most are sorted for each row, in the JVM.
SHORT_WINDOW = 64


#: Windows, or as many as one has rows, that share a wavelet matrix.
PART_ROWS = 30_000

_KINDS = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


class Scan:
    """``rows`` has the place and result of each of a segment's own rows.  With ``carries``, ``added`` sums values up first."""

    dtype = "double"
    carries = False

    def rows(self, segment: pa.Table) -> pa.Table:
        raise NotImplementedError


def plain(column: pa.Array | pa.ChunkedArray) -> list:
    """``to_pylist``, by way of numpy for numbers, which takes a seventh of the time."""
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_pylist()
    values = (pc.fill_null(column, 0) if column.null_count else column).to_numpy().tolist()
    if column.null_count:
        for i in np.flatnonzero(np.asarray(pc.is_null(column))):
            values[i] = None
    return values


def _out(segment: pa.Table, values: list, kind: pa.DataType = pa.float64()) -> pa.Table:  # noqa: B008
    return pa.table({"__ord": segment["__ord"], "__out": pa.array(values, kind)}).filter(pc.invert(segment["__halo"]))


@dataclass(frozen=True)
class SlidingQuantile(Scan):
    """The quantile of the known values of the last ``size`` rows, null if they are fewer than ``least``.  NaN is the largest value.

    A wavelet matrix of the values' ranks, built once for a segment, finds the value of any rank in any window in as many steps as a rank has bits,
    for all windows at once; so the work hardly grows with the window."""

    size: int
    least: int
    q: float
    interpolation: str

    def rows(self, segment: pa.Table) -> pa.Table:
        segment = segment.sort_by("__ord")
        known = np.asarray(pc.is_valid(segment["__v"]))
        so_far = np.concatenate([[0], np.cumsum(known)])
        own = np.flatnonzero(~np.asarray(segment["__halo"]))
        left, right = so_far[np.maximum(own + 1 - self.size, 0)], so_far[own + 1]
        n = right - left
        found = np.flatnonzero((n > 0) & (n >= self.least))
        out = np.zeros(len(own))
        values = pc.drop_null(segment["__v"]).to_numpy()
        step = max(self.size, PART_ROWS)
        for a in range(0, len(found), step):
            at = found[a : a + step]
            first, end = int(left[at[0]]), int(right[at[-1]])
            out[at] = self._of(values[first:end], left[at] - first, right[at] - first)
        missing = np.ones(len(own), bool)
        missing[found] = False
        return pa.table({"__ord": segment["__ord"].take(pa.array(own)), "__out": pa.array(out, pa.float64(), mask=missing)})

    def _of(self, values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        order = np.argsort(values, kind="stable")  # NaN last
        rank = np.empty(len(values), np.int32)
        rank[order] = np.arange(len(values), dtype=np.int32)
        place = (right - left - 1) * self.q
        low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
        if self.interpolation == "nearest":
            low = high = np.floor(place + 0.5).astype(np.int64)
        elif self.interpolation in ("lower", "higher"):
            low = high = low if self.interpolation == "lower" else high
        levels = _wavelet(rank)
        x = values[order[_of_rank(levels, left, right, low)]]
        if low is high:
            return x
        y = x.copy()
        more = np.flatnonzero(high > low)
        y[more] = values[order[_of_rank(levels, left[more], right[more], high[more])]]
        with np.errstate(invalid="ignore"):  # of infinities
            return (x + y) / 2 if self.interpolation == "midpoint" else x + (y - x) * (place - low)


def _wavelet(rank: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each bit of distinct numbers from 0, highest first: (bit, how many without it come before each place) in the order of the bits before."""
    levels = []
    for bit in reversed(range(max(len(rank) - 1, 0).bit_length())):
        ones = (rank >> bit & 1).astype(bool)
        zeros = np.zeros(len(rank) + 1, np.int32)
        np.cumsum(~ones, out=zeros[1:])
        levels.append((bit, zeros))
        rank = np.concatenate([rank[~ones], rank[ones]])
    return levels


def _of_rank(levels: list[tuple[int, np.ndarray]], left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The number with ``k`` smaller ones among those at places ``left`` to ``right`` (without) of each window."""
    left, right, k, found = left.astype(np.int32), right.astype(np.int32), k.astype(np.int32), np.zeros(len(k), np.int32)
    for bit, zeros in levels:
        a, b = zeros[left], zeros[right]
        one = k >= b - a
        found |= one.astype(np.int32) << bit
        k = np.where(one, k - (b - a), k)
        left, right = np.where(one, left - a + zeros[-1], a), np.where(one, right - b + zeros[-1], b)
    return found


@dataclass(frozen=True)
class Fold(Scan):
    """``finish`` of the state after each row; see ``Expr.cumulative_fold``."""

    start: object
    step: Callable
    merge: Callable
    finish: Callable
    dtype: str = "double"
    carries = True

    def __post_init__(self) -> None:
        if self.dtype not in _KINDS:
            raise ValueError(f"a fold's type must be one of {', '.join(_KINDS)}")

    def _start(self):
        return pickle.loads(pickle.dumps(self.start))  # steps may change their argument

    def _own(self, segment: pa.Table) -> pa.Table:
        return segment.filter(pc.invert(segment["__halo"])).sort_by("__ord")

    def added(self, state, values: list):
        """The state after more values; of none before, ``state`` is None."""
        state, step = self._start() if state is None else pickle.loads(state), self.step
        for v in values:
            if v is not None:
                state = step(state, v)
        return pickle.dumps(state)

    def merged(self, before: bytes | None, own: bytes) -> bytes:
        return own if before is None else pickle.dumps(self.merge(pickle.loads(before), pickle.loads(own)))

    def rows(self, segment: pa.Table) -> pa.Table:
        own = self._own(segment)
        carried = own["__state"][0].as_py() if len(own) else None
        state, out = self._start() if carried is None else pickle.loads(carried), []
        step, finish = self.step, self.finish
        for v in plain(own["__v"]):
            if v is not None:
                state = step(state, v)
            out.append(finish(state))
        return _out(own, out, _KINDS[self.dtype])


def in_turn(segment: pa.Table, runs: Sequence[tuple[str, Scan]]) -> pa.Table:
    """The places of a segment's own rows, with the result of each scan under its name; ``__v0`` is the value of the first, ``__s0`` what is carried to it."""
    segment, out = segment.sort_by("__ord"), None
    for i, (name, run) in enumerate(runs):
        own = pa.table({"__ord": segment["__ord"], "__halo": segment["__halo"], "__v": segment[f"__v{i}"]})
        found = run.rows(own.append_column("__state", segment[f"__s{i}"]) if run.carries else own)
        out = found.rename_columns(["__ord", name]) if out is None else out.append_column(name, found["__out"])
    return out


def pieces(batches: Iterator[pa.RecordBatch], runs: Sequence[tuple[int, Scan]]) -> Iterator[pa.RecordBatch]:
    """One row for each piece, rows of a block whose places follow each other: its first place, the groups that it begins and ends with, and the
    state (by number of the scan) of its last group.  A block's groups in between are whole and carry nothing."""
    names = ["__block", "__from", "__f0", "__f1", "__h0", "__h1", *[f"__s{i}" for i, _ in runs]]
    types = [pa.int64()] * 6 + [pa.binary()] * len(runs)
    open_: list | None = None  # the piece so far, and the place that would go on with it
    after = -1

    def row(piece: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x], t) for x, t in zip(piece, types, strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        block, h0, h1, place = (batch[n].to_numpy() for n in ("__block", "__h0", "__h1", "__ord"))
        cut = (np.diff(block) != 0) | (np.diff(place) != 1)
        starts = [0, *(np.flatnonzero(cut) + 1).tolist()]
        changes = np.flatnonzero((np.diff(h0) != 0) | (np.diff(h1) != 0)) + 1
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            inside = changes[(changes > a) & (changes < b)]
            last = int(inside[-1]) if len(inside) else a
            own = [int(h0[b - 1]), int(h1[b - 1])]
            if open_ is not None and (open_[0] != block[a] or after != place[a]):
                yield row(open_)
                open_ = None
            begun = open_ is not None and last == a and open_[4:6] == own
            first = open_[1:4] if open_ is not None else [int(place[a]), int(h0[a]), int(h1[a])]
            states = open_[6:] if begun else [None] * len(runs)
            states = [run.added(state, plain(batch[f"__v{i}"].slice(last, b - last))) for (i, run), state in zip(runs, states, strict=True)]
            open_, after = [int(block[a]), *first, *own, *states], place[b - 1] + 1
    if open_ is not None:
        yield row(open_)


def _over_ranges(values: np.ndarray, low: np.ndarray, high: np.ndarray, join: np.ufunc, empty: float) -> np.ndarray:
    """``join`` of the values at places ``low`` to ``high`` (without) of each range, from two pieces of it at most: what goes up to a
    middle and what comes after it, of halves that double from level to level.  Nothing is taken off again, so no digits are lost."""
    out, last = np.full(len(low), empty), high - 1
    one = last == low
    out[one] = values[low[one]]
    levels = np.where(last > low, np.frexp((low ^ last).astype(float))[1] - 1, -1)
    for level in range(max(levels.max(initial=-1) + 1, 0)):
        at = np.flatnonzero(levels == level)
        if len(at):
            half = 1 << level
            halves = np.concatenate([values, np.full(-len(values) % (2 * half), empty)]).reshape(-1, 2, half)
            upto, after = join.accumulate(halves[:, 0, ::-1], axis=1)[:, ::-1], join.accumulate(halves[:, 1], axis=1)
            out[at] = join(upto[low[at] // (2 * half), low[at] % half], after[last[at] // (2 * half), last[at] % half])
    return out


#: Kinds of aggregates of ``rolling`` and how two values of doubles are joined; NaN is the largest.
JOINS = {"sum": (np.add, 0.0), "avg": (np.add, 0.0), "min": (np.fmin, math.nan), "max": (np.maximum, -math.inf)}


def rolling(segment: pa.Table, low: int, high: int, asked: list[tuple[str, str]]) -> pa.Table:
    """A segment's own rows with aggregates of the rows whose time ``__t`` is from ``low`` to ``high`` around theirs, each (column, kind); its values
    are in the column, which the aggregate replaces.  Rows without a time are each other's window."""
    known = np.flatnonzero(pc.is_valid(segment["__t"]).to_numpy())
    times = segment["__t"].take(pa.array(known)).to_numpy()
    order = known[np.argsort(times, kind="stable")]
    segment = segment.take(pa.array(np.concatenate([order, np.setdiff1d(np.arange(len(segment)), known)])))
    n, times = len(known), np.sort(times)
    left, right = (np.full(len(segment), end, np.int64) for end in (n, len(segment)))
    left[:n], right[:n] = np.searchsorted(times, times + low, "left"), np.searchsorted(times, times + high, "right")
    right = np.maximum(left, right)
    own, out = pc.invert(segment["__halo"]), {}
    for name, kind in asked:
        if kind == "count":
            out[name] = pa.array(right - left)
            continue
        column = segment[name]
        valid = pc.is_valid(column).to_numpy()
        so_far = np.concatenate([[0], np.cumsum(valid)])
        found = so_far[right] - so_far[left]
        if pa.types.is_integer(column.type):
            so_far = np.concatenate([[0], np.cumsum(pc.fill_null(column, 0).to_numpy())])
            values = so_far[right] - so_far[left]
        else:
            join, empty = JOINS[kind]
            values = _over_ranges(pc.fill_null(column, empty).to_numpy(), left, right, join, empty)
        if kind == "avg":
            values = values / np.maximum(found, 1)
        out[name] = pa.array(values, mask=found == 0)
    for name, values in out.items():
        segment = segment.set_column(segment.schema.get_field_index(name), name, values)
    return segment.filter(own)
