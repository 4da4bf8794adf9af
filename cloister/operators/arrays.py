"""Arrays, splits and tokens from tables."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloister.operators.ordered import row_index

_FLAT = (T.FloatType, T.DoubleType, T.LongType, T.IntegerType)
_LISTS = (*_FLAT, T.ShortType)
#: Texts of so many bytes, and one more text, are encoded at once and go back to Spark before the next.
ENCODE_BYTES = 1 << 20
MIXED = "DataTypes for all columns should be the same"


@dataclass(frozen=True)
class ArrayFrame:
    """An n-dimensional array as a table: ``row`` from 0 and ``value``, an array for each row.  ``inner`` is the shape of a row."""

    df: DataFrame
    dtype: str
    inner: tuple[int, ...]

    @property
    def height(self) -> int:
        return self.df.count()

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.height, *self.inner)

    def to_tensor(self) -> Tensor:
        return Tensor(self)

    def to(self, dtype: str) -> ArrayFrame:
        """Another element type."""
        kind = functools.reduce(lambda t, _: f"array<{t}>", self.inner, dtype)
        return replace(self, df=self.df.withColumn("value", F.col("value").cast(kind)), dtype=dtype)

    def append(self, other: ArrayFrame) -> ArrayFrame:
        if (self.dtype, self.inner) != (other.dtype, other.inner):
            raise ValueError("arrays of different type or row shape")
        start = self.height
        return replace(self, df=self.df.unionAll(other.df.withColumn("row", F.col("row") + start)))

    def stack(self, *others: ArrayFrame) -> ArrayFrame:
        """Rows side by side, as a new axis after the first."""
        parts = [self, *others]
        if len({(p.dtype, p.inner) for p in parts}) > 1:
            raise ValueError("arrays of different type or row shape")
        joined = self.df.withColumnRenamed("value", "v0")
        for i, p in enumerate(others, 1):
            joined = joined.join(p.df.withColumnRenamed("value", f"v{i}"), "row")
        return replace(self, df=joined.select("row", F.array(*[f"v{i}" for i in range(len(parts))]).alias("value")), inner=(len(parts), *self.inner))

    def shuffle(self, seed: int = 0) -> ArrayFrame:
        return replace(self, df=row_index(self.df.drop("row"), [F.xxhash64(F.lit(seed), F.col("value"))], "row"))


@dataclass(frozen=True)
class Tensor:
    """A handle to an array that tells its element type and shape only; data sets are made of handles."""

    _array: ArrayFrame

    @property
    def dtype(self) -> str:
        return self._array.dtype

    @functools.cached_property
    def shape(self) -> tuple[int, ...]:
        return self._array.shape

    def to(self, dtype: str) -> Tensor:
        return Tensor(self._array.to(dtype))

    def __repr__(self) -> str:
        return f"Tensor(dtype={self.dtype}, shape={self.shape})"


def to_array(df: DataFrame, order: Sequence) -> ArrayFrame:
    """Columns of one numeric type, or of lists of one numeric type and length, as an array of rows."""
    types = [f.dataType for f in df.schema]
    if any(isinstance(t, T.StringType) or (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType)) for t in types):
        raise TypeError("text columns have to be tokenized first")
    if len({t.simpleString() for t in types}) != 1:
        raise TypeError(MIXED)
    kind = types[0]
    value = F.array(*[F.col(f"`{c}`") for c in df.columns]).alias("value")
    if isinstance(kind, _FLAT):
        return ArrayFrame(row_index(df, order, "row").select("row", value), kind.simpleString(), (len(types),))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, _LISTS):
        sizes = df.agg(*[f(F.size(c)).alias(f"{n}{i}") for i, c in enumerate(df.columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        found = {v for v in sizes if v is not None}
        if len(found) > 1:
            raise ValueError("lists of different lengths")
        return ArrayFrame(row_index(df, order, "row").select("row", value), kind.elementType.simpleString(), (len(types), max(found, default=0)))
    raise TypeError(f"columns of type {kind.simpleString()} make no array")


def train_test_split(*arrays: ArrayFrame, train_size: float | None = None, test_size: float | None = None, shuffle: bool = False, random_state: int = 0) -> list[ArrayFrame]:
    """[train, test] of each array, cut at floor(rows * train_size) of one order that all arrays share.

    A size that is not given is the rest; with neither, a quarter is for the test.
    """
    if (train_size or 0) < 0 or (test_size or 0) < 0:
        raise ValueError("sizes must not be negative")
    if test_size is None:
        test_size = 0.25 if train_size is None else 1 - train_size
    train_size = 1 - test_size if train_size is None else train_size
    heights = [a.height for a in arrays]
    if len(set(heights)) > 1:
        raise ValueError("arrays of different heights")
    out = []
    for a in arrays:
        n = heights[0]
        cut = math.floor(n * train_size + 1e-9)
        end = n if train_size + test_size >= 1 - 1e-9 else cut + math.floor(n * test_size + 1e-9)
        df = a.df
        if shuffle:  # by the row number, so that rows of all arrays move alike
            df = row_index(df, [F.xxhash64(F.lit(random_state), "row"), F.col("row")], "__place")
        else:
            df = df.withColumn("__place", F.col("row"))
        train = df.where(F.col("__place") < cut)
        test = df.where((F.col("__place") >= cut) & (F.col("__place") < end))
        out += [replace(a, df=train.select(F.col("__place").alias("row"), "value")), replace(a, df=test.select((F.col("__place") - cut).alias("row"), "value"))]
    return out


@dataclass(frozen=True)
class TokenizerConfig:
    """A tokenizer file and how its output is padded and cut.  Padding without truncation cuts at the padded length too."""

    path: str
    pad_length: int | None = None
    pad_id: int = 0
    max_length: int | None = None

    def enable_padding(self, length: int, pad_id: int = 0) -> TokenizerConfig:
        return replace(self, pad_length=length, pad_id=pad_id)

    def no_padding(self) -> TokenizerConfig:
        return replace(self, pad_length=None)

    def enable_truncation(self, max_length: int) -> TokenizerConfig:
        return replace(self, max_length=max_length)

    def no_truncation(self) -> TokenizerConfig:
        return replace(self, max_length=None)

    def vocabulary(self) -> dict[str, int]:
        return _tokenizer(self.path).get_vocab()


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(df: DataFrame, config: TokenizerConfig, add_special_tokens: bool = True) -> DataFrame:
    """Each text column c as ``c_ids`` and ``c_mask``, arrays of longs; a null text gives nulls.  Other columns are an error."""
    for f in df.schema:
        if not isinstance(f.dataType, T.StringType):
            raise TypeError(f"column {f.name} is not text")

    names = [f.name for f in df.schema]
    cut = config.max_length if config.max_length is not None else config.pad_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(config.path)
        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) for column in batch.columns)
            turns = (np.cumsum(sizes) - sizes) // ENCODE_BYTES
            starts = np.flatnonzero(np.diff(turns, prepend=-1))
            for low, high in zip(starts, [*starts[1:], len(turns)], strict=True):
                columns: list[pa.Array] = []
                for column in batch.columns:
                    texts = column.slice(low, high - low).to_pylist()
                    found = tokenizer.encode_batch([t for t in texts if t is not None], add_special_tokens=add_special_tokens)
                    columns += _padded([e.ids for e in found], [t is not None for t in texts], cut, config)
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    kinds = [f"{c}_{k}" for c in names for k in ("ids", "mask")]
    out = df.mapInArrow(run, ", ".join(f"c{i} array<long>" for i in range(len(kinds))))
    return out.toDF(*kinds)


def _padded(ids: list[list[int]], known: list[bool], cut: int | None, config: TokenizerConfig) -> list[pa.Array]:
    """[ids, masks] of texts, cut and padded; null for those not known."""
    rows, n = [np.asarray(x[:cut] if cut is not None else x, np.int64) for x in ids], config.pad_length or 0
    more = [max(0, n - len(x)) for x in rows]
    values = [[piece for x, m in zip(rows, more, strict=True) for piece in (x, np.full(m, config.pad_id, np.int64))], [piece for x, m in zip(rows, more, strict=True) for piece in (np.ones(len(x), np.int64), np.zeros(m, np.int64))]]
    lengths = np.zeros(len(known) + 1, np.int64)
    lengths[1:][np.asarray(known, bool)] = [len(x) + m for x, m in zip(rows, more, strict=True)]
    offsets = pa.array(np.cumsum(lengths), pa.int32(), mask=np.append(~np.asarray(known, bool), False))
    return [pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *v])) for v in values]
