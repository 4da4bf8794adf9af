"""Provenance of results: how many source rows stand behind an output row, and how far joins multiplied them.

Statistics are small Spark jobs that run when a result is collected, not while it is described.  A provenance also has
``sources``, the names of its tables, which need no job.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import Stats, times

Provenance = Callable[[], dict[str, Stats]]


def source(name: str) -> Provenance:
    return once(lambda: {name: Stats()}, [name])


def once(f: Provenance, sources: Iterable[str] | None = None) -> Provenance:
    known = f.sources if sources is None else frozenset(sources)
    cached = functools.cache(f)
    cached.sources = known
    return cached


def merged(one: Provenance, two: Provenance) -> Provenance:
    def run() -> dict[str, Stats]:
        a, b = one(), two()
        return {k: a[k].merge(b[k]) if k in a and k in b else a.get(k) or b[k] for k in {**a, **b}}

    return once(run, one.sources | two.sources)


def aggregated(inner: Provenance, size: Callable[[], float]) -> Provenance:
    """Aggregation over groups of at least ``size()`` rows."""

    def run() -> dict[str, Stats]:
        n = size()
        return {k: Stats(times(s.agg_size, n), s.join_scaling) for k, s in inner().items()}

    return once(run, inner.sources)


def scaled(inner: Provenance, factor: Callable[[], float]) -> Provenance:
    def run() -> dict[str, Stats]:
        n = factor()
        return {k: Stats(s.agg_size, times(s.join_scaling, n)) for k, s in inner().items()}

    return once(run, inner.sources)


def smallest_group(df: DataFrame, keys: Sequence[Column]) -> int:
    """Rows of the smallest group; 0 for no rows, which is unsafe."""
    groups = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.min("n")).first()[0] or 0


def key_matches(left: DataFrame, right: DataFrame, left_keys: Sequence[Column], right_keys: Sequence[Column], null_safe: bool = False) -> Callable[[], tuple[int, int]]:
    """(most right rows for one left row, most left rows for one right row); 1 at least.  Counts by key are
    summed before they are shuffled and joined, so a hot key is one row of the join."""

    @functools.cache
    def run() -> tuple[int, int]:
        names = [f"__k{i}" for i in range(len(left_keys))]

        def counts(df: DataFrame, keys: Sequence[Column], side: str) -> DataFrame:
            return df.groupBy(*[k.alias(f"{n}{side}") for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias(f"__n{side}"))

        a, b = counts(left, left_keys, "l"), counts(right, right_keys, "r")
        equal = lambda n: F.col(f"{n}l").eqNullSafe(F.col(f"{n}r")) if null_safe else F.col(f"{n}l") == F.col(f"{n}r")
        row = a.join(b, functools.reduce(lambda x, y: x & y, map(equal, names))).agg(F.max("__nr"), F.max("__nl")).first()
        return max(row[0] or 1, 1), max(row[1] or 1, 1)

    return run

