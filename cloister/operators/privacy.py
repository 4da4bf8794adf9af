"""Differential privacy: budgets, the Gaussian mechanism, and values that know their sensitivity.

Data sets are neighbours if one has one sample more than the other, so a sum of values of norm c at most has sensitivity c.
Noise is drawn from the system's entropy, by one generator for each data set; a seed is for tests only.
"""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloister.sources.commits import Journal


class BudgetExceeded(PermissionError):
    """A release would spend more than the data set's limit."""


class BudgetLedger:
    """What has been spent of a budget, as a journal in a store: one entry for each spending, with the total so far.

    An entry is committed before what it pays for is released, so a crash leaves it spent.  Of several writers who add the
    same entry one succeeds; the others read the new total and are judged by that.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.journal = Journal(spark, folder)

    def read(self) -> tuple[int, float, bool]:
        """(number of the last entry, total spent, whether something was released without any guarantee)."""
        number, entry = self.journal.last()
        return (number, entry["spent"], entry["poisoned"]) if entry else (0, 0.0, False)

    def add(self, epsilon: float, after: int, spent: float, poisoned: bool) -> bool:
        """Commit an entry after number ``after``, whose totals are given; False if another writer has added one."""
        finite = math.isfinite(epsilon)
        return self.journal.append({"epsilon": epsilon if finite else None, "spent": spent + (epsilon if finite else 0.0), "poisoned": poisoned or not finite}, after)

    def carry(self, spent: float, poisoned: bool) -> None:
        """Add what was spent elsewhere."""
        while spent or poisoned:
            number, total, before = self.read()
            if self.journal.append({"epsilon": spent, "spent": total + spent, "poisoned": before or poisoned}, number):
                return


@dataclass
class PrivacyContext:
    """The budget of a data set of ``n`` samples; ``limit`` None means that nothing is private.  With a ``ledger`` what is spent is kept there."""

    limit: float | None
    n: int
    spent: float = 0.0
    poisoned: bool = False  # something was released without any guarantee
    rng: np.random.Generator = field(default_factory=np.random.default_rng, repr=False, compare=False)
    ledger: BudgetLedger | None = field(default=None, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.ledger:
            _, self.spent, self.poisoned = self.ledger.read()

    @property
    def delta(self) -> float:
        return 1 / (10 * max(self.n, 1))

    def allows(self, epsilon: float) -> bool:
        return self.limit is None or (not self.poisoned and math.isfinite(epsilon) and self.spent + epsilon < self.limit)

    def spend(self, epsilon: float) -> None:
        while True:
            if self.ledger:
                number, self.spent, self.poisoned = self.ledger.read()
            if not self.allows(epsilon):
                raise BudgetExceeded(f"{epsilon:g} on top of {self.spent:g} is not below the limit of {self.limit:g}")
            if self.ledger is None or self.ledger.add(epsilon, number, self.spent, self.poisoned):
                break
        if math.isinf(epsilon):
            self.poisoned = True
        else:
            self.spent += epsilon


def sigma(epsilon: float, delta: float, l2: float) -> float:
    """Noise of the Gaussian mechanism for a value of L2 sensitivity ``l2``."""
    return l2 * math.sqrt(2 * math.log(1.25 / delta)) / (epsilon + 1e-8)


def noise(shape, std: float, rng: np.random.Generator) -> np.ndarray:
    """Half the sum of four normal draws: the same deviation, harder to read off floating-point gaps."""
    return rng.normal(0, std, (4, *shape)).sum(axis=0) / 2 if std else np.zeros(shape)


@dataclass(frozen=True)
class Guarded:
    """A value that only leaves with noise.  ``linf`` bounds how far one sample moves an element, None if unknown;
    ``batches`` are those a per-sample value comes from, None once samples are mixed."""

    value: np.ndarray
    context: PrivacyContext
    linf: float | None = None
    batches: frozenset[int] | None = None

    def _join(self, other: Guarded, value: np.ndarray) -> Guarded:
        apart = self.batches is not None and other.batches is not None and not self.batches & other.batches
        if self.linf is None or other.linf is None:
            linf = None
        else:  # a sample is in one of two disjoint batches, or in both values
            linf = max(self.linf, other.linf) if apart else self.linf + other.linf
        return replace(self, value=value, linf=linf, batches=self.batches | other.batches if apart else None)

    def __add__(self, other):
        return self._join(other, self.value + other.value) if isinstance(other, Guarded) else replace(self, value=self.value + other)

    def __sub__(self, other):
        return self._join(other, self.value - other.value) if isinstance(other, Guarded) else replace(self, value=self.value - other)

    def __mul__(self, factor: float):
        return replace(self, value=self.value * factor, linf=None if self.linf is None else self.linf * abs(factor))

    def __truediv__(self, factor: float):
        return self * (1 / factor)

    def clamp(self, low: float, high: float) -> Guarded:
        return replace(self, value=np.clip(self.value, low, high), linf=high - low)

    def argmax(self) -> Guarded:
        return replace(self, value=self.value.argmax(axis=-1).astype(float), linf=float(self.value.shape[-1] - 1))

    def abs(self) -> Guarded:
        return replace(self, value=np.abs(self.value))

    def sum(self) -> Guarded:
        """Of per-sample values: one sample moves the sum by what it moves its element; else by every element."""
        width = 1 if self.batches is not None else self.value.size
        return replace(self, value=np.asarray(self.value.sum()), linf=None if self.linf is None else self.linf * width)

    def release(self, epsilon: float | None) -> np.ndarray:
        """The value with noise for ``epsilon``; None asks for the bare value, which only an unlimited budget grants."""
        if epsilon is None:
            self.context.spend(math.inf)
            return self.value
        if self.linf is None:
            raise ValueError("the sensitivity is unknown: clamp the value first")
        self.context.spend(epsilon)
        return self.value + noise(self.value.shape, sigma(epsilon, self.context.delta, math.sqrt(self.value.size) * self.linf), self.context.rng)


def release_column(df: DataFrame, column: str, context: PrivacyContext, linf: float, epsilon: float | None) -> DataFrame:
    """A table of sums or counts, each sample in one of its rows, with noise on ``column``, drawn where the rows are: nothing passes
    the driver.  ``linf`` bounds what one sample adds to its row, which is also the sensitivity of the whole column."""
    if epsilon is None:
        context.spend(math.inf)
        return df
    context.spend(epsilon)
    draws = sum((F.randn(secrets.randbits(62)) for _ in range(3)), F.randn(secrets.randbits(62)))
    return df.withColumn(column, F.col(f"`{column}`").cast("double") + draws / 2 * sigma(epsilon, context.delta, linf))


def step_epsilon(epsilon: float, rate: float, epochs: int) -> float:
    """Share of one step: epsilon over rate times the square root of the number of steps."""
    return epsilon / (rate * math.sqrt(epochs / rate))


def step_cost(epsilon: float, rate: float, t: int) -> float:
    """What step ``t`` (from 0) of that epsilon adds to the spent budget."""
    return epsilon * rate * (math.sqrt(t + 1) - math.sqrt(t))
