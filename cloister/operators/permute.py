"""Keyed permutations of row numbers: batches of exact sizes for any epoch, from arithmetic on each row alone.

A number below n is written with two digits of base ``side``, the least with side^2 >= n.  Feistel rounds (l, r) -> (r, l + h(r)
mod side) permute such pairs for any round function h.  A number that lands at n or beyond is permuted again until it
does not; the numbers beyond n are few (2 sqrt(n) + 1 at most), so the driver finds how many times that can happen.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: The modulus of round functions, a prime: products of two residues fit in 63 bits.
PRIME = 2**31 - 1


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0 .. n - 1.  ``keys`` has three residues for each round; ``walks`` is how often a number is permuted again at most."""

    n: int
    keys: tuple[tuple[int, int, int], ...]
    side: int
    walks: int

    @staticmethod
    def of(n: int, *key: int | str) -> Permutation:
        """The permutation that belongs to ``key``."""
        if n > 2**60:
            raise ValueError("numbers must be below 2^60")
        side, digest = math.isqrt(max(n, 1) - 1) + 1, b""
        for k in range(3 * ROUNDS // 8 + 1):
            digest += hashlib.sha256(repr((*key, k)).encode()).digest()
        residues = [int.from_bytes(digest[4 * i : 4 * i + 4], "little") % (PRIME - 1) + 1 for i in range(3 * ROUNDS)]
        keys = tuple(tuple(residues[3 * i : 3 * i + 3]) for i in range(ROUNDS))
        bare, beyond = Permutation(n, keys, side, 0), np.arange(n, side * side)
        reached, walks = np.setdiff1d(beyond, bare._once(beyond)), 0  # numbers beyond n that are met on the way from one below
        while len(reached):
            walks += 1
            reached = bare._once(reached)
            reached = reached[reached >= n]
        return Permutation(n, keys, side, walks)

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = np.divmod(np.asarray(x, np.int64), self.side)
        for a, b, c in self.keys:
            t = (right % PRIME * a + b) % PRIME
            left, right = right, (left + t * ((t + c) % PRIME) % PRIME) % self.side
        return left * self.side + right

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Where numbers go."""
        y = self._once(x)
        for _ in range(self.walks):
            y = np.where(y < self.n, y, self._once(y))
        return y

    def column(self, x: Column) -> Column:
        """The same as an expression on a column of numbers from 0 to n - 1."""
        side, keys = F.lit(self.side).cast("long"), F.array(*[F.struct(*[F.lit(k).cast("long").alias(name) for k, name in zip(key, "abc", strict=True)]) for key in self.keys])

        def turn(pair: Column, key: Column) -> Column:
            t = (pair["r"] % PRIME * key["a"] + key["b"]) % PRIME
            return F.struct(pair["r"].alias("l"), ((pair["l"] + t * ((t + key["c"]) % PRIME) % PRIME) % side).alias("r"))

        def once(value: Column) -> Column:
            start = F.struct(F.call_function("div", value, side).alias("l"), (value % side).alias("r"))
            return F.aggregate(keys, start, turn, lambda pair: pair["l"] * side + pair["r"])

        y = once(x.cast("long"))
        if not self.walks:
            return y
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.walks)), y, lambda at, _: F.when(at < self.n, at).otherwise(once(at)))
