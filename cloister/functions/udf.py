"""Column functions for ``apply_udf``: expressions, so that they run in the JVM and can touch nothing but their column."""

from __future__ import annotations

from dataclasses import dataclass

from .expr import Expr


@dataclass(frozen=True)
class ApplyBins:
    """The lower end of the bin of width ``width`` that a value is in."""

    width: float

    def __call__(self, x: Expr) -> Expr:
        return (x / self.width).floor() * self.width


@dataclass(frozen=True)
class ApplyAbs:
    def __call__(self, x: Expr) -> Expr:
        return x.abs()
