"""Time windows of fixed or calendar length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloister.functions.expr import duration_micros, split_duration

_MONTHS = {"mo": 1, "q": 3, "y": 12}


@dataclass(frozen=True)
class Span:
    """So many calendar months and microseconds."""

    months: int = 0
    micros: int = 0

    @staticmethod
    def of(text: str) -> Span:
        n, unit = split_duration(text)
        return Span(n * _MONTHS[unit]) if unit in _MONTHS else Span(0, duration_micros(text))

    def __add__(self, other: Span) -> Span:
        return Span(self.months + other.months, self.micros + other.micros)


@dataclass(frozen=True)
class Steps:
    """Windows number k start ``k * every + offset`` after 1970 and last ``period``."""

    every: Span
    period: Span
    offset: Span

    @staticmethod
    def of(every: str, period: str | None, offset: str | None) -> Steps:
        step = Span.of(every)
        length = Span.of(period) if period else step
        if step.months + step.micros <= 0 or length.months + length.micros <= 0:
            raise ValueError("every and period must be positive")
        return Steps(step, length, Span.of(offset) if offset else Span())

    def start(self, k: Column, more: Span = Span()) -> Column:
        """Microseconds at which window k starts, or the time ``more`` after that."""
        plus = self.offset + more
        if not self.every.months and not plus.months:
            return k * self.every.micros + plus.micros
        months = (k * self.every.months + plus.months).cast("int")
        day = F.add_months(F.lit("1970-01-01").cast("date"), months)
        moved = F.unix_micros(day.cast("timestamp")) + plus.micros
        return moved if self.every.months else moved + k * self.every.micros

    def numbers(self, t: Column) -> tuple[Column, Column]:
        """The first and last number of windows that can hold the time ``t`` (in microseconds), each at most two too far."""
        if self.every.months:
            when = F.timestamp_micros(t)
            month = (F.year(when) - 1970) * 12 + F.month(when) - 1
            slack = -(-abs(self.offset.micros) // (28 * 86_400 * 10**6)) + 1
            reach = self.period.months + -(-self.period.micros // (28 * 86_400 * 10**6)) + slack
            low, high = month - self.offset.months - reach, month - self.offset.months + slack
            return F.floor(low / self.every.months) - 1, F.floor(high / self.every.months) + 1
        month = 31 * 86_400 * 10**6
        span = lambda s: s.micros + s.months * month
        least = min(span(self.offset), self.offset.micros + self.offset.months * 28 * 86_400 * 10**6)
        return (F.floor((t - span(self.offset) - span(self.period)) / self.every.micros) - 1, F.floor((t - least) / self.every.micros) + 1)


def dealt(df: DataFrame, index: str, steps: Steps, closed: str) -> DataFrame:
    """Each row once for every window that holds it, with its bounds in microseconds as ``__start`` and ``__end``; null times are in none."""
    t = F.unix_micros(F.col(f"`{index}`").cast("timestamp"))
    low, high = steps.numbers(F.col("__t"))
    rows = df.withColumn("__t", t).where("__t is not null").withColumn("__k", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    rows = rows.withColumn("__start", steps.start(F.col("__k"))).withColumn("__end", steps.start(F.col("__k"), steps.period))
    after = "__t >= __start" if closed in ("left", "both") else "__t > __start"
    before = "__t <= __end" if closed in ("right", "both") else "__t < __end"
    return rows.where(f"{after} and {before}").drop("__t", "__k")
