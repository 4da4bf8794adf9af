"""Policies: which results of a guarded table may be released, and what happens to the others.

A policy has a rule (its safe zone), an action for results outside it, and whether results may be
saved.  Rules see the user and, for each source table, the smallest number of source rows behind an output
row and the largest number of copies that joins made of a source row.
"""

from __future__ import annotations

import enum
import json
import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Stats:
    """Provenance of a result with regard to one source."""

    agg_size: float = 1
    join_scaling: float = 1

    def merge(self, other: Stats) -> Stats:
        """Of two branches that both hold rows of the source: the smaller aggregation, the larger duplication."""
        return Stats(min(self.agg_size, other.agg_size), max(self.join_scaling, other.join_scaling))


@dataclass(frozen=True)
class Context:
    stats: Stats
    user: str | None = None


@dataclass(frozen=True)
class Match:
    ok: bool
    reason: str = ""


class Rule:
    def check(self, context: Context) -> Match:
        raise NotImplementedError

    def to_dict(self) -> dict:
        raise NotImplementedError

    @staticmethod
    def from_dict(data: dict) -> Rule:
        kind = data["rule"]
        if kind == "aggregation":
            return Aggregation(data["min"])
        if kind == "user":
            return UserId(data["id"])
        if kind == "at_least":
            return AtLeastNOf(data["n"], tuple(Rule.from_dict(r) for r in data["of"]))
        return {"true": TrueRule, "false": FalseRule}[kind]()


@dataclass(frozen=True)
class Aggregation(Rule):
    """Every output row stands for at least ``min_size`` source rows, after what joins duplicated."""

    min_size: int

    def check(self, context: Context) -> Match:
        least = self.min_size * context.stats.join_scaling
        if context.stats.agg_size >= least:
            return Match(True)
        return Match(False, f"an output row stands for {context.stats.agg_size:g} rows; at least {least:g} are required")

    def to_dict(self) -> dict:
        return {"rule": "aggregation", "min": self.min_size}


@dataclass(frozen=True)
class UserId(Rule):
    id: str

    def check(self, context: Context) -> Match:
        return Match(True) if context.user == self.id else Match(False, "the user is not the one that the rule names")

    def to_dict(self) -> dict:
        return {"rule": "user", "id": self.id}


@dataclass(frozen=True)
class AtLeastNOf(Rule):
    n: int
    of: tuple[Rule, ...]

    def check(self, context: Context) -> Match:
        found = [rule.check(context) for rule in self.of]
        if sum(m.ok for m in found) >= self.n:
            return Match(True)
        reasons = "; ".join(m.reason for m in found if not m.ok)
        return Match(False, f"only {sum(m.ok for m in found)} of {self.n} required rules hold: {reasons}")

    def to_dict(self) -> dict:
        return {"rule": "at_least", "n": self.n, "of": [r.to_dict() for r in self.of]}


@dataclass(frozen=True)
class TrueRule(Rule):
    def check(self, context: Context) -> Match:
        return Match(True)

    def to_dict(self) -> dict:
        return {"rule": "true"}


@dataclass(frozen=True)
class FalseRule(Rule):
    def check(self, context: Context) -> Match:
        return Match(False, "the rule never holds")

    def to_dict(self) -> dict:
        return {"rule": "false"}


class Action(enum.IntEnum):
    """What happens to a result outside the safe zone; the worst of several counts."""

    LOG = 0
    REVIEW = 1
    REJECT = 2


@dataclass(frozen=True)
class Verdict:
    """``action`` is None for a safe result."""

    action: Action | None = None
    reason: str = ""

    @property
    def safe(self) -> bool:
        return self.action is None

    def merge(self, other: Verdict) -> Verdict:
        """Safe is neutral; otherwise the worse action with its reason, the first at a tie."""
        if self.safe:
            return other
        if other.safe or self.action >= other.action:
            return self
        return other


@dataclass(frozen=True)
class Policy:
    safe_zone: Rule = Aggregation(10)
    unsafe_handling: Action = Action.REVIEW
    savable: bool = True

    def verdict(self, context: Context) -> Verdict:
        match = self.safe_zone.check(context)
        return Verdict() if match.ok else Verdict(self.unsafe_handling, match.reason)

    def merge(self, other: Policy) -> Policy:
        return Policy(AtLeastNOf(2, (self.safe_zone, other.safe_zone)), max(self.unsafe_handling, other.unsafe_handling), self.savable and other.savable)

    def to_json(self) -> str:
        return json.dumps({"safe_zone": self.safe_zone.to_dict(), "unsafe_handling": self.unsafe_handling.name, "savable": self.savable})

    @staticmethod
    def from_json(text: str) -> Policy:
        data = json.loads(text)
        return Policy(Rule.from_dict(data["safe_zone"]), Action[data["unsafe_handling"]], data["savable"])


#: What a result has whose sources were all safe.
ALLOW_ALL = Policy(TrueRule(), Action.LOG, True)
DEFAULT = Policy()


def judge(sources: dict[str, tuple[Policy, Stats]], user: str | None) -> tuple[Verdict, Policy]:
    """Verdict on a result and the policy that it inherits: only sources whose own verdict is unsafe contribute."""
    verdict, policy = Verdict(), ALLOW_ALL
    for own, stats in sources.values():
        found = own.verdict(Context(stats, user))
        if not found.safe:
            policy = policy.merge(own)
        verdict = verdict.merge(found)
    return verdict, policy


def times(a: float, b: float) -> float:
    """Product that saturates: infinity times anything but zero is infinity."""
    return 0 if a == 0 or b == 0 else math.inf if math.inf in (a, b) else a * b
