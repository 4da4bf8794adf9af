import itertools
import math

import pytest

from cloister.policy import ALLOW_ALL, Action, Aggregation, AtLeastNOf, Context, FalseRule, Policy, Rule, Stats, TrueRule, UserId, Verdict, judge, times


def ctx(size=1, scaling=1, user=None):
    return Context(Stats(size, scaling), user)


@pytest.mark.parametrize(("size", "scaling", "ok"), [(10, 1, True), (9, 1, False), (10, 2, False), (20, 2, True), (1, 0, True), (math.inf, 50, True), (0, 1, False)])
def test_aggregation(size, scaling, ok):
    assert Aggregation(10).check(ctx(size, scaling)).ok is ok


def test_users_and_constants():
    assert UserId("a").check(ctx(user="a")).ok and not UserId("a").check(ctx(user="b")).ok and not UserId("a").check(ctx()).ok
    assert TrueRule().check(ctx()).ok and not FalseRule().check(ctx()).ok


@pytest.mark.parametrize("flags", list(itertools.product([True, False], repeat=3)))
@pytest.mark.parametrize("n", range(5))
def test_at_least(flags, n):
    rule = AtLeastNOf(n, tuple(TrueRule() if f else FalseRule() for f in flags))
    assert rule.check(ctx()).ok is (sum(flags) >= n)


def test_nothing_required_of_nothing():
    assert AtLeastNOf(0, ()).check(ctx()).ok


def test_json_round_trip():
    policy = Policy(AtLeastNOf(1, (Aggregation(5), AtLeastNOf(2, (UserId("u"), TrueRule(), FalseRule())))), Action.LOG, False)
    assert Policy.from_json(policy.to_json()) == policy
    assert Rule.from_dict(policy.safe_zone.to_dict()) == policy.safe_zone


@pytest.mark.parametrize(("a", "b"), list(itertools.product([None, *Action], repeat=2)))
def test_worst_verdict_wins(a, b):
    merged = Verdict(a, "first").merge(Verdict(b, "second"))
    if a is None and b is None:
        assert merged.safe
    else:
        worst = max(x for x in (a, b) if x is not None)
        assert merged.action is worst
        assert merged.reason == ("first" if a is worst else "second")


def test_only_unsafe_sources_hand_on_their_policy():
    strict, open_ = Policy(Aggregation(10), Action.REJECT, False), Policy(TrueRule())
    verdict, policy = judge({"a": (strict, Stats(100, 1)), "b": (open_, Stats())}, None)
    assert verdict.safe and policy == ALLOW_ALL
    verdict, policy = judge({"a": (strict, Stats(9, 1)), "b": (open_, Stats())}, None)
    assert verdict.action is Action.REJECT and not policy.savable and policy.unsafe_handling is Action.REJECT
    assert not policy.safe_zone.check(ctx(9)).ok and policy.safe_zone.check(ctx(10)).ok


def test_saturation():
    assert times(math.inf, math.inf) == math.inf and times(math.inf, 0) == 0 and times(3, 4) == 12
