"""The number of sequences against best-fit decreasing over the same pieces, and against the least that is possible."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloister.llm.packing import CAPACITY, SLACKS, combinations, fullest, op9_best_fit_packing


def best_fit_decreasing(lengths, capacity):
    space, bins = np.zeros(capacity + 1, int), 0
    for length in sorted(lengths, reverse=True):
        fits = np.flatnonzero(space[length:])
        if len(fits):
            space[length + fits[0]] -= 1
            space[fits[0]] += 1
        else:
            bins += 1
            space[capacity - length] += 1
    return bins


def least(lengths, capacity):
    """A bound: pieces of over half a sequence need one each, and the others fill at best what those leave."""
    lengths, best = np.array(lengths), -(-int(sum(lengths)) // capacity)
    for k in range(capacity // 2 + 1):
        long = (lengths > capacity // 2) & (lengths <= capacity - k)
        rest = lengths[(lengths >= k) & (lengths <= capacity // 2)].sum() - (capacity * long.sum() - lengths[long].sum())
        best = max(best, int((lengths > capacity // 2).sum()) + max(0, -(-int(rest) // capacity)))
    return best


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_more_sequences_than_best_fit(spark, sf):
    found = op9_best_fit_packing(spark, f"/root/testdata/{sf}").select("length", "sequence_id").toPandas()
    bins = found["sequence_id"].nunique()
    assert found["sequence_id"].max() == bins - 1
    assert bins <= best_fit_decreasing(found["length"], CAPACITY) and bins <= 1.006 * least(found["length"], CAPACITY)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(0, 12))
def test_allowed_slack(lengths, slack):
    counts = np.bincount(lengths, minlength=41)
    chosen = fullest(counts, 40, slack)
    assert sum(chosen) <= 40 and chosen[0] == max(lengths) and (np.bincount(chosen, minlength=41) <= counts).all()
    exact = fullest(counts, 40)
    assert sum(chosen) == sum(exact) or 40 - sum(chosen) <= slack
    total = np.zeros(41, int)
    for bin_, times in combinations(counts, 40, slack):
        total += times * np.bincount(bin_, minlength=41)
    assert (total == counts).all() and 0 in SLACKS
