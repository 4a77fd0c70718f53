"""The number of simhash tables for the recall that is promised at the radius."""

import math

import pytest

from rankloom.llm import simhash


@pytest.mark.parametrize("n", [10_000, 100_000, 1_000_000, 6_000_000, 30_000_000])
def test_recall_at_the_radius(n):
    bits, tables = simhash.plan(n)
    hit = math.comb(simhash.BITS - simhash.RADIUS, bits) / math.comb(simhash.BITS, bits)  # keys that hold none of the differing bits
    assert 1 - (1 - hit) ** tables >= simhash.RECALL
