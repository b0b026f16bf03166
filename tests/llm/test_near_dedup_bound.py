from math import comb

from lexquarry.llm import near_dedup


def test_long_signatures_pass_pairs_at_the_threshold():
    differ = 0.2 * 15 / 16  # at similarity 0.8, symbols of 4 bits
    n = near_dedup.LONG
    missed = sum(comb(n, k) * differ**k * (1 - differ) ** (n - k) for k in range(near_dedup.LONG_FARTHEST + 1, n + 1))
    assert missed < 1e-8
