"""Documents of few citations and of many are searched alike."""

import random

import pytest

from lexquarry.operators import cases
from tests.test_substrings import KIND, brute_force


@pytest.mark.parametrize("few", [0, 5, 14])
@pytest.mark.parametrize("n, both_ways", [(1, False), (3, True)])
def test_substrings_either_way(spark, monkeypatch, few, n, both_ways):
    monkeypatch.setattr(cases, "_FEW", few)
    rng = random.Random(7)
    texts = ["1 U.S. 1", "1 u.s. 1", "11 U.S. 12", "See 11 U.S. 12, at 5", "é", "é é", "", "x" * 60, "x" * 30, "x" * 7]
    rows = [(d, i, rng.choice(texts)) for d in range(20) for i in range(d % 15)]
    got = cases.first_places(spark.createDataFrame([*rows, (None, 1, "a"), (None, 2, "a"), (3, 99, None)], KIND).repartition(3), n, both_ways)
    assert sorted((r["doc_id"], r["i"], list(r["js"])) for r in got.collect()) == brute_force(rows, n, both_ways)


@pytest.mark.parametrize("few", [0, 9])
def test_a_place_of_two_rows(spark, monkeypatch, few):
    """Each pair of rows counts, as in SQL."""
    monkeypatch.setattr(cases, "_FEW", few)
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "ab"), (1, 3, "a")], KIND)
    assert sorted((r["i"], list(r["js"])) for r in cases.first_places(rows, 3, False).collect()) == [(1, [2, 2, 3]), (3, [1, 1, 2])]
