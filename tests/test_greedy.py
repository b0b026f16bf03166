import random

import pytest
from pyspark.sql import functions as F

from lexquarry.operators.greedy import Leaders, greedy_groups, lead

KIND = "doc_id long, ord int, name string"


def alike(a, b):
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.8
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y)


def brute_force(rows, threshold=0.7):
    out, leaders = [], {}
    for doc, place, name in sorted(rows):
        if not name or name == "unknown case":
            out.append((doc, place, place))
            continue
        own = leaders.setdefault(doc, [])
        hit = next((p for p, n in own if alike(n, name) >= threshold), None)
        if hit is None:
            own.append((place, name))
        out.append((doc, place, place if hit is None else hit))
    return sorted(out)


def names(rng, n):
    words = ["smith", "jones", "state", "united", "co", "a", "v", "bank", "of", "the", "ab", "abc", "é", "x y"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) or rng.choice([None, "", "unknown case"]) for _ in range(n)]


@pytest.mark.parametrize("few", [0, 1, 5, 24])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 0.81, 1.0])
def test_leaders_equal_brute_force(threshold, few):
    rng = random.Random(9)
    rows = [(doc, i, n or "") for doc in range(30) for i, n in enumerate(names(rng, 60))]
    assert [tuple(r) for r in lead(iter(rows), threshold, few)] == brute_force(rows, threshold)


@pytest.mark.parametrize("threshold", [0.7, 0.81])
def test_equals_brute_force(spark, threshold):
    rng = random.Random(8)
    rows = [(doc, i, n) for doc in range(12) for i, n in enumerate(names(rng, 60))] + [(99, i, c) for i, c in enumerate(["ab", "a", "b", "cab", "abcd", "b a", "c"])]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert sorted(tuple(r) for r in greedy_groups(df, threshold).collect()) == [tuple(r) for r in brute_force([(d, i, n or "") for d, i, n in rows], threshold)]


def test_names_without_spaces_hold_one_another():
    rng = random.Random(4)
    own = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    distinct = list(dict.fromkeys(own))
    got = [p for _, _, p in lead(((1, i, n) for i, n in enumerate(distinct)), 0.7)]
    assert got == [p for _, _, p in brute_force([(1, i, n) for i, n in enumerate(distinct)])]


def test_a_document_of_200_000_citations(spark):
    """Most names are their own leaders; comparing each with all would take 10^10 comparisons."""
    n = 200_000
    name = F.concat(F.lit("plaintiff "), F.sha2((F.col("id") % 150_000).cast("string"), 256).substr(1, 8), F.lit(" against defendant "), F.sha2((F.col("id") % 150_000 + 1_000_000).cast("string"), 256).substr(1, 8))
    df = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("ord"), name.alias("name"))
    got = greedy_groups(df).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("leader").alias("leaders"), F.count_if(F.col("leader") != F.col("ord") % 150_000).alias("bad")).first()
    assert (got["n"], got["leaders"], got["bad"]) == (n, 150_000, 0)


def test_bounds_and_empty_tables(spark):
    assert greedy_groups(spark.createDataFrame([], KIND)).count() == 0
    with pytest.raises(ValueError):
        greedy_groups(spark.createDataFrame([], KIND), 0)
    assert Leaders(0.7).first("a", frozenset("a")) is None
