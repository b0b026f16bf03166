import random

import pytest
from pyspark.sql import functions as F

from lexquarry.operators.cases import first_places

KIND = "doc_id long, ord int, citation string"


def brute_force(rows, n, both_ways):
    out = []
    for d, i, x in rows:
        held = [j for e, j, y in rows if e == d and i != j and (x.lower() in y.lower() or (both_ways and y.lower() in x.lower()))]
        if held:
            out.append((d, i, sorted(held)[:n]))
    return sorted(out)


@pytest.mark.parametrize("n, both_ways", [(1, False), (3, True), (2, False)])
def test_equals_brute_force(spark, n, both_ways):
    rng = random.Random(6)
    texts = ["1 U.S. 1", "1 u.s. 1", "11 U.S. 12", "See 11 U.S. 12, at 5", "é", "é é", "", "a long citation that goes on well beyond what is looked up", "goes on well beyond what is looked up", "x" * 60, "x" * 30, "x" * 7]
    rows = [(d, i, rng.choice(texts)) for d in range(20) for i in range(14)]
    got = first_places(spark.createDataFrame(rows, KIND).repartition(3), n, both_ways)
    assert sorted((r["doc_id"], r["i"], list(r["js"])) for r in got.collect()) == brute_force([r for r in rows if r[2] is not None], n, both_ways)


def test_a_document_of_100_000_citations(spark):
    """Every tenth citation is held by another one; comparing each with all would take 10^10 comparisons."""
    n = 100_000
    cite = F.concat(F.lit("10"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" F. Supp. 2d "), F.lpad((F.col("id") * 7).cast("string"), 6, "0"))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("ord"), F.when(F.col("id") % 10 == 1, F.concat(F.lit("see "), F.concat(F.lit("10"), F.lpad((F.col("id") - 1).cast("string"), 6, "0"), F.lit(" F. Supp. 2d "), F.lpad(((F.col("id") - 1) * 7).cast("string"), 6, "0")))).otherwise(cite).alias("citation"))
    got = first_places(rows, 1, False).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("js")[0] != F.col("i") + 1) | (F.col("i") % 10 != 0)).alias("bad")).first()
    assert (got["n"], got["bad"]) == (n // 10, 0)
