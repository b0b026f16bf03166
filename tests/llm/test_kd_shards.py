import random
import zlib

import pytest

from lexquarry.llm import kd_shards

KIND = "doc_id long, text string, lang string, source string"


def check(rows, docs, shards=8):
    """Every row once, with its size and sum, slots without gaps; the shards' sizes."""
    own = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == own
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["law"] for r in rows} <= {"bytes"} and {r["grown_shard"] for r in rows} <= {None}
    return [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)]


def test_near_equal_bytes(spark):
    rng = random.Random(2)
    docs = [(i, "x" * rng.randint(0, 4000) if i % 3 else "copy " * 100, "en", f"s{i % 4}") for i in range(900)]
    df = spark.createDataFrame(docs, KIND)
    sizes = check(kd_shards.shard(df, n_shards=8).collect(), [d[:2] for d in docs])
    assert max(sizes) < 1.05 * min(sizes)
    assert kd_shards.shard(df.limit(0)).count() == 0
    leaves = kd_shards.shard(df, n_shards=None, target_bytes=100_000).groupBy("shard").sum("size").collect()
    assert len(leaves) == -(-sum(sizes) // 100_000)


@pytest.mark.parametrize("doc", [7, None])
def test_equal_rows_are_parted(spark, doc):
    docs = [(doc, "the same row", "en", "a")] * 400 + [(1000 + i, "t" * i, "de", None) for i in range(20)]
    sizes = check(kd_shards.shard(spark.createDataFrame(docs, KIND), n_shards=8).collect(), [d[:2] for d in docs])
    assert max(sizes) < 1.1 * min(sizes)


def test_copies_of_different_metadata_stay_together(spark):
    docs = [(i, f"text {i // 3} " * 30, ["en", "de", None][i % 3], f"s{i % 3}") for i in range(900)]
    rows = kd_shards.shard(spark.createDataFrame(docs, KIND), n_shards=8).collect()
    check(rows, [d[:2] for d in docs])
    shards = {}
    for r in rows:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 7  # a cut can part one text's copies


def test_odd_rows_and_clashing_names(spark):
    docs = [(1, None), (2, ""), (3, "é" * 50_000), (3, "b"), (None, "c"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS shard", "'k' AS tie", "2 AS size", "'x' AS own", "'y' AS of", "3 AS d1", "'s' AS source")
    check(kd_shards.shard(df, metadata=("of", "d1")).collect(), docs)
    check(kd_shards.shard(df, metadata=()).collect(), docs)
