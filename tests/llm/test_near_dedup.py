import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import common, near_dedup

KIND = "doc_id long, text string"


def brute_force(docs, words=4):
    """(shingles, smallest id linked) by full sets of all pairs."""
    sets = {}
    for d, t in docs:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def planted(rng, groups, size, low, high):
    """Groups of texts whose pairs with their first text have similarities from low to high, give or take."""
    docs = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for i in range(size):
            own = list(base)
            share = rng.uniform(low, high)
            for _ in range(i and round(150 * (1 - share) / (1 + share) / 4 * rng.uniform(0.9, 1.3))):
                own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    return docs


@pytest.mark.parametrize("few_edges", [10**6, 0])
def test_links_at_the_threshold_equal_brute_force(spark, monkeypatch, few_edges):
    monkeypatch.setattr(common, "FEW_EDGES", few_edges)
    monkeypatch.setattr(near_dedup, "HOT", 3 if few_edges else 2000)
    docs = planted(random.Random(3), 60, 6, 0.78, 0.87)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, KIND), words=4).collect()}
    assert got == brute_force(docs)


def test_templates_in_small_blocks_equal_brute_force(spark, monkeypatch):
    """Texts that share most of a template, so that a key holds many components and is cut into blocks on both sides."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    docs = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.choice([2, 4, 5, 6, 7])):
            own[rng.randrange(120)] = f"own{rng.randrange(12)}"
        docs.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, KIND), words=4).collect()}
    assert got == brute_force(docs)


def test_pairs_within_the_promised_distance_are_candidates(spark):
    """Whatever the long signatures say: these are as far apart as can be."""
    rng = np.random.default_rng(2)
    sigs = rng.integers(0, 256, (40, near_dedup.SIGNATURE), dtype=np.uint8)
    others = sigs.copy()
    for row in others:
        row[rng.choice(near_dedup.SIGNATURE, near_dedup.PROMISED, replace=False)] ^= 1
    rows = [(int(i), int(i), 100, s.tobytes(), bytes(near_dedup.LONG // 2)) for i, s in enumerate(sigs)]
    rows += [(1000 + int(i), 1000 + int(i), 100, s.tobytes(), bytes([255] * (near_dedup.LONG // 2))) for i, s in enumerate(others)]
    nodes = spark.createDataFrame(rows, "node long, comp long, n long, sig binary, long binary")
    keys = near_dedup.index_keys(nodes).selectExpr("node", "explode(keys) AS key").join(nodes.select("node", "comp"), "node")
    got = {(r["key"], r["node"]) for r in near_dedup.candidates(keys, nodes.drop("comp"), 80).collect()}
    by_node = {}
    for key, node in got:
        by_node.setdefault(node, set()).add(key)
    assert all(by_node[i] & by_node[1000 + i] for i in range(40))
    same = nodes.withColumn("hashes", F.lit(np.arange(100, dtype=np.uint64).tobytes()))
    links = {tuple(sorted((r["a"], r["b"]))) for r in near_dedup.linked(keys, same.drop("comp"), 80).collect()}
    assert {(i, 1000 + i) for i in range(40)} <= links


def test_overlaps_equal_intersections():
    rng = np.random.default_rng(7)
    core = np.arange(50, dtype=np.uint64)
    made = [np.unique(np.concatenate([core[rng.random(50) < 0.9], rng.integers(100, 400, rng.integers(1, 60)).astype(np.uint64)])) for _ in range(70)]
    of = near_dedup.Overlaps(made[:40])
    assert (of.counts(made[30:]) == np.array([[len(np.intersect1d(x, y)) for y in made[:40]] for x in made[30:]])).all()
    assert (near_dedup.Overlaps(made[:1]).counts([np.array([10**6], np.uint64)]) == 0).all()


def template_group(n, seed=4):
    """Texts of one template whose pairs are all a little less alike than the threshold."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(200)]
    docs = []
    for i in range(n):
        own = list(base)
        for place in rng.sample(range(200), 6):
            own[place] = f"own{i}x{place}"
        docs.append((i, " ".join(own)))
    return docs


def test_rows_grow_with_the_size_of_a_group(spark, monkeypatch):
    made = {}

    def counted(df, name, keep=near_dedup.materialize):
        out = keep(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    for n in (60, 120):
        made[n] = {}
        docs = template_group(n)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, KIND), words=4).collect()}
        assert got == brute_force(docs)
        made[n] = {k: made.pop(k) for k in [k for k in made if isinstance(k, str)]}
    for name in ("close", "links", "star", "sets"):
        assert made[120][name] <= 3 * max(made[60][name], 60), name


def test_short_distances():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 3, (5, near_dedup.SIGNATURE), dtype=np.uint8), rng.integers(0, 3, (7, near_dedup.SIGNATURE), dtype=np.uint8)
    assert (near_dedup.short_distances(x, y) == (x[:, None] != y[None]).sum(-1)).all()


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "é ñ 中 😀\nx"), (6, "the cat sat on the mat " * 4000), (6, "a"), (None, "b c"), (None, "a"), (9, "A")]
    df = spark.createDataFrame(docs, KIND).selectExpr("*", "'k' AS key", "'n' AS node", "1 AS comp", "2 AS doc", "3 AS n", "4 AS sig")
    rows = near_dedup.near_duplicates(df, words=4).collect()
    assert len(rows) == len(docs)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (9, 1, 4), (6, 1, 4), (6, 6, 6), (5, 2, 5)} <= got
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
