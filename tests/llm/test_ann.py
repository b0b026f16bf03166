import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexquarry.llm import ann

KIND = "vec_id long, embedding array<float>"


def brute_force(rows, k=20, every=20):
    """(query, rank) -> (id, score) over rows of one length with different ids."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        some = np.flatnonzero(ids != ids[q])
        for rank, j in enumerate(some[np.lexsort((ids[some], -score[some]))][:k], 1):
            out[int(ids[q]), rank] = (int(ids[j]), float(score[j]))
    return out


def found(df):
    rows = ann.nearest(df).collect()
    assert len({(r["query_id"], r["rank"]) for r in rows}) == len(rows)
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows}


def same(got, want):
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def recall(got, want):
    own = {}
    for (q, _), (i, _) in got.items():
        own.setdefault(q, set()).add(i)
    return np.mean([i in own.get(q, ()) for (q, _), (i, _) in want.items()])


def vectors(n, dims, seed=1):
    return np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)


def test_ties_go_to_smaller_ids(spark):
    x = vectors(360, 8)
    x[100:200] = x[100]
    rows = [(i * 3 - 60, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, KIND).repartition(5).selectExpr("*", "'a' AS id", "'b' AS v", "1 AS h", "2 AS block", "3 AS part", "4 AS rank")
    same(found(df), brute_force(rows))


def test_odd_vectors_and_repeated_rows(spark):
    x = vectors(80, 6)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(None, [1.0] * 6), (1020, None), (1040, [0.0] * 6), (1060, [float("nan")] * 6), (1080, [float("inf")] * 6), (1100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1120, [])]
    same(found(spark.createDataFrame(rows + odd + rows[:30], KIND)), brute_force(rows))


def test_every_length_is_searched(spark):
    short, long = [(i, v.tolist()) for i, v in enumerate(vectors(60, 3))], [(100 + i, v.tolist()) for i, v in enumerate(vectors(41, 9))]
    same(found(spark.createDataFrame(short + long, KIND)), brute_force(short) | brute_force(long))


def test_doubles_stay_doubles(spark):
    x = np.random.default_rng(3).normal(size=(70, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    same(found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), brute_force(rows))


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [-1.0, 0.5])]
    same(found(spark.createDataFrame(rows, KIND)), brute_force(rows))
    assert ann.nearest(spark.createDataFrame([], KIND)).count() == 0
    assert ann.nearest(spark.createDataFrame([(3, [1.0])], KIND)).count() == 0


def test_recall_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 1500)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(6000, 32))]
    assert recall(found(spark.createDataFrame(rows, KIND)), brute_force(rows)) >= 0.9


@pytest.mark.parametrize("dims", [64])
def test_codes_keep_large_products(dims):
    """Recall of the scan alone at 100,000 vectors without structure, the hardest case: 200 queries."""
    x = vectors(100_000, dims)
    quantiser = ann.Quantiser(x[: ann.FIT_ROWS].astype(float))
    codes = np.concatenate([quantiser.encode(x[i : i + 20_000].astype(float)) for i in range(0, len(x), 20_000)])
    hit = 0
    for q, (place, _) in enumerate(ann.scan_block(quantiser, np.arange(len(x)), codes, x[:200].astype(float), ann.RERANK)):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & set(place))
    assert hit / 4000 >= 0.9


def clustered(n, clusters, dims=64, spread=0.3, seed=5):
    """Unit vectors around centres, close together."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("n, clusters, spread, every", [(20_000, 20, 0.05, 200), (50_000, 20, 0.2, 500), (100_000, 200, 0.3, 1000)])
def test_recall_in_clusters(spark, tmp_path, n, clusters, spread, every):
    x = clustered(n, clusters, spread=spread)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": lists}), f"{tmp_path}/x.parquet")
    rows = ann.nearest(spark.read.parquet(f"{tmp_path}/x.parquet").repartition(4), every=every).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows}
    assert len(got) == 20 * (n // every) and recall(got, brute_force(list(zip(range(n), x)), every=every)) >= 0.9


def odd(kind, n, dims, rng):
    """Vectors whose codes alone do not tell the nearest."""
    x = rng.normal(size=(n, dims))
    if kind == "tight":
        return clustered(n, 5, dims, 1e-4).astype(float)
    if kind == "near copies":
        return clustered(n, 1, dims, 1e-3).astype(float)
    if kind == "many tight":
        return rng.normal(size=(n // 25, dims))[rng.integers(n // 25, size=n)] + 1e-3 * x
    if kind == "lognormal lengths":
        return clustered(n, n, dims) * np.exp(x[:, :1])
    if kind == "heavy lengths":
        return clustered(n, n, dims) * (rng.pareto(1, size=(n, 1)) + 0.1)
    if kind == "signs":
        return np.sign(x)
    if kind == "one outlier":
        return np.where(np.arange(n)[:, None] == 7, 1e6 * x, 1e-3 * x)
    assert kind == "large and small"
    return x * 10.0 ** rng.integers(-150, 150, size=(n, 1))


KINDS = ["tight", "near copies", "many tight", "lognormal lengths", "heavy lengths", "signs", "one outlier", "large and small"]


@pytest.mark.parametrize("kind", KINDS)
def test_no_neighbour_is_missed(spark, tmp_path, kind):
    n, dims, every = 20_000, 48, 400
    x = odd(kind, n, dims, np.random.default_rng(9))
    x = x if kind == "large and small" else x.astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims), pa.int32()), pa.array(x.reshape(-1)))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": lists}), f"{tmp_path}/x.parquet")
    rows = ann.nearest(spark.read.parquet(f"{tmp_path}/x.parquet").repartition(4), every=every).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows}
    want = brute_force(list(zip(range(n), x)), every=every)
    assert {key: v[0] for key, v in got.items()} == {key: v[0] for key, v in want.items()}
    assert all(np.isclose(got[key][1], want[key][1], rtol=1e-9, atol=0) for key in want)


def test_blocks_of_either_side_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 700)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    x = clustered(3000, 4, 16, 1e-3)
    x[500:1500] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    same(found(spark.createDataFrame(rows + rows[480:540] * 5, KIND)), brute_force(rows))


def test_products_that_vanish_are_ties(spark):
    x = np.random.default_rng(4).normal(size=(1200, 6)) * 1e-170
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    same(found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), brute_force(rows))


def test_bounds_hold_and_leave_few():
    """Every product is within its bound, and of structureless vectors few are scored beyond the best of the scan."""
    for kind in KINDS[:-1]:
        x = odd(kind, 6000, 33, np.random.default_rng(2))
        quantiser = ann.Quantiser(x[:4000])
        codes = quantiser.encode(x)
        unit = x[:40] / np.sqrt((x[:40] ** 2).sum(1, keepdims=True))
        _, _, off, length, margin = ann.numbers_of(codes)
        for q, (_, guess) in zip(unit, ann.scan_block(quantiser, np.arange(len(x)), codes, unit, 30)):
            product = x @ q / quantiser.scale
            assert (np.abs(product - guess) <= margin + off).all()
            for least in np.quantile(product, [0.2, 0.9, 0.999]):
                assert np.isin(np.flatnonzero(product >= least), ann.within(guess, off, length, margin, least)).all()
    x = vectors(20_000, 64).astype(float)
    quantiser = ann.Quantiser(x[: ann.FIT_ROWS])
    found = ann.nearest_in_block(quantiser, np.arange(len(x)), quantiser.encode(x), x, np.arange(50), x[:50], 20, 100)
    assert np.mean([scored for _, _, scored in found]) < 1000
