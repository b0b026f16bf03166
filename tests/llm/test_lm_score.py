import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexquarry.llm import lm_score
from lexquarry.llm.common import utf8_buffer

KIND = "doc_id long, text string"


def hash_of(word):
    words, _ = lm_score.tokens(*utf8_buffer(pa.array([word])))
    return int(words[0])


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def brute_force(network, docs, own_counts):
    """(tokens, alone, summed log-probability) of every text, word by word in plain Python."""
    v, p = network.vocabulary, {k: x.astype(float) for k, x in network.p.items()}
    head = {int(w): int(leaf) for w, leaf in zip(v.words, v.leaf_of)}
    totals = Counter(w for _, t in docs for w in (t or "").lower().split())
    out = []
    for _, text in docs:
        words = (text or "").lower().split()
        held = Counter(words)
        leaves = [head.get(h, v.n_head + (h >> 40) % lm_score.TAILS) for h in map(hash_of, words)]
        total, alone = 0.0, 0
        for i, word in enumerate(words):
            x = p["h"].copy()
            for j, shift in enumerate((-2, -1, 1, 2)):
                at = i + shift
                x += p["e"][leaves[at] if 0 <= at < len(words) else v.leaves] * p["s"][j]
            x = np.tanh(x)
            leaf = leaves[i]
            for k in range(v.first[leaf], v.first[leaf] + v.depth[leaf]):
                total += math.log(sigmoid(v.turn[k] * (x @ p["w"][:, v.path[k]] + p["b"][v.path[k]])))
            if leaf >= v.n_head:
                own = held[word] if own_counts else 0
                tail = leaf - v.n_head
                total += math.log((totals[word] - own + lm_score.SMOOTH) / (v.tail_mass[tail] - own + lm_score.SMOOTH * (v.tail_types[tail] + 1)))
                alone += totals[word] - own <= 0
        out.append((len(words), alone, total))
    return out


def some_docs():
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"] + [f"rare{rng.randrange(40)}"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    return [*docs, (100, None), (101, ""), (102, " \n\t"), (103, "Unheard of"), (104, "Unheard of"), (105, "never said before"), (None, "the cat"), (3, "the mat")]


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_sums_equal_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    monkeypatch.setattr(lm_score, "TAILS", 4)
    docs = some_docs()
    df = spark.createDataFrame(docs, KIND)
    grouped = lm_score.grouped(df.selectExpr("doc_id AS id", "text"))
    words = lm_score.block_words(grouped)
    model = lm_score.count(words)
    assert model.vocabulary.n_head == min(head, len({w for _, t in docs for w in (t or "").lower().split()}))
    network = lm_score.train(grouped, model.vocabulary)
    rows = lm_score.score_blocks(grouped, lm_score.rarer(words, model), network, True).collect()
    want = sorted((str(d), n, a, pytest.approx(s, abs=1e-3)) for (d, _), (n, a, s) in zip(docs, brute_force(network, docs, True)))
    assert sorted((str(r["id"]), r["n_tokens"], r["n_alone"], r["sum_logp"]) for r in rows) == want


def test_turns_make_a_distribution():
    """The probabilities of all leaves in one place of a text sum to one."""
    rng = np.random.default_rng(1)
    v = lm_score.Vocabulary(rng.integers(1, 2**62, 50).astype(np.uint64), rng.integers(1, 1000, 50 + lm_score.TAILS), rng.integers(1, 9, lm_score.TAILS))
    network = lm_score.Window(v)
    network.p["w"] += rng.normal(size=network.p["w"].shape).astype(np.float32)
    context = np.tile(np.array([[1, 7, v.leaves, 3]]), (v.leaves, 1))
    assert np.exp(network.log_probabilities(np.arange(v.leaves), context)).sum() == pytest.approx(1, abs=1e-4)


def test_learning_goes_down_the_slope():
    """One step moves the loss as the slope, found by differences, says."""
    rng = np.random.default_rng(2)
    v = lm_score.Vocabulary(rng.integers(1, 2**62, 20).astype(np.uint64), rng.integers(1, 100, 20 + lm_score.TAILS), rng.integers(1, 9, lm_score.TAILS))
    network = lm_score.Window(v)
    network.p = {k: x + rng.normal(0, 0.3, x.shape).astype(np.float32) for k, x in network.p.items()}
    leaves, context = rng.integers(0, v.leaves, 300), rng.integers(0, v.leaves + 1, (300, 4))
    before = {k: x.copy() for k, x in network.p.items()}
    steps = {}
    network._step = lambda name, at, grad: steps.setdefault(name, (at, grad))
    network.learn(leaves, context)

    def loss(**changed):
        network.p = before | changed
        return -network.log_probabilities(leaves, context).mean()

    for name in ("w", "b", "h", "s", "e"):
        at, grad = steps[name]
        for _ in range(4):
            slope = np.zeros(before[name].shape)
            slope[at] = grad.T if name == "w" else grad
            move = np.zeros(before[name].shape, np.float32)
            spots = rng.integers(0, move.size, max(1, move.size // 3))
            move.reshape(-1)[spots] = rng.normal(size=len(spots)) * 1e-2
            change = loss(**{name: before[name] + move}) - loss(**{name: before[name] - move})
            assert change == pytest.approx(2 * float((slope * move).sum()), rel=0.05, abs=2e-5)


def test_words_of_a_common_bucket_keep_their_own_counts(spark):
    docs = [(i, " ".join(["the"] * 500 + [f"rare{i}x{j}" for j in range(2000)])) for i in range(100)]
    model = lm_score.count(lm_score.block_words(lm_score.grouped(spark.createDataFrame(docs, KIND).selectExpr("doc_id AS id", "text"))))
    counts = {r["total"]: r["count"] for r in model.totals.groupBy("total").count().collect()}
    assert counts == {50_000: 1, 1: 200_000}


def test_words_of_like_frequency_depend_on_their_neighbours(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice([f"left{k} right{k}" for k in range(300)]) for _ in range(3000))) for i in range(20)]
    model = lm_score.fit(spark.createDataFrame(docs, KIND).coalesce(1))
    pairs = [("left7 right7 " * 20, "left7 right8 " * 20), ("left9 right9 " * 20, "left9 right200 " * 20)]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], KIND)
    got = [r["mean_logp"] for r in lm_score.score(texts, model).orderBy("doc_id").collect()]
    assert got[0] > got[1] + 0.5 and got[2] > got[3] + 0.5


def test_better_than_unigrams_and_bigrams_on_held_out_texts(spark):
    """Words that both neighbours decide: the first of a triple names a set, the last one the word of it."""
    rng = random.Random(6)

    def text(n):
        return " ".join(f"a{i} m{i * 20 + j} z{j} s{rng.randrange(30)}" for i, j in ((rng.randrange(20), rng.randrange(20)) for _ in range(n)))

    train, held_out = [(i, text(400)) for i in range(150)], [(i, text(100)) for i in range(20)]
    model = lm_score.fit(spark.createDataFrame(train, KIND).coalesce(1))
    rows = lm_score.score(spark.createDataFrame(held_out, KIND), model).collect()
    network = sum(r["sum_logp"] for r in rows) / sum(r["n_tokens"] for r in rows)
    words = [t.split() for _, t in train]
    one, two = Counter(w for t in words for w in t), Counter(p for t in words for p in zip(t, t[1:]))
    n = sum(one.values())
    unigram, bigram, count = 0.0, 0.0, 0
    for _, t in held_out:
        own = t.split()
        for i, w in enumerate(own):
            p = (one[w] + 0.5) / (n + 0.5 * len(one))
            unigram += math.log(p)
            bigram += math.log(max(0.2 * p + 0.8 * two[own[i - 1], w] / one[own[i - 1]] if i else p, 1e-12))
            count += 1
    assert network > bigram / count + 0.2 and network > unigram / count + 1


def test_copies_hold_no_word_alone(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(f"own{i}x{j}" if j % 10 == 0 else rng.choice(["the", "of", "and", "to"]) for j in range(100))) for i in range(50)]
    docs.append((50, docs[7][1]))
    got = {r["doc_id"]: (r["n_alone"], r["mean_logp"]) for r in lm_score.pseudo_likelihood(spark.createDataFrame(docs, KIND)).collect()}
    assert {d for d, (alone, _) in got.items() if alone == 0} >= {7, 50} if lm_score.HEAD < 500 else True
    assert len(got) == 51


def test_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "WORDS_AT_ONCE", 5)
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "é ñ 中 😀\nx"), (6, "the cat sat on the mat " * 40_000), (6, "a"), (None, "b c")], KIND).selectExpr("*", "'k' AS word", "'b' AS block", "1 AS total", "2 AS id")
    rows = {(r["doc_id"], r["n_tokens"]): r["mean_logp"] for r in lm_score.pseudo_likelihood(df).collect()}
    assert rows[1, 0] is None and rows[2, 0] is None and rows[3, 0] is None and rows[4, 1] < 0 and rows[6, 240_000] < 0
    assert lm_score.pseudo_likelihood(df.limit(0)).count() == 0
