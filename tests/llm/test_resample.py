import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexquarry.llm import resample
from lexquarry.llm.common import utf8_buffer

KIND = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NAMES = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text, depth, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + n]) for n in range(1, depth + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


def brute_force(docs, target, depth=2, buckets=10_000, least=20, percent=25, seed=7):
    own = [features(t, depth, buckets) for _, t in docs]
    source, wanted = Counter(b for _, f in own for b in f), Counter(b for t in target for b in features(t, depth, buckets)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in source}
    rows = []
    for (d, _), (n, f) in zip(docs, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def collected(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


TARGET = [("the quick brown fox jumps",), ("ünïcode wörds and 12 numbers",), (None,), ("",)]
ODD = [(None, "no id " * 30), (901, None), (902, ""), (903, " .,;\n\x00"), (904, "A-Z_a.z" * 40), (905, "x" * 30000), (906, "中文 é😀 é " * 25), (907, "same same " * 40), (907, "same same " * 40), (908, "one")]


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["THE", "quick", "brown", "Fox", "é", "12"]
    return [(i, " ".join(rng.choice(words, int(rng.integers(1, 60))))) for i in range(150)] + ODD


@pytest.mark.parametrize("parts", [1, 6])
def test_equals_brute_force(spark, parts):
    docs = texts()
    df = spark.createDataFrame(docs, KIND).repartition(parts).selectExpr("*", "'a' AS weight", "'b' AS id", "1 AS part", "2 AS place")
    target = spark.createDataFrame(TARGET, "text string")
    assert collected(resample.resample(df, target)) == brute_force(docs, [t for t, in TARGET])


def test_longer_features_and_few_buckets(spark):
    docs = texts()
    got = resample.resample(spark.createDataFrame(docs, KIND), spark.createDataFrame(TARGET, "text string"), depth=4, buckets=97, percent=60, min_words=5, seed=11)
    assert collected(got) == brute_force(docs, [t for t, in TARGET], 4, 97, 5, 60, 11)


def test_ties_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(resample, "gumbel", lambda id_, seed: id_ * 0)
    docs = [(i, "the same words again and again " * 5) for i in range(40)]
    got = resample.resample(spark.createDataFrame(docs, KIND).repartition(5), spark.createDataFrame(TARGET, "text string"))
    assert sorted((r["rank"], r["doc_id"]) for r in got.collect() if r["rank"]) == [(i + 1, i) for i in range(10)]


def test_empty_table(spark):
    none = spark.createDataFrame([], KIND)
    assert resample.resample(none, spark.createDataFrame(TARGET, "text string")).collect() == []
    assert {r["rank"] for r in resample.resample(spark.createDataFrame(texts(), KIND), none).collect()} > {None, 1}


def test_runs_are_all_occurrences():
    column = pa.array(["a b a b c", "b", None, "a b"])
    data, starts, upto = resample.words_of(*utf8_buffer(column))
    assert data.tobytes() == b"a b a b c b a b " and upto.tolist() == [0, 5, 6, 6, 8]
    ids = resample.word_ids(data, starts)
    order, common = resample.suffix_runs(ids, np.array([5, 4, 3, 2, 1, 1, 2, 1]), 2)
    pairs = [tuple(ids[i : i + 2]) for i in order]
    assert common.max() == 2 and sum(common == 2) == 2 and len(pairs) == 8
    one, two = resample.bucket_ids(data, starts, upto, 2, 1 << 20)
    assert len({one[0], one[2], one[6]}) == 1 and len({two[0], two[2], two[6]}) == 1 and (two == -1).tolist() == [False] * 4 + [True, True, False, True]
