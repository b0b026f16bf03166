import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexquarry.llm import quality
from lexquarry.llm.common import utf8_buffer

KIND = "doc_id long, text string"


def test_last_lines_count_whole():
    x = quality.statistics(*utf8_buffer(pa.array(["ab\nac", "ab\nab", "ab\nab\n", "", None, "q"])))
    repeated = x[:, quality.STATISTICS.index("repeated_lines")]
    assert repeated[0] == 0 and repeated[1] == repeated[2] == 0.5 and (x[3:5] == 0).all()


def test_scores_of_held_out_documents(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["foo", "bar", "baz"]) + ("###" if i % 2 and rng.random() < 0.6 else "") for _ in range(30))) for i in range(900)]
    df = spark.createDataFrame([*docs, (1900, None), (1901, ""), (5, docs[5][1]), (None, "x ###")], KIND).selectExpr("*", "1 AS score", "2 AS x", "3 AS id", "4 AS y")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(900)] + [(None, 1), (7, None), (9, 5)], "doc_id long, quality int")
    rows = quality.quality_scores(df, labels).collect()
    assert len(rows) == 904
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(out) > 200 and np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, 5)), rng.integers(0, 2, 400).astype(float)
    forest = quality.grow(x, y)
    bins = forest.bins(x)
    for row in range(0, 400, 37):
        total = forest.base
        for t in range(len(forest.feature)):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + 1 + int(bins[row, forest.feature[t, at]] > forest.cut[t, at])
            total += forest.value[t, at - ((1 << quality.DEPTH) - 1)]
        assert forest.scores(x[row : row + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    df = spark.createDataFrame([(1, "a"), (2, None)], KIND)
    assert {r["score"] for r in quality.quality_scores(df, labels).collect()} == {0.5}
    assert quality.quality_scores(df.limit(0), labels).count() == 0


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 500_000), (2, "b")], KIND)
    assert quality.quality_scores(df, spark.createDataFrame([(2, 1)], "doc_id long, quality int")).count() == 2


def plain_statistics(text):
    data = text.encode()
    if not data:
        return [0.0] * len(quality.STATISTICS)
    n = len(data)
    words = [bytes(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    low = [w.lower() for w in words]  # bytes.lower: A-Z only
    lines = data.split(b"\n")
    lines = lines[:-1] if data.endswith(b"\n") else lines
    letter = [b for b in data if chr(b).isalpha() and b < 128 or b >= 128]
    sign = [b for b in data if 33 <= b < 127 and not chr(b).isalnum()]
    share = [c / n for c in np.unique(list(data), return_counts=True)[1]]
    k = max(1, len(words))

    def of(test):
        return sum(map(test, data)) / n

    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / k, len(letter) / n, of(lambda b: 65 <= b <= 90), of(lambda b: 48 <= b <= 57), of(lambda b: b == 32), of(lambda b: b == 10),
        len(sign) / n, of(lambda b: b >= 128), of(lambda b: b < 9), max([sign.count(b) for b in set(sign)], default=0) / n, -sum(s * np.log(s) for s in share), len(set(low)) / k,
        sum(a == b for a, b in zip(low, low[1:])) / k, sum(2 * sum(65 <= b <= 90 for b in w) > len(w) for w in words) / k, sum(33 <= w[-1] < 127 and not chr(w[-1]).isalnum() for w in words) / k,
        np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), sum(len(w) > 30 for w in words) / k, of(lambda b: b == 58), of(lambda b: b == 124),
    ]


def test_statistics_equal_a_plain_computation():
    rng = random.Random(2)
    signs = ["a", "B", "é", "中", "1", " ", "\n", "\t", ".", ":", "|", "-", "word ", "WORD ", "\x01", "\x0b"]
    texts = ["", "q", "\n", " ", "ab\nab\n", "x" * 40 + " y", "A A a"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    got = quality.statistics(*utf8_buffer(pa.array(texts)))
    np.testing.assert_allclose(got, np.array([plain_statistics(t) for t in texts]), rtol=1e-5, atol=1e-6)
