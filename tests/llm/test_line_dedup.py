import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from lexquarry.llm import line_dedup

KIND = "doc_id long, text string"
BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute_force(docs, min_docs, keep_first):
    """(id, lines, dropped, text that stays) of every row."""
    seen = defaultdict(set)
    for d, t in docs:
        for pos, line in enumerate((t or "").split("\n")):
            if key_of(line):
                seen[key_of(line)].add((d is not None, d or 0, t or "", pos))
    common = {k for k, v in seen.items() if len({x[:3] for x in v}) >= min_docs}
    first = {k: min(v) for k, v in seen.items()}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        stays = [line for pos, line in enumerate(lines) if key_of(line) not in common or (keep_first and first[key_of(line)] == (d is not None, d or 0, t or "", pos))]
        out.append((d, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


def digests(rows):
    return sorted((str(d), n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in rows)


def random_docs():
    rng = random.Random(7)
    lines = [f"line {i}" for i in range(40)] + ["", "  ", "\tShared Line ", "shared line", "ÄÖ line", "x" * 5000]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    docs += [(50, "unique B0\nline 1"), (50, "line 1\nunique B1"), (None, "no id\nline 2"), (None, "line 2\nno id either"), (70, None), (71, ""), (72, "the same\nline 3"), (72, "the same\nline 3")]
    return docs


@pytest.mark.parametrize("parts", [1, 7])
def test_digests_equal_brute_force(spark, parts):
    docs = random_docs()
    df = spark.createDataFrame(docs, KIND).repartition(parts).selectExpr("*", "'a' AS doc", "'b' AS tie", "'c' AS bitmap", "'d' AS id")
    got = [(str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.kept_digest(df, min_docs=10).collect()]
    assert sorted(got) == digests(brute_force(docs, 10, False))


def test_a_shuffle_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    docs = random_docs()
    got = [(str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.kept_digest(spark.createDataFrame(docs, KIND), min_docs=10).collect()]
    assert sorted(got) == digests(brute_force(docs, 10, False))


def test_first_occurrences_stay(spark):
    docs = [(i, t) for i, (_, t) in enumerate(random_docs()) if t]
    want = {d: t for d, _, _, t in brute_force(docs, 10, True)}
    assert {r["doc_id"]: r["text"] for r in line_dedup.kept_texts(spark.createDataFrame(docs, KIND), min_docs=10, keep_first=True).collect()} == want


def test_bitmaps_hold_every_line(spark):
    docs = random_docs()
    rows = line_dedup.line_bitmaps(spark.createDataFrame(docs, KIND), min_docs=10).collect()
    assert len(rows) == len(docs)
    texts = {(d, t) for d, t in docs}
    for d, t in texts:
        own = [r for r in rows if r["doc_id"] == d and r["n_lines"] == (t or "").count("\n") + 1]
        stays = [x[3] for x in brute_force(docs, 10, False) if x[0] == d]
        assert any(line_dedup.apply_bitmap(t or "", bytes(r["bitmap"])) in stays for r in own)


def test_empty_table(spark):
    none = spark.createDataFrame([], KIND)
    assert line_dedup.kept_digest(none).count() == line_dedup.line_bitmaps(none).count() == line_dedup.kept_texts(none).count() == 0


def test_a_line_in_every_document_spreads_over_partitions(spark):
    docs = [(i, "all of them\nsome" if i % 3 else "all of them") for i in range(4000)]
    df = spark.createDataFrame(docs, KIND)
    keyed = line_dedup.keyed(df, "doc_id", "text").select("doc", "tie", "text")
    rows = line_dedup.line_rows(keyed).repartitionByRange(6, "h", "g", "doc", "tie").sortWithinPartitions("h", "g", "doc", "tie", "pos")
    runs = line_dedup.stream_runs(rows, 10, False).groupBy("state").count().collect()
    assert sum(r["count"] for r in runs) == 4000 + sum(i % 3 > 0 for i in range(4000))
    assert {r["n_dropped"] for r in line_dedup.kept_digest(df).collect()} == {1, 2}


def test_keep_bitmap_round_trip():
    text = "\n".join(str(i) for i in range(20))
    assert line_dedup.apply_bitmap(text, line_dedup.keep_bitmap(20, np.arange(0, 20, 2))) == "\n".join(str(i) for i in range(1, 20, 2))
