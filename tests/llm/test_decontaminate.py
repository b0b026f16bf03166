import random
import re
import time

import numpy as np
import pytest

from lexquarry.llm import decontaminate

KIND = "doc_id long, text string"
ITEM = "Which of the following rivers flows through the largest number of capitals?"


def fewest_edits(pattern: bytes, text: bytes) -> int:
    """Edits of the pattern's best place in the text, by the full table."""
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    data = np.frombuffer(text, np.uint8)
    for byte in pattern:
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (data != byte))
        row = np.minimum.accumulate(best - step) + step
    return int(row.min())


def edited(rng, text: bytes, n: int, letters: bytes) -> bytes:
    out = bytearray(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(letters)
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice(letters))
    return bytes(out)


@pytest.mark.parametrize("letters", [b"abcdefghijklmnop ", b"ab"])
def test_edits_equal_the_full_table(letters):
    rng = random.Random(5)
    for trial in range(60):
        n = rng.choice([32, 40, 80, 300, 700])
        item = bytes(rng.choice(letters) for _ in range(n)).strip().replace(b"  ", b"a ")
        index = decontaminate.Index([(1, item)])
        own = index.grams[0]
        item, k = own.texts[0], int(own.edits[0])
        said = edited(rng, item, rng.randint(0, k + 3), letters.strip())
        text = bytes(rng.choice(letters) for _ in range(rng.randint(0, 200))) + said + bytes(rng.choice(letters) for _ in range(rng.randint(0, 200)))
        data, ptr, _ = decontaminate.normalise(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        want = fewest_edits(item, data.tobytes())
        found = index.search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert bool(found) == (want <= k), (trial, want, k)
        if found:
            _, _, start, end, edits = found[0]
            own = text[start:end]
            own = decontaminate.normalise(np.frombuffer(own, np.uint8), np.array([0, len(own)]))[0].tobytes()
            assert edits == want and fewest_edits(item, own) <= want + 1  # a blank at the span's edge is not part of it


@pytest.mark.parametrize("size", [9_000, 20_000, 55_000])
def test_long_items(size):
    rng = random.Random(size)
    item = bytes(rng.choice(b"abcdefghij klmnop") for _ in range(size)).replace(b"  ", b"a ").strip()
    text = b"x" * 61 + item[: size // 3] + item[size // 3 + 3 :] + b"yyy"
    began = time.time()
    found = decontaminate.Index([(1, item)]).search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [(x[2], x[4]) for x in found] == [(61, 3)] and found[0][3] == len(text) - 3
    assert time.time() - began < 5


def test_repeated_grams_stay_bounded(monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", 1000)
    item, text = b"ab" * 60, b"z " + b"ab" * 3000
    found = decontaminate.Index([(1, item)]).search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [x[4] for x in found] == [0]


@pytest.mark.parametrize("share, least", [(0.02, 1.0), (0.05, 0.95), (0.08, 0.5), (0.12, 0.0)])
def test_recall_by_share_of_edits(share, least):
    """The budget is 8 % of an item's bytes: all within it are found, none beyond it that needs more."""
    rng = random.Random(9)
    letters = b"abcdefghijklmnopqrstuvwxyz"
    caught = 0
    for i in range(100):
        item = b" ".join(bytes(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(30))
        text = b"before " + edited(rng, item, int(len(item) * share), letters) + b" after"
        index = decontaminate.Index([(1, item)])
        found = index.search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        caught += bool(found)
        assert bool(found) == (fewest_edits(item, text) <= index.grams[0].edits[0])
    assert caught >= least * 100


def test_tiny_items_as_words(spark):
    docs = [(1, "say Tiny  item, now"), (2, "say tiny items"), (3, "(tiny item)"), (4, None), (5, "atiny item"), (6, "'Tiny Item'."), (7, "tiny itemé")]
    benchmark = spark.createDataFrame([(7, "tiny\nitem"), (8, None), (9, ""), (10, " \n ")], "item_id long, text string")
    rows = decontaminate.leaks(spark.createDataFrame(docs, KIND), benchmark).collect()
    assert {(r["doc_id"], r["item_id"], r["start"], r["end"], r["edits"]) for r in rows} == {(1, 7, 4, 14, 0), (3, 7, 1, 10, 0), (6, 7, 1, 10, 0)}


def test_short_items_with_edits_and_signs():
    item = b"the capital of new zealand is"[:28]
    said = [item + b" now", item.replace(b"new", b"nw") + b" now", b'"' + item + b'"', item + b".", item + b", so", b"(" + item + b")", item.replace(b"new", b"old"), b"nothing of the kind in here, is it"]
    index = decontaminate.Index([(1, item)])
    got = [[x[4] for x in index.search(np.frombuffer(t, np.uint8), np.array([0, len(t)]))] for t in said]
    assert got == [[0], [1], [0], [0], [0], [0], [], []]


@pytest.mark.parametrize("letters", [b"abcdefghijklmnop ", b"ab"])
def test_items_of_8_to_60_bytes_equal_the_full_table(letters):
    rng = random.Random(11)
    for _ in range(300):
        item = (bytes(rng.choice(letters) for _ in range(rng.randint(8, 60))).strip() or b"abcdefgh").replace(b"  ", b"a ")
        said = edited(rng, item, rng.randint(0, 5), letters.strip()).strip()
        before, after = (bytes(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in "ab")
        text = before + rng.choice([b" ", b". ", b"(", b'"']) + said + rng.choice([b" ", b".", b",", b")"]) + after
        data = decontaminate.normalise(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tobytes()
        index = decontaminate.Index([(1, item)])
        found = index.search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        if index.tiny is None:
            want = fewest_edits(item, data)
            assert [x[4] for x in found] == ([want] if want <= index.grams[0].edits[0] else [])
        else:
            assert len(item) < 13 and bool(found) == bool(re.search(rb"(?<![0-9a-zA-Z\x80-\xff])" + re.escape(item) + rb"(?![0-9a-zA-Z\x80-\xff])", data))


@pytest.mark.parametrize("edits", [0, 300])
def test_periodic_items(edits):
    rng = random.Random(3)
    item = b"abcde fghij " * 500
    text = edited(rng, item * 10, edits, b"abcdefghij")
    began = time.time()
    found = decontaminate.Index([(1, item)]).search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(found) == 1 and time.time() - began < 4


def test_leaks_of_odd_tables(spark, monkeypatch):
    docs = [(1, "before " + ITEM.upper().replace(" ", "\n") + " after"), (2, "Which of the following has nothing to do with it at all, rivers or not"), (3, None), (4, ITEM.replace("rivers", "rivvers")), (4, ITEM), (5, ""), (None, ITEM)]
    df = spark.createDataFrame(docs, KIND).selectExpr("*", "1 AS id", "2 AS item_id", "3 AS start")
    benchmark = spark.createDataFrame([(7, ITEM), (8, None), (11, ITEM), (None, ITEM)], "item_id long, text string").selectExpr("*", "1 AS item", "2 AS doc_id")
    want = {(d, i, e) for i in (7, 11) for d, e in ((1, 0), (4, 1), (4, 0), (None, 0))}
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(df, benchmark).collect()} == want
    assert decontaminate.leaks(df, benchmark.limit(0)).count() == 0
    assert decontaminate.leaks(df.limit(0), benchmark).count() == 0
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(df, benchmark).collect()} == want


def test_a_very_long_text(spark):
    text = "some words of filling " * 100_000
    df = spark.createDataFrame([(1, text + ITEM), (2, text)], KIND)
    benchmark = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [(r["doc_id"], r["start"]) for r in decontaminate.leaks(df, benchmark).collect()] == [(1, len(text))]
