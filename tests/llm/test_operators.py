import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from lexquarry.llm import bpe, near_dedup, pieces
from lexquarry.llm.common import components, utf8_buffer

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "é ñ 中 😀\nx"), (6, "the cat sat on the mat " * 400), (6, "a"), (None, "b c")]
KIND = "doc_id long, text string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, KIND).selectExpr("*", "'k' AS key", "'n' AS node", "1 AS shard")


def test_split_is_the_pattern():
    rng = random.Random(1)
    signs = ["a", "é", "'", "s", "re", "'s", "'ll", " ", "  ", "\n", "\t", "1", "²", "-", "x", "中", "\x1c", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    joined, points, ptr = pieces.code_points(texts)
    starts = pieces.split(points, ptr)
    got = [joined[a:b] for a, b in zip(starts, np.append(starts[1:], len(points)))]
    assert got == [m for t in texts for m in regex.findall(public_tokenizers.PATTERN, t)]


def test_bpe_equals_tiktoken(spark, odd):
    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(((r["doc_id"] or 0, r["ids"], bytes(r["decoded"])) for r in bpe.encode(odd).collect()), key=str)
    assert got == sorted(((d or 0, other.encode_ordinary(t or ""), (t or "").encode()) for d, t in ODD), key=str)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 9), (9, 12), (20, 20)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 12: 1, 10: 10, 11: 10}


def test_words_follow_the_rule():
    text = "A\x0bb c  D\r\n" * 3
    data, ptr = utf8_buffer(pa.array([text, "", None]))
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    sets = near_dedup.shingle_sets(data, ptr, 4)
    assert len(sets[0]) == len({tuple(words[i : i + 4]) for i in range(len(words) - 3)}) and not len(sets[1]) and not len(sets[2])
