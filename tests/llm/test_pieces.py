import base64

import numpy as np
import public_tokenizers
import tiktoken

from lexquarry.llm import bpe, pieces

PATH = public_tokenizers.path(bpe.VOCABULARY)


def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def thue_morse(n):
    """A word and its complement: polynomials modulo 2**64 hash both alike."""
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out[:n], out[:n].translate(str.maketrans("ab", "ba"))


def test_thue_morse_words_are_told_apart():
    ranks, cache = bpe.encoder(PATH)
    for n in (1024, 2048, 4096):
        words = thue_morse(n)
        ids, ptr = cache([*words])
        assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [tokenizer().encode_ordinary(w) for w in words]
        data = np.frombuffer("".join(words).encode(), np.uint8)
        a, b = pieces.slice_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b


def test_equal_slices_have_equal_hashes_and_others_not():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 3000)
    starts = rng.integers(0, 2800, 3000)
    ends = starts + rng.choice([0, 1, 2, 7, 8, 9, 40, 48, 49, 56, 57, 200], 3000)
    seen = {}
    for a, b, h in zip(starts, ends, pieces.slice_hashes(data, starts, ends).tolist()):
        assert seen.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_that_share_a_hash_are_encoded_apart(monkeypatch):
    monkeypatch.setattr(pieces, "slice_hashes", lambda values, starts, ends: (ends - starts).astype(np.uint64))
    ranks, _ = bpe.encoder(PATH)
    texts = ["ab cd", "ef gh", ""]
    ids, ptr = pieces.PieceCache(ranks.encode, ranks.bytes)(texts)
    assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [tokenizer().encode_ordinary(t) for t in texts]


def test_long_texts_in_parts(monkeypatch):
    text = "It's  \n many words,\t12 of  them; " * 300 + "x" * 4000 + "  \n "
    assert "".join(pieces.parts_of(text, 500)) == text and len(list(pieces.parts_of(text, 500))) > 10
    monkeypatch.setattr(pieces, "PART", 100)
    monkeypatch.setattr(pieces.parts_of, "__defaults__", (100,))
    _, cache = bpe.encoder(PATH)
    texts = [text, "", "short", text]
    ids, ptr = cache(texts)
    assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [tokenizer().encode_ordinary(t) for t in texts]


def test_the_cache_starts_anew_when_full():
    ranks, _ = bpe.encoder(PATH)
    cache = pieces.PieceCache(ranks.encode, ranks.bytes, limit=50)
    for i in range(20):
        texts = [" ".join(f"w{i}x{j}" for j in range(40)), "the same again"]
        ids, ptr = cache(texts)
        assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [tokenizer().encode_ordinary(t) for t in texts]


def test_texts_longer_than_a_batch(spark):
    text = "some words of a very long text " * 60_000
    df = spark.createDataFrame([(1, text), (2, None), (2, "b"), (None, "c")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_tokens"]) for r in bpe.encode_digest(df).collect()}
    assert got == {(1, len(tokenizer().encode_ordinary(text))), (2, 0), (2, 1), (None, 1)}
