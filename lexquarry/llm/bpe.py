"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton finds
every token of a piece in one scan. From the longest token at each position the
encoder walks forward, and steps back to shorter tokens where two neighbours do
not fit: two tokens fit if merging their bytes by rank gives just these two. Fits
are memoised, so a piece takes linear time, and the tokens are those of the rank
merges. Decoding gathers the bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lexquarry.llm.common import map_arrow
from lexquarry.llm.pieces import Bytes, PieceCache

VOCABULARY = "byte_bpe_50k.tiktoken"
NEVER = 1 << 40
#: Memoised fits a worker holds (about 100 bytes each); beyond them it starts anew.
FITS = 200_000


class RankEncoder:
    """Encodes single pieces by the ranks in a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        #: Of each token, the tokens at its right and left edge as merging builds it up, from a byte to itself.
        self.right: dict[int, list[int]] = {}
        self.left: dict[int, list[int]] = {}
        for rank, token in sorted(self.token.items()):  # parts have lower ranks than what they make
            parts = self.merged(token, rank)
            if len(token) == 1:
                self.right[rank], self.left[rank] = [rank], [rank]
            elif len(parts) == 2 and parts[0] in self.right and parts[1] in self.right:
                self.right[rank], self.left[rank] = [*self.right[parts[1]], rank], [*self.left[parts[0]], rank]
            else:
                continue  # merges never make it: it is found only as a whole piece
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        for rank in self.right:
            token = self.token[rank]
            self.shorter[rank] = next((r for k in range(len(token) - 1, 0, -1) if (r := self.rank.get(token[:k])) in self.right), -1)
        self.bytes = Bytes([self.token.get(r, b"") for r in range(max(self.token) + 1)])

    def merged(self, data: bytes, below: int = NEVER) -> list[int]:
        """Plain rank merges of ranks under ``below``: lowest rank first, leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def fit(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves a and b side by side.

        Merges happen in the order of ranks, so the edges of both tokens grow by
        their ranks; a and b fit unless the two edges would merge with each other
        before one of them grows.
        """
        pair = a << 32 | b
        known = self.fits.get(pair)
        if known is not None:
            return known
        if len(self.fits) >= FITS:
            self.fits.clear()
        xs, ys, i, j, known = self.right[a], self.left[b], 0, 0, None
        while known is None:
            x_grows = xs[i + 1] if i + 1 < len(xs) else NEVER
            y_grows = ys[j + 1] if j + 1 < len(ys) else NEVER
            both = self.rank.get(self.token[xs[i]] + self.token[ys[j]], NEVER)
            if both < x_grows and both <= y_grows:  # of equal ranks, the left one merges first
                known = False
            elif x_grows == y_grows == NEVER:
                known = True
            elif x_grows <= y_grows:
                i += 1
            else:
                j += 1
        self.fits[pair] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        longest, n, token, shorter, fit = [0] * len(data), len(data), self.token, self.shorter, self.fit
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = rank  # ends ascend, so the last is the longest
        out: list[int] = []
        dead = bytearray(n + 1)
        at, t = 0, longest[0]
        while at < n:
            while t >= 0:
                end = at + len(token[t])
                if not dead[end] and (not out or fit(out[-1], t)):
                    break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at = end
                t = longest[at] if at < n else -1
            else:  # nothing fits here: no encoding ends a token at this position
                dead[at] = 1
                t = out.pop()
                at -= len(token[t])
        return out

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [self.piece(x.encode()) for x in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes.of(ids).tobytes()


@functools.cache
def encoder(path: str) -> tuple[RankEncoder, PieceCache]:
    """One encoder and cache for each Python worker."""
    ranks = RankEncoder(path)
    return ranks, PieceCache(ranks.encode, ranks.bytes)


@functools.cache
def decimals(path: str) -> Bytes:
    """Every id in decimals with a blank after it."""
    return Bytes([b"%d " % i for i in range(len(encoder(path)[0].bytes.lengths))])


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token ids of every text and the bytes they decode to: ``(id, ids array<int>, decoded binary)``.

    A null or empty text has no ids. Repeated rows give repeated results, an empty
    table none; other columns are not read. Texts of any length are encoded whole.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        ranks, cache = encoder(path)
        for batch in batches:
            ids, ptr = cache(_texts(batch.column(1)))
            decoded = [ranks.decode(ids[a:b]) for a, b in zip(ptr, ptr[1:])]
            lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.binary())], [id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def encode_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: as ``encode``, but ids and decoded bytes leave the task as digests only.

    A null or empty text has no tokens, and digests of nothing. Repeated rows
    give repeated results, an empty table none; only the two named columns are read.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        ranks, cache = encoder(path)
        words = decimals(path)
        for batch in batches:
            ids, ptr = cache(_texts(batch.column(1)))
            said, back = [], []
            for a, b in zip(ptr, ptr[1:]):
                own = ids[a:b]
                said.append(hashlib.sha256(words.of(own)[:-1].tobytes()).hexdigest())
                back.append(hashlib.sha256(ranks.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ptr)), pa.array(said, pa.string()), pa.array(back, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
