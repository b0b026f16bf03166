"""Vectorised splitting of texts into tokenizer pieces, and a bounded piece cache.

``split`` finds, for many texts at once, the pieces that
``public_tokenizers.PATTERN`` matches: contractions, letters, digits or other
signs with one optional leading space, and white space. It works on code points
with array operations, so that a text costs a few nanoseconds a character, and
is tested against the pattern itself.

``PieceCache`` keeps the encoding of pieces that were seen, in flat arrays
behind an open-addressing table of 64-bit piece hashes. It is emptied when it is
full, so its memory is bounded whatever the corpus. What comes out is decoded and
compared with what went in, so that no two pieces can pass for each other.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

# The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# What may follow an apostrophe as a contraction, in the pattern's order.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, at = "".join(map(chr, points)), np.array(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, text):
            table[at[m.start() : m.end()]] = kind
    table[WHITE_SPACE] = SPACE
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Blocks of a slice that are hashed side by side with those of all others; longer slices are hashed block by block in one sweep.
SIDE_BY_SIDE = 6
_PLACE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], all slices at once.

    A slice is read in blocks of 8 bytes, the last one filled up with zeros. Every
    block is mixed with its place, and the sum of them with the slice's length.
    """
    width = values.dtype.itemsize
    padded = np.zeros(values.nbytes + 8, np.uint8)
    padded[:-8] = np.ascontiguousarray(values).view(np.uint8)
    words = np.ndarray((values.nbytes + 1,), "<u8", padded, strides=(1,))  # the block at every byte
    at, left = starts * width, (ends - starts) * width
    total = left.astype(np.uint64) * _LENGTH

    def hashed(at: np.ndarray, left: np.ndarray, nth: np.ndarray) -> np.ndarray:
        return mix((words[at] & _FIRST_BYTES[np.minimum(left, 8)]) ^ mix(nth.astype(np.uint64) * _PLACE + _LENGTH))

    live = np.arange(len(starts))
    for nth in range(SIDE_BY_SIDE):
        keep = left > 0
        if not keep.all():
            live, at, left = live[keep], at[keep], left[keep]
        if not len(live):
            return mix(total)
        total[live] += hashed(at, left, np.array([nth]))
        at, left = at + 8, left - 8
    keep = left > 0
    live, at, left = live[keep], at[keep], left[keep]
    if len(live):
        blocks = -(-left // 8)
        nth = ranges(np.zeros(len(live), np.int64), blocks)
        sums = hashed(np.repeat(at, blocks) + 8 * nth, np.repeat(left, blocks) - 8 * nth, nth + SIDE_BY_SIDE)
        total[live] += np.add.reduceat(sums, np.cumsum(blocks) - blocks)
    return mix(total)


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts in one string, its code points, and where each text starts (and the end)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ptr = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=ptr[1:])
    return joined, points, ptr


def split(points: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Starts of all pieces, ascending. No piece crosses a text's end."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)  # a text starts here
    first[ptr[:-1]] = True
    first[n] = True
    before = np.empty(n, np.uint8)  # the class before, 9 at a text's start
    before[0], before[1:] = 9, kind[:-1]
    before[first[:n]] = 9
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = 9, kind[1:]
    after[first[1:]] = 9
    white, blank = kind == SPACE, points == 32
    lead = np.zeros(n, bool)  # the character before is a blank that belongs to this piece
    lead[1:] = blank[:-1]
    lead &= ~white & ~first[:n]
    # A run of signs starts a piece unless a blank before it does.
    start = (~white & (kind != before) & ~lead) | first[:n]
    # White space: the last of a run before a sign stands alone or leads the sign; the rest are one piece.
    start |= white & ((before != SPACE) | ((after != 9) & (after != SPACE)))
    # Contractions: an apostrophe that starts a piece.
    for at in np.flatnonzero((points == 39) & start):
        end = int(np.searchsorted(ptr, at, "right"))
        rest = "".join(map(chr, points[at + 1 : min(at + 3, ptr[end])]))
        for tail in CONTRACTIONS:
            if rest.startswith(tail):
                here = at + 1 + len(tail)
                start[at + 1 : here] = False
                if here < ptr[end]:
                    start[here] = not (kind[here] != SPACE and lead[here])
                break
    return np.flatnonzero(start)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every slice, one slice after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


#: Code points that are split and encoded at once; a longer text goes in parts.
PART = 1 << 19
_CUT = regex.compile(r"(?<=\S)\s")


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """A text in parts of about ``size``, cut before white space that follows a sign: a piece ends there whatever comes after."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Bytes:
    """The bytes of every id, gathered by array operations."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.starts[ids], self.lengths[ids])]


class PieceCache:
    """Encodings of pieces by hash: ``encode(list of pieces) -> list of id lists`` fills it.

    limit: pieces it holds at most; beyond them it starts anew. decoder: every
    id's bytes. If the ids of some texts do not decode to these texts, two pieces
    share a hash, and all pieces of these texts are encoded without the cache.
    """

    def __init__(self, encode, decoder: Bytes, limit: int = 500_000):
        self.encode, self.decoder, self.limit = encode, decoder, limit
        self.bits = (2 * limit - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.count = 0
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if it is not there."""
        out = np.full(len(hashes), -1, np.int32)
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(hashes))
        mask = (1 << self.bits) - 1
        while len(open_):
            key = self.keys[at]
            hit = key == hashes[open_]
            out[open_[hit]] = self.slot[at[hit]]
            go = ~hit & (key != 0)
            open_, at = open_[go], (at[go] + 1) & mask
        return out

    def add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        found = self.encode(pieces)
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(lengths.sum()))
        for name, size in (("starts", self.count + len(found)), ("lengths", self.count + len(found)), ("ids", self.used + len(flat))):
            old = getattr(self, name)
            if len(old) < size:
                setattr(self, name, np.concatenate([old, np.zeros(max(size, 2 * len(old)) - len(old), old.dtype)]))
        self.starts[self.count : self.count + len(found)] = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        self.lengths[self.count : self.count + len(found)] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[at] == 0
            tried, spots = left[free], at[free]
            _, one = np.unique(spots, return_index=True)  # of several for a slot, one gets it
            self.keys[spots[one]] = hashes[tried[one]]
            self.slot[spots[one]] = self.count + tried[one]
            go = self.keys[at] != hashes[left]
            left, at = left[go], (at[go] + ~free[go].astype(bool)) & mask
        self.count += len(found)
        self.used += len(flat)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids start (and the end)."""
        if sum(map(len, texts)) <= 2 * PART:
            return self._together(texts)
        ids, ptr = [np.zeros(0, np.uint32)], [0]
        for text in texts:
            parts = [self._together([part])[0] for part in parts_of(text)]
            ids += parts
            ptr.append(ptr[-1] + sum(map(len, parts)))
        return np.concatenate(ids), np.array(ptr)

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, points, ptr = code_points(texts)
        starts = split(points, ptr)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(points))
        hashes = slice_hashes(points, starts, ends)
        hashes[hashes == 0] = 1
        at = self.find(hashes)
        if (at < 0).any():
            new, where = np.unique(hashes[at < 0], return_index=True)
            where = np.flatnonzero(at < 0)[where]
            if self.count + len(new) > self.limit:
                new, where = np.unique(hashes, return_index=True)
                self.bits = max(self.bits, (2 * len(new)).bit_length())
                self.clear()
            self.add(new, [joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())])
            at = self.find(hashes)
        lengths = self.lengths[at].astype(np.int64)
        ids = self.ids[ranges(self.starts[at], lengths)]
        if self.decoder.of(ids).tobytes() != joined.encode():
            alone = self.encode([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
            lengths = np.fromiter(map(len, alone), np.int64, len(alone))
            ids = np.fromiter((x for own in alone for x in own), np.uint32, int(lengths.sum()))
        sums = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=sums[1:])
        return ids, sums[np.searchsorted(starts, ptr)]
