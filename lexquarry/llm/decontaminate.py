"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are normalised (A-Z lower-cased, runs of white space to
one blank). An item of L bytes that occurs with at most e edits shares at least
L - q + 1 - q * e of its q-grams with its place in the document, on diagonals
(document position minus item position) that lie at most e apart. So shared
q-grams are counted in diagonal bands that overlap by half; bands that reach the
bound are verified by banded alignment, the rest cannot hold the item.

The edit budget is EDIT_SHARE of the item's length. Banded alignment goes by edits:
with 0, 1, 2, ... edits it finds how far into the item each diagonal of the band
reaches, so a place with few edits costs little however long the item is.
Neighbouring bands are aligned as one, and a place that is no better than the best
so far is given up.

The budget is the same for all lengths; q is not. Items of LONG_ITEM bytes or more
have 8-grams, shorter ones 6-grams, for which the bound is above zero down to 13
bytes, from where on the budget allows an edit. Items below that are looked up
exactly; since any letters hold a short item by chance, they and their place in
the text must not go on with a letter or digit on either side.

Items are searched in blocks of at most BLOCK_BYTES of text, so that what a task
holds of the benchmark is bounded whatever its size.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import map_arrow, materialize, utf8_buffer
from lexquarry.llm.near_dedup import _BLANK, _TO_LOWER
from lexquarry.llm.pieces import ranges

EDIT_SHARE = 0.08
#: Bytes of a gram, and the bytes from which on an item has the longer ones.
LONG_Q, SHORT_Q, LONG_ITEM = 8, 6, 32
#: Diagonals that are aligned at once.
WIDEST = 1 << 16
#: Shared q-grams that are expanded at once.
HITS_AT_ONCE = 1 << 21
BLOCK_BYTES = 4 << 20
#: Added to diagonals, so that none is negative.
DIAGONALS = 1 << 24
SCHEMA = "id long, item_id long, start int, end int, edits int"


def normalise(data: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, text offsets, and each kept byte's position in the input."""
    if not len(data):
        return data, ptr, np.zeros(0, np.int64)
    blank = _BLANK[data]
    out = _TO_LOWER[data]
    out[blank] = 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    starts = ptr[:-1][np.diff(ptr) > 0]
    keep[starts] = ~blank[starts]  # no blank at a text's start
    at = np.flatnonzero(keep)
    return out[at], np.searchsorted(at, ptr), at


def grams(data: np.ndarray, q: int = LONG_Q) -> np.ndarray:
    """The q bytes (8 at most) from each position as one integer."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((n,), "<u8", raw, strides=(1,)) & np.uint64((1 << (8 * q)) - 1)


def reach(pattern: np.ndarray, region: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How far pattern[at:] and region[at + row:] agree from each place on: the first place where they differ, or the pattern's end.

    The region is longer than any place asked for, and ends in a byte that no pattern has.
    """
    m, at = len(pattern), at.copy()
    x = np.ndarray((m + 1,), "<u8", np.concatenate([pattern, np.zeros(8, np.uint8)]), strides=(1,))
    y = np.ndarray((len(region) + 1,), "<u8", np.concatenate([region, np.full(8, 255, np.uint8)]), strides=(1,))
    live = np.flatnonzero(at < m)
    while len(live) > 4:
        differ = x[at[live]] ^ y[at[live] + row[live]]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        step = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
        at[live] = np.minimum(m, at[live] + step)
        live = live[(differ == 0) & (at[live] < m)]
    for i in live.tolist():
        a, d = int(at[i]), int(row[i])
        while a < m:
            b = min(m, a + 4096)
            differ = np.flatnonzero(pattern[a:b] != region[a + d : b + d])
            if len(differ):
                a += int(differ[0])
                break
            a = b
        at[i] = a
    return at


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the pattern's place in the text with the fewest edits, on diagonals low to high; None beyond k edits."""
    m, size = len(pattern), high - low + 1
    region = np.full(size + m + 1, 255, np.uint8)  # no byte of UTF-8
    a, b = max(0, low), min(len(text), low + size + m)
    if b > a:
        region[a - low : b - low] = text[a:b]
    row = np.arange(size)
    far, origin = reach(pattern, region, np.zeros(size, np.int64), row), row.copy()
    for edits in range(k + 1):
        done = np.flatnonzero(far >= m)
        done = done[low + done + m <= len(text)]
        if len(done):
            d = int(done[0])
            return max(0, low + int(origin[d])), low + d + m, edits
        if edits == k:
            return None
        best, start = np.minimum(far + 1, m), origin  # a byte is replaced
        gone = np.append(np.minimum(far[1:] + 1, m), -1)  # a byte of the item is missing
        best, start = np.where(gone > best, gone, best), np.where(gone > best, np.append(origin[1:], 0), start)
        more = np.append(-1, far[:-1])  # a further byte of the text
        best, start = np.where(more > best, more, best), np.where(more > best, np.append(0, origin[:-1]), start)
        far, origin = reach(pattern, region, best, row), start
    return None


def budget(n: int, edit_share: float, q: int) -> int:
    """Edits that an item of n bytes may have: its share, and no more than leave one q-gram shared."""
    return min(int(n * edit_share), (n - q) // q)


#: Letters and digits, and all bytes of code points beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Grams:
    """The q-grams of items of one q, and the search by them."""

    def __init__(self, ids: list[int], texts: list[bytes], q: int, edit_share: float):
        self.ids, self.texts, self.q = ids, texts, q
        n = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(len(t), edit_share, q) for t in self.texts], np.int64)
        self.least = n - q + 1 - q * self.edits
        self.width = self.edits + 1
        every = [grams(np.frombuffer(t, np.uint8), q) for t in self.texts]
        flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(every)), [len(g) for g in every])
        place = np.concatenate([np.arange(len(g)) for g in every]) if every else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.gram, first = np.unique(flat[order], return_index=True)
        self.first, self.count = first, np.diff(np.append(first, len(flat)))
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.gram)] = True

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def bands(self, data: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, band) triples whose shared q-grams reach the bound."""
        none = (np.zeros(0, np.int64),) * 3
        data, ptr = data[ptr[0] : ptr[-1]], ptr - ptr[0]
        gram = grams(data, self.q)
        at = np.flatnonzero(self.seen[self._slot(gram)])
        if not len(at) or not len(self.gram):
            return none
        spot = np.minimum(np.searchsorted(self.gram, gram[at]), len(self.gram) - 1)
        hit = self.gram[spot] == gram[at]
        at, spot = at[hit], spot[hit]
        doc = np.searchsorted(ptr, at, "right") - 1
        inside = at + self.q <= ptr[doc + 1]
        at, spot, doc = at[inside], spot[inside], doc[inside]
        if not len(at):
            return none
        count = self.count[spot]
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        upto = np.cumsum(count)
        i = 0
        while i < len(at):  # so many that they fit, whatever repeats in document and item
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + HITS_AT_ONCE, "right")))
            pick = ranges(self.first[spot[i:j]], count[i:j])
            item = self.item[pick]
            diagonal = np.repeat(at[i:j] - ptr[doc[i:j]], count[i:j]) - self.place[pick] + DIAGONALS  # never negative
            band = diagonal // self.width[item]
            key = (np.repeat(doc[i:j], count[i:j]) * len(self.ids) + item) * np.int64(1 << 34) + band
            own, n = np.unique(np.concatenate([key, key - 1]), return_counts=True)  # band b covers the width from b * width, and the next
            keys, where = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            i = j
        pair = keys >> 34
        item = pair % len(self.ids)
        good = counts >= self.least[item]
        return pair[good] // len(self.ids), item[good], keys[good] & ((1 << 34) - 1)

    def runs(self, data: np.ndarray, ptr: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, first band, last band) of neighbouring bands that reach the bound."""
        step = max(1, (1 << 28) // max(1, len(self.ids)))  # documents times items, so that their numbers fit
        out: list[tuple[int, int, int, int]] = []
        for i in range(0, len(ptr) - 1, step):
            doc, item, band = self.bands(data, ptr[i : i + step + 1])
            order = np.lexsort((band, item, doc))
            for d, t, k in zip((doc[order] + i).tolist(), item[order].tolist(), band[order].tolist()):
                last = out[-1] if out else None
                if last and last[:2] == (d, t) and k <= last[3] + 2 and (k - last[2] + 2) * int(self.width[t]) <= WIDEST:
                    out[-1] = (d, t, last[2], k)
                else:
                    out.append((d, t, k, k))
        return out

    def verify(self, text: np.ndarray, item: int, first: int, last: int, most: int) -> tuple[int, int, int] | None:
        """Start, end and edits of the item's best place on the bands' diagonals, if it has ``most`` edits at most."""
        pattern, k, w = self.texts[item], int(self.edits[item]), int(self.width[item])
        low = first * w - DIAGONALS - k
        high = (last + 2) * w - DIAGONALS + k
        exact = text[max(0, low) : max(0, high + len(pattern))].tobytes().find(pattern)
        if exact >= 0:
            exact += max(0, low)
            return exact, exact + len(pattern), 0
        return aligned(np.frombuffer(pattern, np.uint8), text, low, high, most) if most > 0 else None

    def places(self, text: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item id, start, end, edits) of each item's best place in each document; positions in the document's normalised bytes."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, first, last in self.runs(text, at):
            known = best.get((doc, item))
            most = int(self.edits[item]) if known is None else known[0] - 1
            if most < 0:
                continue
            own = text[at[doc] : at[doc + 1]]
            found = self.verify(own, item, first, last, most)
            if found and (known is None or found[2] < known[0]):
                best[doc, item] = (found[2], max(0, found[0]), min(len(own), found[1]))
        return [(doc, self.ids[item], a, b, edits) for (doc, item), (edits, a, b) in best.items()]


class Index:
    """A block of items: those with q-grams by their q, and an automaton of those too short for any edit."""

    def __init__(self, items: list[tuple[int, bytes]], edit_share: float = EDIT_SHARE):
        own: dict[int, tuple[list[int], list[bytes]]] = {LONG_Q: ([], []), SHORT_Q: ([], [])}
        tiny: dict[bytes, list[int]] = {}
        for item, raw in items:
            data, _, _ = normalise(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            text = data.tobytes().rstrip(b" ")
            q = LONG_Q if len(text) >= LONG_ITEM else SHORT_Q
            if text and budget(len(text), edit_share, q) < 1 and q == SHORT_Q:
                tiny.setdefault(text, []).append(item)
            elif text:
                own[q][0].append(item)
                own[q][1].append(text)
        self.grams = [Grams(ids, texts, q, edit_share) for q, (ids, texts) in own.items() if ids]
        self.tiny = None
        if tiny:
            self.tiny = ahocorasick.Automaton()
            for text, ids in tiny.items():
                self.tiny.add_word(text.decode("latin-1"), (len(text), ids))
            self.tiny.make_automaton()

    def exact_words(self, text: np.ndarray, ptr: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item id, start, end) of each tiny item's first place in each document; positions in normalised bytes of the document."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, (a, b) in enumerate(zip(ptr.tolist(), ptr[1:].tolist())):
            own = text[a:b]
            for last, (n, items) in self.tiny.iter(own.tobytes().decode("latin-1")):
                start, end = last - n + 1, last + 1
                goes_on = (start > 0 and _WORD[own[start - 1]] and _WORD[own[start]]) or (end < len(own) and _WORD[own[end]] and _WORD[own[end - 1]])
                if not goes_on:
                    for item in items:
                        found.setdefault((doc, item), (start, end))
        return [(*pair, *span) for pair, span in found.items()]

    def search(self, data: np.ndarray, ptr: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, edits) of each item's best place in each document; positions in input bytes."""
        text, at, origin = normalise(data, ptr)
        spans = [x for g in self.grams for x in g.places(text, at)]
        if self.tiny is not None:
            spans += [(*x, 0) for x in self.exact_words(text, at)]
        out = []
        for doc, item, a, b, edits in sorted(spans):
            spots = origin[at[doc] : at[doc + 1]] - ptr[doc]
            out.append((doc, item, int(spots[a]), int(spots[max(a, b - 1)]) + 1, edits))
        return out


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_share: float = EDIT_SHARE) -> DataFrame:
    """Benchmark items found in documents: ``(id, item_id, start, end, edits, contaminated)``.

    One row for each document and item with at most ``edit_share`` of the item's
    bytes edited: its best place, in UTF-8 bytes of the text. Items too short for
    an edit (under 13 normalised bytes) count where they occur exactly and no word
    goes on beyond them. A text is searched whole, however long. Clean documents, null and empty texts have no row; nor have null items
    and items without a sign. Rows that repeat an id or item give repeated rows.
    Only the named columns are read. An empty benchmark or table gives no rows.
    """
    items = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / (BLOCK_BYTES / 2)))  # dealt by hash: half full on average
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()
        index = Index(sorted((r["item"], bytes(r["text"])) for r in own), edit_share)

        def run(batches, index=index):
            for batch in batches:
                found = index.search(*utf8_buffer(batch.column(1)))
                ids = batch.column(0).to_pylist()
                cols = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], ["id", "item_id", "start", "end", "edits"])

        found = map_arrow(docs, run, SCHEMA)
        if n_blocks > 1:  # so that the driver holds one block's index at a time
            found = materialize(found, "leaks")
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("id", id_col).withColumn("contaminated", F.lit(True))
