"""Greedy grouping of names: each joins the first leader that is like it, or leads.

The order makes it sequential within a document, so a document's rows are one
stream in their order, a batch at a time. A task keeps distinct names only, and
once a document has many leaders it finds the first one like a name by indexes
over them instead of comparing with all: words for names that share enough of
them, substrings for names that hold one another. A name that comes again is
looked up, since equal names always share a leader.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: White space as column functions take it.
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Up to so many leaders of a document a name is compared with each.
FEW = 24
#: Characters of the substrings by which names are looked up.
GRAM = 3
#: How like names are of which one holds the other.
HOLDS = 0.8


class Leaders:
    """The leaders of one document so far, by number, with their indexes."""

    def __init__(self, threshold: float, few: int = FEW):
        self.threshold, self.few = threshold, few
        self.names: list[str] = []
        self.words: list[frozenset[str]] = []
        self.numbers: dict[str, int] = {}
        self.by_word: dict[str, list[int]] = defaultdict(list)
        self.by_gram: dict[str, list[int]] = defaultdict(list)
        self.sizes: set[int] = set()
        self.short: dict[str, int] = {}

    def add(self, name: str, words: frozenset[str]) -> int:
        n = len(self.names)
        self.names.append(name)
        self.words.append(words)
        self.numbers[name] = n
        if n >= self.few:
            for k in range(n if n > self.few else 0, n + 1):
                self.index(k, self.names[k], self.words[k])
        return n

    def index(self, n: int, name: str, words: frozenset[str]) -> None:
        for w in words:
            self.by_word[w].append(n)
        if self.threshold <= HOLDS:
            for gram in {name[i : i + GRAM] for i in range(len(name) - GRAM + 1)}:
                self.by_gram[gram].append(n)
            for size in range(1, min(GRAM, len(name) + 1)):
                for i in range(len(name) - size + 1):
                    self.short.setdefault(name[i : i + size], n)
            self.sizes.add(len(name))

    def first(self, name: str, words: frozenset[str]) -> int | None:
        """The first leader that is like the name."""
        if len(self.names) <= self.few:
            return next((n for n in range(len(self.names)) if self.alike(n, name, words)), None)
        best = self.numbers.get(name, len(self.names))
        if self.threshold <= HOLDS:
            best = min(best, self.held_in(name, best), self.holding(name, best))
        best = min(best, self.sharing(name, words, best))
        return best if best < len(self.names) else None

    def alike(self, n: int, name: str, words: frozenset[str]) -> bool:
        other = self.names[n]
        if name == other:
            return True
        if name in other or other in name:
            return self.threshold <= HOLDS
        both = len(words & self.words[n])
        return both / (len(words) + len(self.words[n]) - both) >= self.threshold

    def holding(self, name: str, best: int) -> int:
        """The first leader before ``best`` that the name is a part of."""
        if len(name) < GRAM:
            return min(best, self.short.get(name, best))
        rarest = min((self.by_gram.get(name[i : i + GRAM], ()) for i in range(len(name) - GRAM + 1)), key=len)
        for n in rarest:
            if n >= best:
                break
            if name in self.names[n]:
                return n
        return best

    def held_in(self, name: str, best: int) -> int:
        """The first leader before ``best`` that is a part of the name: its substrings of the lengths that leaders have are looked up."""
        for size in self.sizes:
            for i in range(len(name) - size + 1):
                best = min(best, self.numbers.get(name[i : i + size], best))
        return best

    def sharing(self, name: str, words: frozenset[str], best: int) -> int:
        """The first leader before ``best`` whose words are enough the same.

        It shares all but few of the words, so it is found under one of the rarest.
        Of names that hold one another the words do not count.
        """
        least = math.ceil(self.threshold * len(words) - 1e-9)
        for w in sorted(words, key=lambda w: len(self.by_word.get(w, ())))[: len(words) - least + 1]:
            for n in self.by_word.get(w, ()):
                if n >= best:
                    break
                both = len(words & self.words[n])
                if both / (len(words) + len(self.words[n]) - both) >= self.threshold and self.alike(n, name, words):
                    best = n
                    break
        return best


def known(name: str | None) -> bool:
    return bool(name) and name != "unknown case"


def lead(rows: Iterator[tuple], threshold: float, few: int = FEW) -> Iterator[tuple]:
    """``(doc_id, ord, leader)`` of rows ``(doc_id, ord, name)`` sorted by document and place; leader: the place of the leader."""
    doc, leaders, places, said = None, None, [], {}
    for doc_id, place, name in rows:
        if leaders is None or doc_id != doc:
            doc, leaders, places, said = doc_id, Leaders(threshold, few), [], {}
        if not known(name):
            yield doc_id, place, place
            continue
        n = said.get(name)
        if n is None:
            words = frozenset(w for w in _SPACE.split(name) if w)
            n = leaders.first(name, words)
            if n is None:
                n = leaders.add(name, words)
                places.append(place)
            said[name] = n
        yield doc_id, place, places[n]


def greedy_groups(named: DataFrame, threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, ord, leader)`` of ``named(doc_id, ord, name)``, and the columns ``carry``: each row joins the first leader that is similar enough, or leads.

    Rows without a known name lead themselves. Rows that come with a document's in
    one partition stay there: the window needs no more than that.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0, and 1 at most")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    ordered = named.select("doc_id", "ord", "name", *carry, place.alias("place")).sortWithinPartitions("doc_id", "ord")
    kinds = {c: named.schema[c].dataType.simpleString() for c in ("doc_id", "ord", *carry)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, taken = None, 0

        def stream():
            nonlocal batch, taken
            for batch in batches:
                taken = 0
                yield from zip(*(c.to_pylist() for c in batch.columns[:3]))

        found: list = []
        for _, _, leader in lead(stream(), threshold):
            found.append(leader)
            taken += 1
            if taken == len(batch):
                kept = [batch.column(i) for i in range(3, 3 + len(carry))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, batch.column(1).type), *kept], ["doc_id", "ord", "leader", *carry])
                found = []

    return ordered.mapInArrow(find, ", ".join(f"{c} {kinds['ord' if c == 'leader' else c]}" for c in ("doc_id", "ord", "leader", *carry)))
