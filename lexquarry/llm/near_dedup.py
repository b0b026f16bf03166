"""MinHash near-duplicate classes by a multi-index Hamming join.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Equal
   sets share a node, named by a hash of the set, so exact copies are one node
   however many there are.
2. A node's signature holds the low 8 bits of SIGNATURE MinHash values. Two sets
   of similarity 0.8 differ in a fifth of the symbols, about 13 of 66.
3. Pigeonhole: cut into CHUNKS chunks of WIDTH symbols, two signatures with at
   most 2 * CHUNKS - 1 = 21 differing symbols have a chunk with at most one. All
   such errors are enumerated: for each chunk and each position, a key of the
   other symbols. So every pair up to that distance shares a key. (Most pairs
   beyond it do, too: a pair at similarity 0.8 shares no key with probability
   1e-5.)
4. Nodes of a key are compared without making all pairs. First each node meets a
   few leaders of its keys, the nearest by signature. Links are confirmed on the
   full sets and joined to components. Then, in keys that still hold several
   components, the nodes outside the largest meet the nodes of other components.
   Pairs inside a component need no comparing: they can't change it.
5. That meeting is done twice. First by signatures alone, and what comes out is
   which nodes of a key are near any; then these nodes bring their full sets, and
   every near pair is decided where it meets. Only links between components leave
   a task, fewer than it has nodes, so a group of n texts that are all just too
   far from one another costs n rows for each of its keys, and not n * n.

A key's nodes are dealt over blocks of BLOCK on either side of the comparison, so a
key that holds a third of all nodes spreads over many tasks, and a task holds two
blocks of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import components, discard, map_arrow, materialize, materialize_buckets, utf8_buffer
from lexquarry.llm.pieces import mix, slice_hashes

CHUNKS, WIDTH, SYMBOL_BITS = 11, 6, 8
SIGNATURE = CHUNKS * WIDTH
#: Candidates differ in at most so many symbols: at similarity 0.8, four standard deviations over the mean.
FARTHEST = 26
#: Every pair that differs in at most so many symbols shares a key; each of them is compared on its sets.
PROMISED = 2 * CHUNKS - 1
BLOCK = 4096
#: Shingles of a block, on average over the blocks of a key (8 bytes each); bytes of blocks that a task reads at once.
SHINGLES, HELD_BYTES = 1 << 20, 16 << 20
#: Pairs beyond the promised distance that share a key are confirmed, too, if longer signatures are near: 512 symbols of 4 bits.
#: At similarity 0.8 they differ in 96 symbols, standard deviation 9; candidates differ in at most six deviations more (beyond it: 5e-9).
LONG, LONG_FARTHEST = 512, 149
#: Pairs of one node that are confirmed in one task.
HOT = 2000
#: The ids of documents with candidates are broadcast up to this many (8 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 4_000_000

_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_random = np.random.default_rng(20240501)
_XOR = _random.integers(1, 2**63, SIGNATURE, dtype=np.uint64)[:, None]
_MULTIPLY = (_random.integers(1, 2**63, SIGNATURE, dtype=np.uint64) | np.uint64(1))[:, None]
_LONG_XOR = _random.integers(1, 2**63, LONG, dtype=np.uint64)[:, None]
_LONG_MULTIPLY = (_random.integers(1, 2**63, LONG, dtype=np.uint64) | np.uint64(1))[:, None]
_ORDER = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, ptr: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; words are runs of other bytes than white space, A-Z lower-cased."""
    n_docs = len(ptr) - 1
    if len(data) == 0:
        return [np.zeros(0, np.uint64)] * n_docs
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)  # a text starts here
    edge[ptr] = True
    begins, finishes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    finishes[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    word = slice_hashes(_TO_LOWER[data], starts, ends)
    of = np.searchsorted(starts, ptr)
    counts = np.diff(of)
    last = np.repeat(of[1:], counts)
    at = np.arange(len(word))
    total = np.zeros(len(word), np.uint64)
    for j in range(words):
        there = at + j < last
        total += np.where(there, word[np.minimum(at + j, len(word) - 1)] if len(word) else 0, np.uint64(j + 1)) * _ORDER[j]
    total = mix(total)
    lengths = np.where(counts == 0, 0, np.maximum(1, counts - words + 1))
    return [np.unique(total[a : a + k]) for a, k in zip(of[:-1].tolist(), lengths.tolist())]


def minima(hashes: np.ndarray, xor: np.ndarray, multiply: np.ndarray) -> np.ndarray:
    low = None
    for i in range(0, len(hashes), 1024):
        part = ((hashes[None, i : i + 1024] ^ xor) * multiply).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return mix(low)


def signature(hashes: np.ndarray) -> bytes:
    return (minima(hashes, _XOR, _MULTIPLY) & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.uint8).tobytes()


def long_signature(hashes: np.ndarray) -> bytes:
    symbols = (minima(hashes, _LONG_XOR, _LONG_MULTIPLY) & np.uint64(15)).astype(np.uint8)
    return (symbols[::2] * 16 + symbols[1::2]).tobytes()


def long_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many symbols each row of x differs from each row of y; both are 64-bit words."""
    d = x[:, None, :] ^ y[None, :, :]
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    d &= np.uint64(0x1111111111111111)
    return np.bitwise_count(d).sum(-1, dtype=np.int32)


def short_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many symbols each signature of x differs from each of y; both are rows of bytes."""
    wide = [np.pad(v, ((0, 0), (0, -SIGNATURE % 8))).view(np.uint64) for v in (x, y)]
    d = wide[0][:, None, :] ^ wide[1][None, :, :]
    for shift in (4, 2, 1):
        d |= d >> np.uint64(shift)
    d &= np.uint64(0x0101010101010101)
    return np.bitwise_count(d).sum(-1, dtype=np.int32)


def node_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(df: DataFrame, words: int) -> DataFrame:
    """``(doc, node, n, sig)`` of every row of ``df(doc, text)``; node and sig are null for texts without words."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(*utf8_buffer(batch.column(1)), words)
            some = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([node_of(s) if x else None for s, x in zip(sets, some)], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s) if x else None for s, x in zip(sets, some)], pa.binary()),
                ],
                ["doc", "node", "n", "sig"],
            )

    return map_arrow(df, run, "doc long, node long, n long, sig binary")


def index_keys(nodes: DataFrame) -> DataFrame:
    """``(node, keys)``: every chunk with each one of its symbols left out."""

    def run(batches):
        weight = (np.int64(1) << (SYMBOL_BITS * np.arange(WIDTH - 1))).astype(np.int64)
        keep = np.array([[i for i in range(WIDTH) if i != p] for p in range(WIDTH)])
        label = (np.arange(SIGNATURE, dtype=np.int64) << (SYMBOL_BITS * (WIDTH - 1))).reshape(CHUNKS, WIDTH)
        for batch in batches:
            n = len(batch)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, CHUNKS, WIDTH).astype(np.int64)
            keys = (sig[:, :, keep] * weight).sum(-1) + label
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * SIGNATURE + 1, SIGNATURE), pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "keys"])

    return map_arrow(nodes.select("node", "sig"), run, "node long, keys array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)``, those with 100 * intersection >= percent * union of the full shingle sets.

    A node that is b in many pairs meets them in several tasks, a copy of its text in each.
    """

    def run(batches):
        for batch in batches:
            left = shingle_sets(*utf8_buffer(batch.column(2)), words)
            right = shingle_sets(*utf8_buffer(batch.column(3)), words)
            good = []
            for x, y in zip(left, right):
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "x"), ("b", "y")))
    hot = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("copies")).where("copies > 1"), "hot")
    n_hot = hot.count()
    joined = pairs.join(F.broadcast(hot), "b", "left_anti") if n_hot else pairs  # one row for HOT pairs at most
    joined = joined.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    if n_hot:
        dealt = pairs.join(F.broadcast(hot), "b").withColumn("copy", F.pmod(F.xxhash64("a"), "copies").cast("int")).drop("copies")
        copies = right.join(F.broadcast(hot), "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        joined = joined.union(dealt.join(left, "a").join(copies, ["b", "copy"]).select("a", "b", "x", "y"))
    links = materialize(map_arrow(joined, run, "a long, b long"), "links")
    discard(hot)
    return links


def dealt(rows: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(key, node, comp)`` on two sides: a key's nodes outside its largest component (probe 1) meet all its nodes (probe 0).

    Either side is cut into blocks of BLOCK nodes and SHINGLES shingles on average,
    and each block of one meets each of the other in a group ``(key, block, turn)``.
    columns: what comes along from ``nodes``, besides node and n.
    """
    rows = rows.join(nodes.select("node", "n", *columns), "node")
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    largest = F.struct("k", "comp", "s")
    mixed = sizes.groupBy("key").agg(F.sum("k").alias("total"), F.sum("s").alias("shingles"), F.max(largest).alias("x"), F.count(F.lit(1)).alias("comps")).where("comps > 1")

    def parts(k, s):
        return F.greatest(F.ceil(k / BLOCK), F.ceil(s / SHINGLES)).cast("int")

    mixed = mixed.select("key", F.col("x.comp").alias("main"), parts(F.col("total"), F.col("shingles")).alias("blocks"), parts(F.col("total") - F.col("x.k"), F.col("shingles") - F.col("x.s")).alias("turns"))
    rows = rows.join(mixed, "key")

    def one_of(count: str):
        return F.pmod(F.xxhash64("node"), count).cast("int")

    def each_of(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    side = ["node", "comp", "n", *columns]
    build = rows.select("key", one_of("blocks").alias("block"), each_of("turns").alias("turn"), F.lit(0).alias("probe"), (F.col("comp") == F.col("main")).alias("inner"), *side)
    probe = rows.where("comp <> main").select("key", each_of("blocks").alias("block"), one_of("turns").alias("turn"), F.lit(1).alias("probe"), F.lit(False).alias("inner"), *side)
    return build.union(probe).repartition("key", "block", "turn").sortWithinPartitions("key", "block", "turn", "probe", "node")


def groups(batches):
    """Tables of whole groups ``(key, block, turn)`` of what ``dealt`` returns, with where each group begins and ends."""
    held: list[pa.RecordBatch] = []

    def cuts(table: pa.Table) -> np.ndarray:
        key, block, turn = (np.asarray(table[c]) for c in ("key", "block", "turn"))
        return np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (turn[1:] != turn[:-1])) + 1

    def whole(table: pa.Table):
        cut = cuts(table).tolist()
        return table, list(zip([0, *cut], [*cut, len(table)]))

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < 4 * BLOCK and sum(x.nbytes for x in held) < HELD_BYTES:
            continue
        table = pa.Table.from_batches(held)
        last = int(cuts(table).max(initial=0))
        if last:
            yield whole(table.slice(0, last))
        held = table.slice(last).to_batches()
    if held and sum(map(len, held)):
        yield whole(pa.Table.from_batches(held))


def near_pairs(table: pa.Table, found: list[tuple[int, int]], percent: int):
    """For each group: its bounds, and pairs (probe row, build row) of different components that are near by their signatures, for a few probes at a time."""
    keys, probe, node, comp, n = (np.asarray(table[c]) for c in ("key", "probe", "node", "comp", "n"))
    inner = np.asarray(table["inner"].combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(table), SIGNATURE)
    long = np.frombuffer(b"".join(table["long"].to_pylist()), np.uint64).reshape(len(table), LONG // 16)
    for a, z in found:
        if probe[a] == 1 or probe[z - 1] == 0:
            continue
        p, b = a + np.flatnonzero(probe[a:z] == 1), a + np.flatnonzero(probe[a:z] == 0)
        spot = (int(keys[a]) >> (SYMBOL_BITS * (WIDTH - 1))) & 0xFFFF
        for i in range(0, len(p), 64):
            q = p[i : i + 64]
            good = (long_distances(long[q], long[b]) <= LONG_FARTHEST) | (short_distances(sig[q], sig[b]) <= PROMISED)
            good &= comp[q][:, None] != comp[b][None, :]
            good &= inner[b][None, :] | (node[q][:, None] < node[b][None, :])  # two probes meet once
            small, large = np.minimum(n[q][:, None], n[b][None, :]), np.maximum(n[q][:, None], n[b][None, :])
            good &= small * 100 >= large * percent
            x, y = np.nonzero(good)
            if not len(x):
                continue
            # A pair counts at the first key that it shares.
            errors = (sig[q[x]] != sig[b[y]]).reshape(-1, CHUNKS, WIDTH)
            chunk = (errors.sum(-1) <= 1).argmax(-1)
            here = errors[np.arange(len(x)), chunk]
            keep = chunk * WIDTH + here.argmax(-1) == spot
            if keep.any():
                yield (a, z), q[x[keep]], b[y[keep]]


def candidates(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(key, node)``: nodes that are near a node of another component in a key, by their signatures; at most a row of ``rows(key, node, comp)`` each."""

    def run(batches):
        for table, found in groups(batches):
            keys, node = np.asarray(table["key"]), np.asarray(table["node"])
            near = np.zeros(len(table), bool)
            for _, x, y in near_pairs(table, found, percent):
                near[x] = near[y] = True
            yield pa.RecordBatch.from_arrays([pa.array(keys[near]), pa.array(node[near])], ["key", "node"])

    return map_arrow(dealt(rows, nodes, ["sig", "long"]), run, "key long, node long").distinct()


class Overlaps:
    """How many shingles sets share with each of a group's sets.

    Shingles of many of the sets are counted by a matrix product, others by lists of
    the sets that hold them.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        owner = np.repeat(np.arange(self.n), [len(s) for s in sets])
        self.every, which = np.unique(np.concatenate(sets), return_inverse=True)
        self.held = np.bincount(which, minlength=len(self.every))
        self.common = np.full(len(self.every), -1, np.int64)
        many = np.flatnonzero(self.held >= max(8, self.n / 4))
        self.common[many] = np.arange(len(many))
        self.matrix = np.zeros((self.n, len(many)), np.float32)
        column = self.common[which]
        self.matrix[owner[column >= 0], column[column >= 0]] = 1
        self.owner = owner[np.argsort(which, kind="stable")]
        self.begins = np.concatenate(([0], np.cumsum(self.held)))[:-1]

    def counts(self, sets: list[np.ndarray]) -> np.ndarray:
        """Rows: the sets; columns: those of the group."""
        row, hashes = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(self.every, hashes), len(self.every) - 1)
        there = self.every[at] == hashes
        row, at = row[there], at[there]
        column = self.common[at]
        rare, dense = column < 0, np.zeros((len(sets), self.matrix.shape[1]), np.float32)
        dense[row[~rare], column[~rare]] = 1
        lengths = self.held[at[rare]]
        first = np.repeat(self.begins[at[rare]] - np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths)
        met = self.owner[first + np.arange(len(first))]
        listed = np.bincount(np.repeat(row[rare], lengths) * self.n + met, minlength=len(sets) * self.n)
        return np.rint(dense @ self.matrix.T).astype(np.int64) + listed.reshape(len(sets), self.n)


def linked(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between different components of rows ``(key, node, comp)``, decided on the full sets where the nodes meet.

    nodes: ``(node, n, sig, long, hashes)``. Of the links between components that a
    group has joined already none comes out, so a group's links are fewer than its nodes.
    """

    def run(batches):
        for table, found in groups(batches):
            node, comp, n = (np.asarray(table[c]) for c in ("node", "comp", "n"))
            hashes = table["hashes"].combine_chunks()
            of, at, root = None, None, {}
            out = []

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    root[c] = c = root.get(root[c], root[c])
                return c

            def sets(rows_):
                return [np.frombuffer(hashes[int(i)].as_buffer(), np.uint64) for i in rows_]

            for (a, z), x, y in near_pairs(table, found, percent):
                if at != (a, z):
                    at, root = (a, z), {}
                    build = a + np.flatnonzero(np.asarray(table["probe"])[a:z] == 0)
                    of = Overlaps(sets(build))
                asked, which = np.unique(x, return_inverse=True)
                both = of.counts(sets(asked))[which, y - a]
                good = 100 * both >= percent * (n[x] + n[y] - both)
                for i, j in zip(x[good].tolist(), y[good].tolist()):
                    r, t = find(int(comp[i])), find(int(comp[j]))
                    if r != t:
                        root[max(r, t)] = min(r, t)
                        out.append((int(node[i]), int(node[j])))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return map_arrow(dealt(rows, nodes, ["sig", "long", "hashes"]), run, "a long, b long").distinct()


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """``(node, hashes)`` of ``texts(node, text)``: the sorted shingle hashes, 8 bytes each."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(*utf8_buffer(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    return map_arrow(texts.select("node", "text"), run, "node long, hashes binary")


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, comp)`` after joining the components that ``links(a, b)`` connect."""
    edges = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
    edges = edges.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    root = components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    out = materialize(labels.join(root, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
    discard(labels, links)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate classes: ``(id, n_shingles, component_id, kept)``, one row per input row.

    Texts are linked if 100 * intersection >= percent * union of their sets of
    ``words``-word shingles (a shorter text is one shingle). component_id is the
    smallest id that links reach; kept marks the rows that carry it. Texts that
    are null or without words have no shingles and are linked with nothing; rows
    with a null id get the class of their text, and kept false. Equal texts are
    always of one class. Other columns are not read, so their names can't clash.
    Texts are read whole, however long; an empty table gives no rows.

    percent may be 80 or more: the candidate search is built for that.
    """
    if percent < 80:
        raise ValueError("the candidate search finds pairs of similarity 0.8 and more")
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sigs = materialize(signatures(docs, words), "signatures")
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = materialize(nodes, "nodes")
    keys = index_keys(nodes).select("node", F.explode("keys").alias("key"))
    # Most keys have one node: only a count of each is shuffled before they go.
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    rows = materialize(keys.join(shared, "key"), "shared-keys")
    # Leaders of a key: its smallest and largest node, and the first by two hashes.
    order = [F.xxhash64("node", F.lit(i)) for i in (1, 2)]
    leaders = rows.groupBy("key").agg(F.min("node").alias("l0"), F.max("node").alias("l1"), *(F.min_by("node", o).alias(f"l{i + 2}") for i, o in enumerate(order)))
    led = rows.join(leaders, "key")
    pairs = led.select("node", F.explode(F.array_distinct(F.array("l0", "l1", "l2", "l3"))).alias("leader")).where("node <> leader").distinct()
    near = materialize(rows.select("node").distinct(), "near")
    # The texts that any comparison needs, found again by the rows' ids, bucketed by their node.
    wanted = materialize(near.join(nodes.select("node", "doc", "n", "sig"), "node"), "wanted")
    ids = wanted.select(F.col("doc").alias("want"))
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    some = docs.join(ids, F.col("doc").eqNullSafe(F.col("want")), "left_semi")
    texts, drop_texts = materialize_buckets(named_texts(some, words), "texts", "node")
    short, wanted = wanted, materialize(wanted.join(long_signatures(texts, words), "node"), "wanted-long")
    discard(short)

    def distance(a: str, b: str):
        return F.aggregate(F.sequence(F.lit(1), F.lit(SIGNATURE)), F.lit(0), lambda s, i: s + F.when(F.substring(F.col(a), i, F.lit(1)) == F.substring(F.col(b), i, F.lit(1)), 0).otherwise(1))

    met = pairs.join(wanted.select("node", F.col("sig").alias("s"), F.col("n").alias("m")), "node")
    met = met.join(wanted.select(F.col("node").alias("leader"), F.col("sig").alias("t"), F.col("n").alias("k")), "leader")
    met = met.where(F.least("m", "k") * 100 >= F.greatest("m", "k") * percent).withColumn("far", distance("s", "t")).where(F.col("far") <= FARTHEST)
    star = met.groupBy("node").agg(F.min(F.struct("far", "leader")).alias("x"), F.max_by("leader", F.struct(-F.col("far"), "leader")).alias("y"))
    star = star.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("x.leader", "y"))).alias("b"))
    star = materialize(star, "star")
    labels = relabel(near.withColumn("comp", F.col("node")), confirm(star, texts, words, percent))
    discard(near, star)
    close = materialize(candidates(rows.join(labels, "node"), wanted, percent), "close")
    discard(rows)
    sets = materialize(sets_of(texts.join(close.select("node").distinct(), "node", "left_semi"), words), "sets")
    links = materialize(linked(close.join(labels, "node"), wanted.join(sets, "node"), percent), "links")
    discard(close, sets)
    labels = relabel(labels, links)
    discard(wanted)
    drop_texts()
    classes = nodes.select("node", F.col("doc").alias("least")).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = classes.groupBy("comp").agg(F.min("least").alias("component"))
    classes = classes.join(lowest, "comp").select("node", "component")
    out = sigs.select("doc", "node", "n").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"))


def long_signatures(texts: DataFrame, words: int) -> DataFrame:
    """``(node, long)`` of ``texts(node, text)``."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(*utf8_buffer(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([long_signature(s) for s in sets], pa.binary())], ["node", "long"])

    return map_arrow(texts.select("node", "text"), run, "node long, long binary")


def named_texts(df: DataFrame, words: int) -> DataFrame:
    """``(node, text)`` of ``df(doc, text)``."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(*utf8_buffer(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), batch.column(1)], ["node", "text"])

    return map_arrow(df, run, "node long, text string").where("node is not null")
