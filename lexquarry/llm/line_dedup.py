"""Corpus-wide line deduplication by range-partitioned, sorted line hashes.

Each line's key (stripped at both ends, A-Z lower-cased) becomes a hash of 96
bits with its document and position. Rows are range-partitioned by hash and
document and sorted by hash, document and position, so a task streams through
runs of equal keys: it sees each run's first occurrence and counts its
documents. Because the range is over (hash, document), a key that holds a third
of all lines spreads over many tasks; a run that may go on in a neighbouring
partition is settled by adding up the counts of at most two open runs a
partition. What comes back is one compressed keep bitmap a document, never text;
texts meet the bitmaps only where a caller wants the lines that stay.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import WHITESPACE, carried, lower_ascii, map_arrow, materialize

KEEP, DROP, OPEN = 0, 1, 2
#: Keys of documents that lose lines are broadcast up to this many (16 bytes each); more of them are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
KEY = ["doc", "tie"]


def keyed(df: DataFrame, id_col: str, text_col: str, extra: list | None = None) -> DataFrame:
    """``(id, text, doc, tie)``: a document is told apart by its id and its text, so rows may share an id or have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).try_cast("long"), F.lit(-(2**63)))
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), doc.alias("doc"), F.xxhash64(F.col(id_col), F.lit(5), text).alias("tie"), *(extra or []))


def line_rows(docs: DataFrame) -> DataFrame:
    """``(doc, tie, n_lines, pos, h, g)`` of every line whose key has a character; ``docs(doc, tie, text)``."""
    lines = docs.select(*KEY, F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lines = lines.select(*KEY, F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    lines = lines.select(*KEY, "n_lines", "pos", lower_ascii(F.btrim("line", F.lit(WHITESPACE))).alias("key"))
    return lines.where("key <> ''").select(*KEY, "n_lines", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column; the first one does."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))


def stream_runs(sorted_rows: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """The rows to drop, and all rows of runs that touch a partition's edge, with ``state`` and ``docs``.

    State DROP: the row goes. State OPEN: its run may go on elsewhere; ``docs``
    is 1 on the first row of each document in it, so that a sum counts documents
    (a document's lines of one key are never in two partitions). Equal rows come
    out once.
    """

    def run(batches):
        held: pa.Table | None = None
        at_edge = True  # no run has ended yet: the first one is open

        def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
            return [np.asarray(table[c]) for c in names]

        def settle(table: pa.Table, last: bool, at_edge: bool):
            h, g, doc, tie = columns(table, "h", "g", *KEY)
            new = changes(h, g)
            new_doc = changes(h, g, doc, tie)
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, len(h)))
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            state = np.where(docs >= min_docs, DROP, KEEP)
            if at_edge:
                state[0] = OPEN
            if last:
                state[-1] = OPEN
            states = np.repeat(state, lengths)
            if keep_first:
                states[starts[states[starts] == DROP]] = KEEP
            out = table.append_column("state", pa.array(states.astype(np.int32))).append_column("docs", pa.array(new_doc.astype(np.int32)))
            return out.filter(pa.array(states != KEEP)).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None and len(held):
                table = pa.concat_tables([held, table])
            table = table.filter(pa.array(changes(*columns(table, "h", "g", *KEY, "pos"))))
            if not len(table):
                continue
            h, g, doc, tie = columns(table, "h", "g", *KEY)
            tail = int(np.flatnonzero(changes(h, g)).max())
            if at_edge and tail == 0:
                # One run fills the partition so far: its rows are open anyway, so they can leave, except the last document's.
                tail = int(np.flatnonzero(changes(doc, tie)).max())
                if tail:
                    yield from settle(table.slice(0, tail), True, True)
            elif tail:
                yield from settle(table.slice(0, tail), False, at_edge)
                at_edge = False
            held = table.slice(tail).combine_chunks()
        if held is not None and len(held):
            yield from settle(held, True, at_edge)

    return map_arrow(sorted_rows, run, "doc long, tie long, n_lines int, pos int, h long, g int, state int, docs int")


def dropped_positions(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """``(doc, tie, n_lines, drop array<int>)`` of every row of ``docs(doc, tie, text)`` that loses lines."""
    rows = materialize(line_rows(docs), "lines")  # so that finding the ranges reads hashes only, and texts are split once
    rows = rows.repartitionByRange("h", "g", *KEY).sortWithinPartitions("h", "g", *KEY, "pos")
    runs = materialize(stream_runs(rows, min_docs, keep_first), "line-runs")
    open_ = runs.where(F.col("state") == OPEN)
    counts = open_.groupBy("h", "g").agg(F.sum("docs").alias("n"), F.min(F.struct(*KEY, "pos")).alias("first")).where(F.col("n") >= min_docs)
    late = open_.join(F.broadcast(counts), ["h", "g"])  # at most two rows a partition
    if keep_first:
        late = late.where(F.struct(*KEY, "pos") != F.col("first"))
    gone = runs.where(F.col("state") == DROP).select(*KEY, "n_lines", "pos").union(late.select(*KEY, "n_lines", "pos"))
    return gone.groupBy(*KEY).agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("drop"))


def keep_bitmap(n_lines: int, drop: np.ndarray) -> bytes:
    """zlib-compressed bitmap, bit i (little-endian) set if line i stays."""
    keep = np.ones(n_lines, bool)
    keep[drop] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def apply_bitmap(text: str, bitmap: bytes) -> str:
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines), bitorder="little")
    return "\n".join(line for line, k in zip(lines, keep) if k)


def shortened(docs: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """``(doc, tie, n_lines, n_dropped, bitmap)`` of every row of ``docs(doc, tie, text)`` that loses lines."""

    def run(batches):
        for batch in batches:
            drops = [np.asarray(d.values) for d in batch.column(3)]
            bitmaps = [keep_bitmap(n, d) for n, d in zip(batch.column(2).to_pylist(), drops)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(d) for d in drops], pa.int32()), pa.array(bitmaps, pa.binary())], [*KEY, "n_lines", "n_dropped", "bitmap"])

    return map_arrow(dropped_positions(docs, min_docs, keep_first), run, "doc long, tie long, n_lines int, n_dropped int, bitmap binary")


def line_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """``(id, n_lines, n_dropped, bitmap)``: which lines of each document stay; no text is shuffled.

    A line goes if its key (white space of ``[\\x20\\x09-\\x0D]`` stripped at both
    ends, A-Z lower-cased, at least one character) is found in at least
    ``min_docs`` documents; with keep_first its first occurrence by document and
    position stays. A null or empty text is one empty line and stays. Documents
    are told apart by id and text: rows that share an id but not the text are
    documents of their own, as are those without an id; rows that repeat both
    are one document and have equal results. Only the two named columns are
    read. An empty table gives no rows.
    """
    docs = keyed(df, id_col, text_col)
    short = shortened(docs.select(*KEY, "text"), min_docs, keep_first).select(*KEY, "n_dropped", "bitmap")
    every = docs.select("id", *KEY, F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines")).join(short, KEY, "left")

    def run(batches):
        for batch in batches:
            maps = [b or keep_bitmap(n, np.zeros(0, np.int64)) for n, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), batch.column(2).cast(pa.int64()).fill_null(0), pa.array(maps, pa.binary())], ["id", "n_lines", "n_dropped", "bitmap"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(every.select("id", "n_lines", "n_dropped", "bitmap"), run, f"id {kind}, n_lines long, n_dropped long, bitmap binary").withColumnRenamed("id", id_col)


def split_by_loss(df: DataFrame, id_col: str, text_col: str, min_docs: int, keep_first: bool, extra: list) -> tuple[DataFrame, DataFrame | None]:
    """Documents with what they lose (``n_lines, n_dropped, bitmap``; null for nothing), and apart from them, without a shuffle, those that lose nothing."""
    docs = keyed(df, id_col, text_col, extra)
    short = materialize(shortened(docs.select(*KEY, "text"), min_docs, keep_first), "bitmaps")
    if short.count() > BROADCAST_KEYS:
        return docs.join(short, KEY, "left"), None
    keys = F.broadcast(short.select(*KEY))
    return docs.join(keys, KEY, "left_semi").join(short, KEY), docs.join(keys, KEY, "left_anti")


def kept_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents without the lines that go by ``line_bitmaps``, and the columns to carry along (a null text stays null)."""
    extra = carried(df, carry)
    extra_names = extra.names
    some, rest = split_by_loss(df, id_col, text_col, min_docs, keep_first, extra.columns)

    def run(batches):
        for batch in batches:
            texts = [t if b is None else apply_bitmap(t, b) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[3:]], ["id", "text", *extra_names])

    kind = df.schema[id_col].dataType.simpleString()
    out = map_arrow(some.select("id", "text", "bitmap", *extra_names), run, f"id {kind}, text string" + extra.schema)
    if rest is not None:
        out = out.union(rest.select("id", "text", *extra_names))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *extra.back)


def kept_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """``(id, n_lines, n_dropped, kept_sha256)`` of every document, by the rule of ``line_bitmaps``."""
    some, rest = split_by_loss(df, id_col, text_col, min_docs, keep_first, [])

    def run(batches):
        for batch in batches:
            texts, maps = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            said = [hashlib.sha256(((t or "") if b is None else apply_bitmap(t, b)).encode()).hexdigest() for t, b in zip(texts, maps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(said, pa.string())], ["id", "n_lines", "n_dropped", "kept_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    n_lines, none = F.size(F.split(text, "\n")).cast("long"), F.lit(0).cast("long")
    some = some.select("id", "text", F.coalesce(F.col("n_lines").cast("long"), n_lines).alias("n_lines"), F.coalesce(F.col("n_dropped").cast("long"), none).alias("n_dropped"), "bitmap")
    out = map_arrow(some, run, f"id {kind}, n_lines long, n_dropped long, kept_sha256 string")
    if rest is not None:
        out = out.union(rest.select("id", n_lines.alias("n_lines"), none.alias("n_dropped"), F.sha2(text.cast("binary"), 256).alias("kept_sha256")))
    return out.withColumnRenamed("id", id_col)
