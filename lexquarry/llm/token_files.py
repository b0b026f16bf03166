"""Token ids as flat binary files.

Documents are range-partitioned by id and sorted; every partition writes three
files into a folder that all executors share:

* ``part-N.ids``: the ids of all its documents as little-endian unsigned
  integers of 16 or 32 bits, after each document the end id;
* ``part-N.offsets``: 64-bit offsets of its documents, counted in ids from the
  partition's start, with the end as last value;
* ``part-N.docs``: the documents' own ids (64 bit), and a byte each that is 0
  where that id is null.

A task writes under a name of its own and renames at the end, so a repeated or
speculative task cannot leave half a file. One manifest row a partition comes
back; prefix sums over them give each partition's base.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import map_arrow, materialize, remove, shared_dir
from lexquarry.llm.pieces import Bytes, PieceCache

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Documents whose offsets, and ids of one document, that are read at once.
DOCS_AT_ONCE, IDS_AT_ONCE = 10_000, 1 << 20
MANIFEST = "part int, n_docs long, n_ids long, stem string, width int"


def byte_alphabet() -> dict[str, int]:
    """The byte of every character that stands for one in a byte-level vocabulary.

    Bytes that print as Latin-1 characters stand for themselves, the others, in their order, are written from U+0100 on.
    """
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


class Library:
    """The tokenizers library, its ordinary texts behind a cache of pieces.

    Texts that hold one of the vocabulary's special strings are encoded by the library as they are.
    """

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.size = self.tokenizer.get_vocab_size()
        added = {} if special_as_text else self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        alphabet = byte_alphabet()
        words = [self.tokenizer.id_to_token(i) or "" for i in range(self.size)]
        self.cache = PieceCache(self.encode, Bytes([bytes(alphabet[c] for c in w) if all(c in alphabet for c in w) else w.encode() for w in words]))

    def encode(self, texts: list[str], step: int = 4000) -> list[list[int]]:
        return [x.ids for i in range(0, len(texts), step) for x in self.tokenizer.encode_batch_fast(texts[i : i + step], add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids start (and the end)."""
        alone = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        if not alone:
            return self.cache(texts)
        ids, ptr = self.cache(["" if i in alone else t for i, t in enumerate(texts)])
        own = np.split(ids, ptr[1:-1])
        for i, x in zip(alone, self.encode([texts[i] for i in alone])):
            own[i] = np.array(x, np.uint32)
        return np.concatenate(own), np.cumsum([0, *map(len, own)])


@functools.cache
def library(path: str, special_as_text: bool) -> Library:
    return Library(path, special_as_text)


class Flat:
    """A file of numbers whose slices are read as they are asked for: through a memory map, or piece by piece from a store that is not local."""

    def __init__(self, store: fs.FileSystem, path: str, kind: str):
        self.kind = np.dtype(kind)
        self.file = None if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.map = np.memmap(path, self.kind, "r") if self.file is None else None
        self.size = len(self.map) if self.file is None else self.file.size() // self.kind.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.file is None:
            return np.array(self.map[part])
        n = max(0, min(part.stop, self.size) - part.start)
        return np.frombuffer(self.file.read_at(n * self.kind.itemsize, part.start * self.kind.itemsize), self.kind)


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """Write the files and return the manifest ``(part, n_docs, n_ids, stem, width, base)``.

    Order: ascending id, nulls first, rows of one id by their text's hash.
    Empty and null texts hold the end id only. An empty table gives an empty
    manifest. Other columns are not read. special_as_text: the vocabulary's
    special strings in a text are ordinary text; else they are their own ids, as
    the library has it.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        encode = library(path, special_as_text)
        width = 2 if max(encode.size - 1, end_id) < 1 << 16 else 4
        part = TaskContext.get().partitionId()
        stem = f"part-{part:06d}"
        store, root = fs.FileSystem.from_uri(folder)
        names = {k: f"{root}/.{uuid.uuid4().hex}.{k}" for k in ("ids", "offsets", "docs", "valid")}
        outs, docs, total = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            if outs is None:
                store.create_dir(root)
                outs = {k: store.open_output_stream(v) for k, v in names.items()}
                outs["offsets"].write(np.zeros(1, "<i8").tobytes())
            ids, ptr = encode([x or "" for x in batch.column(1).to_pylist()])
            n = len(batch)
            flat = np.full(len(ids) + n, end_id, f"<u{width}")
            lengths = np.diff(ptr)
            flat[np.arange(len(ids)) + np.repeat(np.arange(n), lengths)] = ids
            outs["ids"].write(flat.tobytes())
            outs["offsets"].write((total + np.cumsum(lengths + 1)).astype("<i8").tobytes())
            outs["docs"].write(np.asarray(batch.column(0).cast(pa.int64()).fill_null(0)).astype("<i8").tobytes())
            outs["valid"].write(np.asarray(batch.column(0).is_valid()).astype("u1").tobytes())
            docs, total = docs + n, total + len(flat)
        if outs is not None:
            for k, out in outs.items():
                out.close()
                store.move(names[k], f"{root}/{stem}.{k}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [docs], "n_ids": [total], "stem": [stem], "width": pa.array([width], pa.int32())})

    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange("doc", "h").sortWithinPartitions("doc", "h").select("doc", "text")
    manifest = materialize(map_arrow(rows, run, MANIFEST), "manifest")
    # One row a partition: prefix sums over them are a small job.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Read the files through memory maps, a task a partition: ``(id, start, n_tokens, ids_crc32)`` a document.

    A store that is not local is read in pieces of DOCS_AT_ONCE offsets and IDS_AT_ONCE ids.
    """

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)

        for batch in batches:
            for row in batch.to_pylist():
                n, path = row["n_docs"], f"{root}/{row['stem']}"
                ids, offsets, docs, valid = (Flat(store, f"{path}.{name}", kind) for name, kind in (("ids", f"<u{row['width']}"), ("offsets", "<i8"), ("docs", "<i8"), ("valid", "u1")))
                for i in range(0, n, DOCS_AT_ONCE):
                    j = min(i + DOCS_AT_ONCE, n)
                    ends = offsets[i : j + 1]
                    crc = []
                    for a, b in zip(ends.tolist(), ends[1:].tolist()):
                        sum_ = 0
                        for at in range(a, b, IDS_AT_ONCE):
                            sum_ = zlib.crc32(ids[at : min(b, at + IDS_AT_ONCE)].astype("<u4").tobytes(), sum_)
                        crc.append(sum_)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[i:j], pa.int64(), mask=valid[i:j] == 0), pa.array(row["base"] + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                        [id_col, "start", "n_tokens", "ids_crc32"],
                    )

    parts = max(1, manifest.count())
    return manifest.repartitionByRange(parts, "part").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write all documents into a new folder of the shared directory and read them back.

    A null or empty text has its end id alone. Rows that repeat an id, or have
    none, are documents of their own. An empty table gives no rows. Texts of any
    length are encoded whole; only the two named columns are read. The files are
    deleted once they were read; ``write`` and ``read`` keep theirs.
    """
    folder = shared_dir(df.sparkSession)
    folder = folder if "://" in folder or folder.startswith("/") else os.path.abspath(folder)
    folder = f"{folder}/lexquarry/tokens-{uuid.uuid4().hex}"
    found = materialize(read(write(df, folder, id_col, text_col, path), folder, id_col), "tokens-read")
    remove(df.sparkSession, folder)
    return found
