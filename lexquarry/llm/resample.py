"""Target-distribution importance resampling by hashed word n-grams.

Words of a block of texts become ids, the block's suffixes are sorted by their
first ``depth`` words, and the lengths of neighbours' common prefixes (LCP) part
them into runs: a run at length n is one n-gram with all its occurrences. Each
run is hashed once and its bucket is scattered back to where the n-gram stands.
Counts of buckets leave a task as one row a bucket; the gains of all buckets (a
parameter bounds them) go back with the scoring code, which reads the texts once
more, so nothing of the texts' size is ever written. The draw is a distributed
sort: places within range partitions plus the sizes of the partitions before.

Null and empty texts, and texts without a word, have no features, weight 0 and no
rank. A null id is drawn as the text ``<seed>:`` and comes last among equals. Rows
that repeat an id or a text count and are ranked one by one. Other columns of the
input are passed over; an empty table gives an empty result. A text is never cut:
one longer than a block is a block of its own, in about 100 bytes a word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import discard, map_arrow, materialize, row_bytes, utf8_buffer

#: Bytes of texts whose suffixes are sorted together.
BLOCK_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words: digits, small letters and all of code points beyond ASCII.
_INSIDE = np.zeros(256, bool)
for _first, _last in (("0", "9"), ("a", "z")):
    _INSIDE[ord(_first) : ord(_last) + 1] = True
_INSIDE[128:] = True


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together until a block's texts (the last column) reach ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += int(np.sum(row_bytes(batch.column(batch.num_columns - 1))))
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def words_of(raw: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: their words with one space after each, where each word begins in these bytes (and their end), words before each text.

    No word goes over a text's end.
    """
    low = _LOWER[raw]
    inside = _INSIDE[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ptr[:-1][ptr[:-1] < ptr[1:]]
    begins[heads] = inside[heads]
    upto = np.concatenate(([0], np.cumsum(begins)))
    word = upto[1:][inside] - 1
    n = int(upto[-1])
    data = np.full(len(word) + n, ord(" "), np.uint8)
    data[np.arange(len(word)) + word] = low[inside]
    starts = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=n) + 1))).astype(np.int64)
    return data, starts, upto[ptr]


def word_ids(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number from 1 for each word, the same for equal words."""
    n = len(starts) - 1
    column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(starts), pa.py_buffer(data)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64) + 1


def suffix_runs(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array by the first ``depth`` words, and each suffix's common words with the one before it.

    left: how many words a suffix has within its text.
    """
    n = len(ids)
    nth = np.zeros((depth, n), np.int64)
    for k in range(min(depth, n)):
        nth[k, : n - k] = np.where(left[: n - k] > k, ids[k:], 0)
    order = np.lexsort(nth[::-1])
    common, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for k in range(depth):
        here = nth[k][order]
        same &= (here[1:] == here[:-1]) & (here[1:] > 0)
        common[1:] += same
    return order, common


def bucket_ids(data: np.ndarray, starts: np.ndarray, upto: np.ndarray, depth: int, buckets: int) -> list[np.ndarray]:
    """For n from 1 to ``depth``: the bucket of the n-gram that begins at each word, -1 where the text ends before."""
    n = len(starts) - 1
    left = np.repeat(upto[1:], np.diff(upto)) - np.arange(n)
    order, common = suffix_runs(word_ids(data, starts), left, depth)
    view, out = memoryview(data.tobytes()), []
    for k in range(1, depth + 1):
        at = left[order] >= k
        where, opens = order[at], (common < k)[at]
        first = where[opens]
        hashed = [zlib.crc32(view[a:b]) % buckets for a, b in zip(starts[first].tolist(), (starts[first + k] - 1).tolist())]
        found = np.full(n, -1, np.int64)
        found[where] = np.array(hashed, np.int64)[np.cumsum(opens) - 1] if len(where) else 0
        out.append(found)
    return out


def bucket_counts(docs: DataFrame, text_col: str = "text", depth: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for block in blocks(batches):
            for found in bucket_ids(*words_of(*utf8_buffer(block.column(0))), depth, buckets):
                total += np.bincount(found[found >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = map_arrow(docs.select(F.col(text_col).alias("text")), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(how much likelier a bucket is in the target)), each count raised by one."""
    n = len(source)
    all_source, all_target = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_source + n) / (float(s + 1) * float(all_target + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def feature_weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", depth: int = 2) -> DataFrame:
    """``(id, n_words, n_features, weight)``: the floored mean of the gains of a text's features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, starts, upto = words_of(*utf8_buffer(block.column(1)))
            n, total = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
            for found in bucket_ids(data, starts, upto, depth, len(gains)):
                there = found >= 0
                for sums, x in ((n, there), (total, np.where(there, gains[found], 0))):
                    sums += np.diff(np.concatenate(([0], np.cumsum(x)))[upto])
            yield pa.RecordBatch.from_arrays([block.column(0), *map(pa.array, (np.diff(upto), n, total // np.maximum(n, 1)))], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), score, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """The id's own noise, in thousandths, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", depth: int = 2, buckets: int = 10_000, min_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """Every row's ``(id, n_features, weight, score, rank)``; rank numbers the drawn rows, the best first, and is null for others."""
    gains = bucket_gains(bucket_counts(docs, text_col, depth, buckets), bucket_counts(target, target_col, depth, buckets))
    weights = feature_weights(docs, gains, id_col, text_col, depth)
    fit = (F.col("n_words") >= min_words).alias("fit")
    scored = materialize(weights.select("id", "n_features", "weight", (F.col("weight") + gumbel(F.col("id"), seed)).alias("score"), fit), "scored")
    drawn = percent * scored.where("fit").count() // 100
    by = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("id")]
    ordered = materialize(scored.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "ordered")
    discard(scored)
    part = F.shiftright("place", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row a partition
    before, at = [], 0
    for row in sizes:
        before.append((row["part"], at))
        at += row["n"]
    starts = ordered.sparkSession.createDataFrame(before, "part long, before long")
    placed = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))
