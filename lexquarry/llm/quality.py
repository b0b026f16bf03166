"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed with array operations. Trees of one
depth are grown on histograms of binned statistics in numpy, and flattened into
arrays: all documents walk all trees level by level with array indexing.

Training sees a bounded sample of at most SAMPLE_ROWS labelled documents, chosen
by a hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import discard, held_out, map_arrow, materialize, utf8_buffer
from lexquarry.llm.near_dedup import _BLANK, _TO_LOWER
from lexquarry.llm.pieces import slice_hashes

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH = 60, 4, 64, 0.2, 1.0

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "blanks", "newlines", "signs", "non_ascii", "control",
    "top_sign", "entropy", "distinct_words", "doubled_words", "shouted_words", "ended_words", "line_bytes", "repeated_lines", "long_words", "colons", "bars",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN &= ~(_LETTER | _DIGIT)


def distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each of ``n`` documents has."""
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n)


def statistics(data: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """(documents, statistics) of texts in one buffer; an empty text has zeros."""
    n = len(ptr) - 1
    if len(data) == 0:
        return np.zeros((n, len(STATISTICS)), np.float32)
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ptr] = True
    begins, finishes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    finishes[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    words, of_word = slice_hashes(_TO_LOWER[data], starts, ends), np.searchsorted(ptr, starts, "right") - 1
    lengths = ends - starts
    uppers = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shouted = (uppers[ends] - uppers[starts]) * 2 > lengths
    doubled = np.zeros(len(words), bool)
    doubled[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    line_ends = np.flatnonzero((data == 10) | edge[1:])
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    lines = slice_hashes(data, line_starts, line_ends + (data[line_ends] != 10))  # a text's last line may have no line break
    of_line = np.searchsorted(ptr, line_starts, "right") - 1

    sizes = np.diff(ptr)
    counts = np.bincount(np.repeat(np.arange(n) * 256, sizes) + data, minlength=n * 256).reshape(n, 256)
    size, n_words, n_lines = np.maximum(sizes, 1), np.bincount(of_word, minlength=n), np.bincount(of_line, minlength=n)
    k, m = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    share = counts / size[:, None]
    entropy = -(share * np.log(np.where(counts > 0, share, 1))).sum(1)

    def words_that(are: np.ndarray) -> np.ndarray:
        return np.bincount(of_word[are], minlength=n) / k

    def bytes_in(kind) -> np.ndarray:
        return counts[:, kind].sum(1) / size

    out = (
        np.log1p(size), np.log1p(n_words), np.bincount(of_word, lengths, n) / k, bytes_in(_LETTER), bytes_in(_UPPER), bytes_in(_DIGIT), bytes_in([32]), bytes_in([10]),
        bytes_in(_SIGN), bytes_in(slice(128, 256)), bytes_in(slice(0, 9)), counts[:, _SIGN].max(1) / size, entropy, distinct(words, of_word, n) / k,
        words_that(doubled), words_that(shouted), words_that(_SIGN[data[ends - 1]]), np.log1p(size / m), 1 - distinct(lines, of_line, n) / m, words_that(lengths > 30), bytes_in([58]), bytes_in([124]),
    )
    return np.where((sizes > 0)[:, None], np.stack(out, 1), 0).astype(np.float32)


class Forest:
    """Trees as arrays: split statistic and bin of each inner node, value of each leaf."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges, self.base = edges, 0.0
        self.feature = np.zeros((0, (1 << DEPTH) - 1), np.int16)
        self.cut = np.zeros((0, (1 << DEPTH) - 1), np.int16)
        self.value = np.zeros((0, 1 << DEPTH))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def leaves(self, bins: np.ndarray, tree: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (bins[rows, self.feature[tree, at]] > self.cut[tree, at])
        return at - ((1 << DEPTH) - 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for t in range(len(self.feature)):
            total += self.value[t, self.leaves(bins, t)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss; constant labels give a constant score."""
    forest = Forest([np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])])
    mean = (y.sum() + 1) / (len(y) + 2)
    forest.base = float(np.log(mean / (1 - mean)))
    if len(np.unique(y)) < 2:
        return forest
    bins, score, n, m = forest.bins(x), np.full(len(y), forest.base), len(y), x.shape[1]
    offsets = np.arange(m) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros((1 << DEPTH) - 1, np.int16), np.full((1 << DEPTH) - 1, BINS, np.int16)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width, first = 1 << level, (1 << level) - 1
            slots = ((node[:, None] * m * BINS) + offsets + bins).reshape(-1)
            hist = [np.bincount(slots, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS).cumsum(2) for v in (g, h)]
            gl, hl = hist
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[first : first + width] = best // BINS
            cut[first : first + width] = np.where(good, best % BINS, BINS)
            node = 2 * node + (bins[np.arange(n), feature[first + node]] > cut[first + node])
        value = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + SMOOTH)
        score += value[node]
        forest.feature, forest.cut, forest.value = (np.concatenate([a, b[None]]) for a, b in ((forest.feature, feature), (forest.cut, cut), (forest.value, value)))
    return forest


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x array<float>)`` of every whole text (null: empty)."""

    def run(batches):
        for batch in batches:
            x = statistics(*utf8_buffer(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATISTICS)), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "x"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, x array<float>")


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row of ``df``.

    Learns from labelled ids outside the held-out third only; labels other than 0
    and 1, null labels and null ids are passed over. Without labels of both kinds
    the score is the labels' smoothed mean (0.5 without any). Empty and null
    texts are scored from zero statistics. Repeated rows give repeated results, an
    empty table none. Statistics are those of whole texts, however long; other
    columns than those named are not read.
    """
    stats = materialize(document_statistics(df, id_col, text_col), "statistics")
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    n = known.count()
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53) < 1.2 * SAMPLE_ROWS / max(1, n))  # so that only about as many rows are sorted
    sample = drawn.orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE_ROWS)
    rows = stats.join(F.broadcast(sample), "id").orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE_ROWS).select("y", "x").toPandas()  # at most SAMPLE_ROWS of some 100 bytes
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), len(STATISTICS))
    forest = grow(x, rows["y"].to_numpy(float))

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(len(batch), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(x))], ["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    scored = materialize(map_arrow(stats, run, f"id {kind}, score double"), "scores")
    discard(stats)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
