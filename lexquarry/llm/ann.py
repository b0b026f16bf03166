"""Maximum inner product search with score-aware quantisation.

A vector is its nearest coarse centre and a rest. Rests are brought to one length, so
that vectors that lie very close together still differ in their codes, and are
quantised by 16 centres (4 bits) a dimension. Codes and centres
minimise an anisotropic loss: the part of the residual
that is parallel to the vector weighs more than the rest, because it is what moves
large inner products. How much more follows from the number of dimensions and the
cosine THRESHOLD from which on products matter. A query makes a table of 16 products
a dimension; two tables merge into one of 256, so a scan adds one looked-up
number for every byte of code (the first byte is the coarse centre). A factor that
comes with the code makes up for the parallel part that is left.

With its code a vector keeps the length of what its code leaves out. This bounds how
far the scan can be off: what is left out is at a right angle to the vector, so it can
add the less, the smaller the angle between query and vector. The best of
the scan are scored exactly, in double precision, on the original vectors; so is
every other vector whose bound reaches the k-th best of these. The
result is that of brute force, whatever the vectors; only the number scored exactly
depends on them.

The quantiser is fitted on at most FIT_ROWS vectors, chosen by a hash; every vector
is encoded once, where it is read. Queries meet all vectors and their codes in blocks,
a task holding one block of either, and only a query's k best of a block leave
it. Vectors of different lengths have no product and are searched apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import discard, map_arrow, materialize

FIT_ROWS = 8_000
SWEEPS = 4
#: Coarse centres, 256 at most, and vectors of the sample for each at least.
COARSE, COARSE_ROWS = 256, 8
#: The cosine from which on inner products matter.
THRESHOLD = 0.2
#: Vectors and queries of one block, and bytes of either, at most (on average: they are dealt by hash).
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_BYTES = 65_536, 32_768, 16 << 20
#: The fewest vectors and queries of one block that are worth a further task.
FEW_ROWS, FEW_QUERIES = 2_048, 256
#: The best of a block's scan, whose k-th exact score the bounds of all others must reach.
RERANK = 400
#: Queries of one scan, and vectors and exact scores computed at once.
SCAN_QUERIES, SCAN_ROWS = 32, 4_096
#: More than a number of single and of double precision is off by rounding, as a part of it.
EPS, EPS_DOUBLE = 1.2e-7, 2.3e-16
#: Below this products of double precision vectors may be rounded to equal ones, which no bound tells: all are scored.
UNDERFLOW = 1e-290


def coarse_centres(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by k-means. They begin at vectors that are far from those chosen before, so that each cluster gets one."""
    chosen = [x[rng.integers(len(x))]]
    far = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < n and far.sum() > 0:
        chosen.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(1))
    centres = np.array(chosen)
    for _ in range(SWEEPS):
        of = nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        count = np.bincount(of, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)


class Quantiser:
    def __init__(self, sample: np.ndarray, seed: int = 3):
        self.dims = sample.shape[1]
        self.parallel = max(1.0, (self.dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        self.parts = self.dims + self.dims % 2
        self.scale = 2.0 ** min(1000, np.frexp(np.abs(sample).max())[1])  # single precision holds what is divided by it
        sample = sample / self.scale
        rng = np.random.default_rng(seed)
        self.coarse = coarse_centres(sample, max(1, min(COARSE, len(sample) // COARSE_ROWS)), rng)
        x, unit, _, _ = self._rests(sample)
        self.centres = np.quantile(x, (np.arange(16) + 0.5) / 16, axis=0).T.copy()  # (parts, 16)
        for plain in [True] * SWEEPS + [False] * SWEEPS:
            self._fit(x, unit, plain)

    def _rests(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors less their coarse centres, brought to one length; the vectors' directions; these centres; the rests' scales."""
        of = nearest_centre(x, self.coarse)
        rests = x - self.coarse[of]
        scale = np.sqrt((rests**2).mean(1))
        norm = np.sqrt((x**2).sum(1))
        return self._padded(rests / np.where(scale > 0, scale, 1)[:, None]), self._padded(x / np.where(norm > 0, norm, 1)[:, None]), of, scale

    def _padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts), np.float64)
        out[:, : self.dims] = x
        return out

    def _rebuilt(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(self.parts), codes]

    def _assign(self, x: np.ndarray, unit: np.ndarray, plain: bool = False, sweeps: int = 2) -> np.ndarray:
        """Codes of rests by coordinate descent on the anisotropic loss along the vectors' directions (plain: nearest centres)."""
        codes = np.empty((len(x), self.parts), np.int64)
        for m in range(self.parts):
            codes[:, m] = np.abs(x[:, m, None] - self.centres[m]).argmin(1)
        if plain:
            return codes
        along = (x - self._rebuilt(codes)) * unit  # how much of each dimension's residual is parallel to the vector
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(self.parts):
                r = x[:, m, None] - self.centres[m]
                dot = r * unit[:, m, None]
                rest = total - along[:, m]
                codes[:, m] = (r**2 + (self.parallel - 1) * (rest[:, None] + dot) ** 2).argmin(1)
                along[:, m] = dot[np.arange(len(x)), codes[:, m]]
                total = rest + along[:, m]
        return codes

    def _fit(self, x: np.ndarray, unit: np.ndarray, plain: bool) -> None:
        """Centres that minimise the loss (plain: the distance), given the codes."""
        codes = self._assign(x, unit, plain, sweeps=1)
        weight = 0.0 if plain else self.parallel - 1
        along = (x - self._rebuilt(codes)) * unit
        rest = along.sum(1, keepdims=True) - along
        for m in range(self.parts):
            u, v = unit[:, m], x[:, m]
            a = np.bincount(codes[:, m], 1 + weight * u * u, 16)
            b = np.bincount(codes[:, m], v + weight * u * (rest[:, m] + u * v), 16)
            self.centres[m, a > 0] = b[a > 0] / a[a > 0]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(vectors, 1 + parts / 2 + 40) bytes: the coarse centre, two codes each, and five numbers.

        These are the factors of the centre and of the rest, the length of the residual, the
        vector's length, and a margin: the residual along the vector, next to nothing with
        these factors, and rounding in a scan.
        """
        with np.errstate(all="ignore"):  # what does not fit gets no finite bound and is scored exactly
            x = x / self.scale
            rests, unit, of, scale = self._rests(x)
            codes = self._assign(rests, unit)
            centre, rest = self.coarse[of], self._rebuilt(codes)[:, : self.dims]
            own, made = (x * x).sum(1), (x * (centre + scale[:, None] * rest)).sum(1)
            factor = np.where(made > own / 2, own / np.where(made > own / 2, made, 1), 1)
            of_rest = factor * scale
            left = x - factor[:, None] * centre - of_rest[:, None] * rest
            length, off = np.sqrt(own), np.sqrt((left * left).sum(1))
            along = np.abs((left * unit[:, : self.dims]).sum(1))
            widest = np.sqrt((self.centres**2).max(1).sum())
            double = 4 * (self.dims + 12) * EPS_DOUBLE * (length + off + factor * np.sqrt((centre**2).sum(1)))
            margin = along + (self.parts // 2 + 12) * EPS * of_rest * widest + double
        numbers = np.column_stack([factor, of_rest, off, length, margin])
        return np.column_stack([of.astype(np.uint8), (codes[:, ::2] * 16 + codes[:, 1::2]).astype(np.uint8), numbers.view(np.uint8)])

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, vectors), in units of ``scale``."""
        table = (self._padded(queries).T[:, None, :] * self.centres[:, :, None]).astype(np.float32)  # (parts, 16, queries)
        pairs = (table[::2, :, None] + table[1::2, None, :]).reshape(-1, 256, len(queries))
        first = self.coarse @ queries.T
        numbers = numbers_of(codes)
        out = np.empty((len(queries), len(codes)))
        for at in range(0, len(codes), SCAN_ROWS):
            columns = codes[at : at + SCAN_ROWS, :-40].T.astype(np.intp)
            total, one = np.zeros((2, columns.shape[1], len(queries)), np.float32)
            for m in range(len(pairs)):
                total += np.take(pairs[m], columns[m + 1], 0, out=one, mode="clip")
            of_centre, of_rest = numbers[:2, at : at + SCAN_ROWS, None]
            out[:, at : at + SCAN_ROWS] = (np.take(first, columns[0], 0) * of_centre + total * of_rest).T
        return out


def numbers_of(codes: np.ndarray) -> np.ndarray:
    """The five numbers of ``encode``, one a row."""
    return np.ascontiguousarray(codes[:, -40:]).view(np.float64).T.copy()


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims)


def distinct(ids: np.ndarray, h: np.ndarray, g: np.ndarray, copies: int) -> np.ndarray:
    """Places of different rows, by id; of equal vectors only those with the smallest ids."""
    order = np.lexsort((ids, g, h))
    i, h, g = ids[order], h[order], g[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])][: len(i)]
    new = fresh | np.r_[True, i[1:] != i[:-1]][: len(i)]
    nth = np.cumsum(new)
    nth -= np.maximum.accumulate(np.where(fresh, nth, 0)) - 1
    kept = order[new & (nth <= copies)]
    return kept[np.argsort(ids[kept], kind="stable")]


def exact(x: np.ndarray, q: np.ndarray, some: np.ndarray) -> np.ndarray:
    slices = [some[at : at + SCAN_ROWS] for at in range(0, len(some), SCAN_ROWS)]
    return np.concatenate([np.zeros(0), *(np.einsum("ij,j->i", x[s].astype(np.float64), q) for s in slices)])


def within(guess: np.ndarray, off: np.ndarray, length: np.ndarray, margin: np.ndarray, least: float) -> np.ndarray:
    """Places whose product with a query of length 1 may reach ``least``: all but those whose bound is known to be below.

    A residual at a right angle to the vector adds at most off * sin(angle), and the cosine is the product by the length.
    """
    some = np.flatnonzero(~(guess + (margin + off) < least))
    u, e, n = guess[some] + margin[some], off[some], length[some]
    with np.errstate(all="ignore"):
        part = 1 + (e / n) ** 2
        most = np.maximum(u, (u + e * np.sqrt(np.maximum(part - (u / n) ** 2, 0))) / part)
    return some[~(most < least)]


def scan_block(quantiser: Quantiser, ids: np.ndarray, codes: np.ndarray, q: np.ndarray, keep: int):
    """For each query, the places of the ``keep`` codes with the largest approximate products (ties to smaller ids), and all codes' products.

    A vector whose product isn't finite in the scan has an infinite one, so that it is scored exactly.
    """
    for i in range(0, len(q), SCAN_QUERIES):
        with np.errstate(all="ignore"):
            rows = quantiser.scan(q[i : i + SCAN_QUERIES], codes)
        rows[~np.isfinite(rows)] = np.inf
        for row in rows:
            some = np.arange(len(row))
            if len(row) > keep:
                least = np.partition(row, len(row) - keep)[len(row) - keep]
                ties = np.flatnonzero(row == least)
                some = np.concatenate([np.flatnonzero(row > least), ties[np.argsort(ids[ties], kind="stable")]])[:keep]
            yield some, row


def nearest_in_block(quantiser: Quantiser, ids: np.ndarray, codes: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int, rerank: int):
    """For each query, the places of its k nearest among rows of other ids (ties to smaller ids), their scores, and how many were scored.

    ``ids`` ascend.
    """
    _, _, off, length, margin = numbers_of(codes)
    for at in range(0, len(q), SCAN_QUERIES):
        some_q = q[at : at + SCAN_QUERIES].astype(np.float64)
        large = np.abs(some_q).max(1)
        norm = np.sqrt(((some_q / large[:, None]) ** 2).sum(1))
        unit = some_q / large[:, None] / norm[:, None]
        for i, (some, guess) in enumerate(scan_block(quantiser, ids, codes, unit, rerank + k + 1)):
            low, high = np.searchsorted(ids, asked[at + i]), np.searchsorted(ids, asked[at + i], "right")
            some = some[(some < low) | (some >= high)]
            score = exact(x, some_q[i], some)
            if len(some) < len(ids) - (high - low):
                least = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
                if x.dtype == np.float64 and abs(least) < UNDERFLOW:
                    least = -np.inf
                with np.errstate(all="ignore"):
                    least = least / large[i] / norm[i] / quantiser.scale
                more = within(guess, off, length, margin, least if np.isfinite(least) else -np.inf)
                more = np.setdiff1d(more[(more < low) | (more >= high)], some, assume_unique=True)
                some, score = np.concatenate([some, more]), np.concatenate([score, exact(x, some_q[i], more)])
            scored = len(some)
            if scored > k:
                few = ~(score < np.partition(score, scored - k)[scored - k])
                some, score = some[few], score[few]
            best = np.lexsort((ids[some], -score))[:k]
            yield some[best], score[best], scored


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, rerank: int = RERANK) -> DataFrame:
    """The k nearest of every query among all other ids: ``(query_id, rank, vec_id, score)``.

    Nearest is the largest inner product in double precision, ties to the smaller
    id; the quantised scan leaves out only what its bounds exclude. Vectors that are null or zero, that hold
    null or non-finite components, or whose id is null take no part. Vectors of
    other lengths than the query's are no candidates. Rows that repeat an id and
    vector count once; rows of one id with different vectors are searched for, and
    found, each. Fewer candidates than k: all of them. An empty table gives no
    rows. Only the two named columns are read.
    """
    spark = df.sparkSession
    component = df.schema[vector_col].dataType.elementType.simpleString()
    kind = "float" if component == "float" else "double"

    def valid(d: DataFrame) -> DataFrame:
        v = F.col("v")
        d = d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        d = d.where("id is not null and v is not null").where(finite & F.exists(v, lambda x: x != 0))
        return d.select("id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), v).alias("g"), "v")  # h and g name the vector

    vectors, asked = valid(df), valid(queries)
    lengths = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()  # one row a length
    out = None
    for r in lengths:
        own = F.size("v") == r["d"]
        found = search_length(vectors.where(own), asked.where(own), r["d"], r["n"], k, rerank)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def search_length(vectors: DataFrame, asked: DataFrame, dims: int, n: int, k: int, rerank: int) -> DataFrame:
    """``search`` among ``n`` vectors of one length; both tables are ``(id, h, g, v)``."""
    spark = vectors.sparkSession
    drawn = vectors.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < 2 * FIT_ROWS / n)
    sample = drawn.dropDuplicates(["h"]).orderBy("h").limit(FIT_ROWS).select("v").toPandas()["v"]  # at most FIT_ROWS vectors
    if not len(sample):
        sample = vectors.limit(FIT_ROWS).select("v").toPandas()["v"]
    quantiser = Quantiser(np.array(sample.tolist(), np.float64))
    kind = vectors.schema["v"].dataType.simpleString()

    def encode(batches):
        for batch in batches:
            batch = batch.take(pa.array(distinct(*(np.asarray(batch.column(i)) for i in range(3)), k + 1)))
            codes = quantiser.encode(rows_of(batch.column(3), dims).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "h", "g", "v", "code"])

    wanted = materialize(asked.dropDuplicates(["id", "h", "g"]).select(F.col("id").alias("query_id"), F.col("h").alias("query_h"), "v"), "queries")
    n_asked = wanted.count()
    fitting = max(1, BLOCK_BYTES // (dims * (4 if "float" in kind else 8)))
    # Vectors travel once for every part of the queries, and queries, which are fewer, once for every block of vectors: parts are few.
    tasks = 2 * spark.sparkContext.defaultParallelism
    n_parts = max(1, -(-n_asked // min(BLOCK_QUERIES, fitting)), min(round((tasks * n_asked / n) ** 0.5), n_asked // FEW_QUERIES))
    n_blocks = max(1, -(-n // min(BLOCK_ROWS, fitting)), min(-(-tasks // n_parts), n // FEW_ROWS))

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    coded = map_arrow(vectors, encode, f"id long, h long, g long, v {kind}, code binary")
    left = coded.withColumn("block", F.pmod(F.xxhash64("id", "h"), F.lit(n_blocks)).cast("int")).withColumn("part", every(n_parts))
    right = wanted.withColumn("part", F.pmod(F.xxhash64("query_id", "query_h"), F.lit(n_parts)).cast("int")).withColumn("block", every(n_blocks))

    def scan(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, h, g = (np.asarray(vectors[c]) for c in ("id", "h", "g"))
        places, scores, counts = [np.zeros(0, np.int64)], [np.zeros(0)], []
        if len(ids) and len(queries):
            kept = distinct(ids, h, g, k + 1)  # of equal vectors only the k + 1 smallest ids can be among the k best
            ids = ids[kept]
            codes = np.frombuffer(b"".join(vectors["code"].to_pylist()), np.uint8).reshape(len(h), -1)[kept]
            x = rows_of(vectors["v"].combine_chunks(), dims)[kept]
            q = rows_of(queries["v"].combine_chunks(), dims)
            for place, score, _ in nearest_in_block(quantiser, ids, codes, x, np.asarray(queries["query_id"]), q, k, rerank):
                places.append(place)
                scores.append(score)
                counts.append(len(place))
        own = queries.select(["query_id", "query_h"]).take(pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64()))
        return pa.table([*own.columns, pa.array(ids[np.concatenate(places)]), pa.array(np.concatenate(scores))], names=["query_id", "query_h", "vec_id", "score"])

    scored = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(scan, "query_id long, query_h long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id", "query_h").orderBy(F.desc("score"), "vec_id"))
    best = materialize(scored.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(wanted)
    return best


def nearest(df: DataFrame, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """``search`` with every row whose id is divisible by ``every`` as query."""
    return search(df, df.where(F.col(id_col) % every == 0), id_col, vector_col, k)
