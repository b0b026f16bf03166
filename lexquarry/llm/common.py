"""Helpers that several operators of this subpackage share.

* ``materialize`` cuts lineage with a Parquet table in the shared folder that
  the cluster names in ``spark.checkpoint.dir`` (a lost executor then costs a
  re-read, not a recomputation).
* ``components`` finds connected components with alternating large-star and
  small-star steps; links and labels stay distributed.
* ``utf8_buffer`` hands Arrow text columns to numpy without copying them into
  Python strings.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.sources.store import new_path, shared_dir

#: Bytes of texts and lists that a function over Arrow batches sees at once; a longer row comes alone.
BATCH_BYTES = 1 << 20
#: Bytes of one Arrow batch on its way to a Python worker, at most.
TRANSFER_BYTES = 8 << 20

#: Up to so many edges, what is aggregated from them (16 bytes a node) is broadcast.
FEW_EDGES = 250_000

#: The white space that word and line rules strip: space and 0x09 to 0x0D.
WHITESPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, by Hadoop's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote; only for tables whose every use has been written in its turn."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            remove(df.sparkSession, path)


def materialize_buckets(df: DataFrame, name: str, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """Write one row of every ``key`` as a table bucketed by it, so that joins on it shuffle the other side only.

    Returns the table, and a function that drops it, files and all, once every use of it has been written.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"lexquarry_{name}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key).dropDuplicates([key])
    path = f"{shared_dir(spark)}/lexquarry/{table}"
    rows.write.bucketBy(buckets, key).saveAsTable(table, format="parquet", path=path)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(spark, path)

    return spark.table(table), drop


def row_bytes(column: pa.Array) -> np.ndarray | int:
    """Bytes of every row of a column of texts, binaries or lists of numbers; 0 for other kinds."""
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) or pa.types.is_large_list(kind)
    if not (wide or pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_list(kind)):
        return 0
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets).astype(np.int64) * (8 if pa.types.is_list(kind) or pa.types.is_large_list(kind) else 1)


def short_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most BATCH_BYTES, or of one row."""
    for batch in batches:
        n = len(batch)
        upto = np.cumsum(np.zeros(n, np.int64) + sum(row_bytes(c) for c in batch.columns)) if n else np.zeros(0, np.int64)
        if n == 0 or upto[-1] <= BATCH_BYTES:
            yield batch
            continue
        at = 0
        while at < n:
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + BATCH_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` whose function sees batches bounded in bytes, so that long texts do not mount up in a worker.

    Batches on their way are bounded, too: the session's own bound is lowered where it is wider.
    """
    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(bound).rstrip("b")) <= TRANSFER_BYTES:
        conf.set(bound, str(TRANSFER_BYTES))
    return df.mapInArrow(lambda batches: function(short_batches(batches)), schema)


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (nulls: empty)."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


class carried:  # noqa: N801
    """Columns that go through an Arrow function untouched, under names that clash with nothing."""

    def __init__(self, df: DataFrame, names: tuple[str, ...]):
        self.names = [f"carried_{i}" for i in range(len(names))]
        self.columns = [F.col(c).alias(n) for c, n in zip(names, self.names)]
        self.schema = "".join(f", {n} {df.schema[c].dataType.simpleString()}" for c, n in zip(names, self.names))
        self.back = [F.col(n).alias(c) for c, n in zip(names, self.names)]


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 = 1: rows that no model may learn from (null ids are held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``(node, comp)``.

    ``comp`` is the smallest node of the component; only nodes that have an
    edge to another node are returned. Every step is a partial aggregate and an
    equi-join with its result, which is broadcast if it has few rows and else
    written first, so that Spark can split the join partition of a hub with many
    neighbours.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0:
            return spark.createDataFrame([], "node long, comp long")
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("comp"))
            ).distinct()
        seen = now
        written: list[DataFrame] = []

        def aggregated(df: DataFrame) -> DataFrame:
            if now[0] <= FEW_EDGES:
                return F.broadcast(df)
            written.append(materialize(df, "least"))
            return written[-1]

        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = aggregated(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, old = materialize(large.distinct(), "large"), e
        low = aggregated(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        e = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(old, large, *written)
