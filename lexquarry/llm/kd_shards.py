"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

The documents are split again and again at the weighted median of the dimension
in which they spread widest, until a leaf's bytes reach the target. Weights are
sizes in bytes. A median is found by histograms of BINS bins, each an aggregate over all
rows that narrows the last one's bin: by the dimension, by the text's hash (twice)
and by a hash of the row. Copies of a text share their metadata (the least values
of any copy), so they stay together, but where a third of all bytes are copies of
one text they are cut where the weight says, even if they are the same row again
and again. The tree's few cuts are all that the driver sees.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import discard, materialize

BINS = 1024
#: Copies of one text are not cut apart while they weigh at most so much of a leaf.
UNCUT = 0.02
#: Rows that one bucket of slots should hold; buckets are numbered by prefix sums.
SLOT_ROWS = 50_000


def unit(hashed: Column) -> Column:
    """A hash as a number from 0 to below 1."""
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def kd_tree(items: DataFrame, dims: list[str], n_leaves: int) -> DataFrame:
    """``items(size, tie, own, dims)`` with a leaf number ``shard`` from 0 to n_leaves - 1.

    dims, tie and own are doubles; tie and own lie in [0, 1). A node is named by
    the first of the k leaves that it still holds. The driver sees a few numbers
    a node; they go back to the rows as a table of at most n_leaves rows.
    """
    spark = items.sparkSession
    small = F.broadcast if n_leaves <= 10_000 else (lambda t: t)  # some 100 bytes a leaf: under 1 MB
    rows = items.withColumn("shard", F.lit(0)).withColumn("k", F.lit(n_leaves))
    bins = [F.least(F.lit(BINS - 1), F.floor((F.col("value") - F.col("low")) / F.col("span") * BINS)).cast("int"), F.floor(F.col("tie") * BINS).cast("int"), F.floor(F.col("tie") * BINS % 1 * BINS).cast("int"), F.floor(F.col("own") * BINS).cast("int")]
    value = F.element_at(F.array(*dims), F.col("dim"))
    source = items
    while n_leaves > 1:
        live = rows.where("k > 1")
        spans = live.groupBy("shard", "k").agg(F.sum("size").alias("w"), *(f(d).alias(f"{d}_{s}") for d in dims for s, f in (("lo", F.min), ("hi", F.max)))).collect()
        if not spans:
            break
        nodes = {}
        for r in spans:
            widest = max(range(len(dims)), key=lambda i: r[f"{dims[i]}_hi"] - r[f"{dims[i]}_lo"])
            low, high = r[f"{dims[widest]}_lo"], r[f"{dims[widest]}_hi"]
            nodes[r["shard"]] = {"dim": widest + 1, "low": low, "span": (high - low) or 1.0, "target": float(r["w"]) * (r["k"] // 2) / r["k"], "leaf": float(r["w"]) / r["k"], "cuts": []}

        def table() -> DataFrame:
            kind = "shard int, dim int, low double, span double, target double, cuts array<int>"
            return small(spark.createDataFrame([(i, x["dim"], x["low"], x["span"], x["target"], x["cuts"]) for i, x in nodes.items()], kind))

        for level, bin_of in enumerate(bins):
            inside = live.join(table(), "shard").withColumn("value", value)
            for earlier in range(level):
                inside = inside.where(bins[earlier] == F.col("cuts")[earlier])
            weights = inside.groupBy("shard", "target", bin_of.alias("bin")).agg(F.sum("size").alias("w"))  # at most BINS rows a node
            upto = F.sum("w").over(Window.partitionBy("shard").orderBy("bin"))
            reached = weights.withColumn("upto", upto).where(F.col("upto") >= F.col("target"))
            found = reached.groupBy("shard").agg(F.min(F.struct("bin", "w", "upto")).alias("x")).select("shard", "x.*").collect()
            for r in found:
                x = nodes[r["shard"]]
                if len(x["cuts"]) > level:
                    continue
                before = float(r["upto"] - r["w"])
                last = level == len(bins) - 1
                uncut = level == len(bins) - 2 and r["w"] <= UNCUT * x["leaf"]
                whole = (last or uncut) and r["upto"] - x["target"] < x["target"] - before  # of the bin's two ends, the nearer
                x["cuts"] += [r["bin"] + whole, *[0] * uncut]
                x["target"] -= before
        left, cut = F.lit(False), F.col("cuts")
        for level, bin_of in reversed(list(enumerate(bins))):
            left = (bin_of < cut[level]) | ((bin_of == cut[level]) & left)
        half = F.floor(F.col("k") / 2).cast("int")
        placed = rows.join(table(), "shard", "left").withColumn("value", value).withColumn("left", F.col("k").eqNullSafe(1) | left)
        placed = placed.withColumn("to", F.when(F.col("left"), F.col("shard")).otherwise(F.col("shard") + half)).withColumn("k", F.when(F.col("k") == 1, 1).when(F.col("left"), half).otherwise(F.col("k") - half))
        rows, old = materialize(placed.select(*[c for c in items.columns], F.col("to").alias("shard"), "k"), "shard-level"), source
        discard(old)
        source = rows
    return rows.drop("k")


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang"), n_shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """Shards of near-equal bytes: ``(id, size, text_crc32, law, shard, slot, grown_shard)``.

    The dimensions are the text's length (log), and the given metadata columns
    by their values' hashes; a null has its own place. n_shards, or target_bytes
    of a leaf, sets the number of leaves. size is the text's UTF-8 bytes plus 1
    (null: 1), text_crc32 its unsigned CRC (null: 0, as for an empty text), slot
    numbers a shard's rows from 0 without gaps. Repeated rows and ids are rows
    like others, told apart by their place in the input, so which of several
    equal texts go where depends on it. An empty table gives no rows. A text of
    any length is one row of one shard. Only the named columns are read.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long") + 1
    seen = df.select(
        F.col(id_col).cast("long").alias("id"),
        size.alias("size"),
        F.crc32(raw).alias("crc"),
        F.log2(size).alias("d0"),
        F.xxhash64(raw).alias("text_hash"),
        F.xxhash64(F.monotonically_increasing_id(), F.col(id_col)).alias("own_hash"),  # written at once, so it stays
        *((unit(F.xxhash64(F.col(c).cast("string"))) * 16).alias(f"m{i + 1}") for i, c in enumerate(metadata)),
    )
    seen = materialize(seen, "shard-rows")
    # Copies take the least metadata of any; only texts whose copies differ need the join, whose keys Spark can split.
    names = [f"{i + 1}" for i in range(len(metadata))]
    least = seen.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), *(f(f"m{i}").alias(f"{s}{i}") for i in names for s, f in (("d", F.min), ("top", F.max))))
    mixed = [F.col(f"d{i}") < F.col(f"top{i}") for i in names]
    least = materialize(least.where(functools.reduce(operator.or_, mixed, F.lit(False))).select(F.col("text_hash").alias("of"), *(f"d{i}" for i in names)), "shard-copies")
    joined = seen.join(least, F.col("text_hash") == F.col("of"), "left").withColumns({f"d{i}": F.coalesce(f"d{i}", f"m{i}") for i in names})
    joined = joined.withColumn("tie", unit(F.col("text_hash"))).withColumn("own", unit(F.col("own_hash")))
    items = materialize(joined.select("id", "size", "crc", "tie", "own", "d0", *(f"d{i}" for i in names)), "shard-items")
    discard(seen, least)
    rows, total = items.agg(F.count(F.lit(1)), F.sum("size")).first()
    leaves = n_shards or max(1, math.ceil((total or 0) / target_bytes))
    placed = kd_tree(items, [f"d{i}" for i in range(len(metadata) + 1)], leaves if rows else 1)
    buckets = max(1, rows // SLOT_ROWS)
    placed = placed.withColumn("bucket", F.floor(F.col("own") * buckets).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("own", "id", "size", "crc"))
    numbered = placed.withColumn("slot", number - 1).join(bases, ["shard", "bucket"])
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot") + F.col("base")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
