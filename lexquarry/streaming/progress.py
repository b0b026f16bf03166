"""Progress events as streams.

An event table stands for the log: ``user_id`` is the analysis, ``event_id`` the
order, ``event_type`` the status (``signup`` starts an analysis, ``purchase``
completes it). Sinks are Parquet or JSON files in the shared folder with their
checkpoints beside them, so a stream goes on where it stopped and no result
passes through the driver. What has to be known of earlier batches (an id's
number of events, its open state) is keyed state of the query, kept by RocksDB and
in the checkpoint; no batch reads what earlier ones wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryProgress
from pyspark.sql.types import StructType

from lexquarry.sources.store import new_path

STARTED, COMPLETE, ERROR = "signup", "purchase", "error"
#: The steps of an analysis: started, text extracted, citations extracted, lookup asked.
STEPS = {"signup": 0, "view": 1, "click": 2, "purchase": 3}
#: Fixed value: seconds that a completed analysis is kept.
KEPT_SECONDS = 300
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest_state(events: DataFrame) -> DataFrame:
    """Of each id: its last event's number and type, and whether it has completed."""
    last = F.max_by("event_type", "event_id").alias("status")
    return events.groupBy("user_id").agg(F.max("event_id").alias("seq"), last, F.bool_or(F.col("event_type") == COMPLETE).alias("completed"))


def running_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by event time and type; events later than the watermark are passed over (an extension)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def step(status: Column) -> Column:
    """The step that an event reports; null for events that report none."""
    out = F.lit(None).cast("int")
    for name, n in STEPS.items():
        out = F.when(status == name, n).otherwise(out)
    return out


def furthest_step(events: DataFrame) -> DataFrame:
    """The furthest step of each id."""
    return events.groupBy("user_id").agg(F.max(step(F.col("event_type"))).alias("progress"))


def completion(events: DataFrame) -> DataFrame:
    """When each id completed first, if it did, and its events so far."""
    return events.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == COMPLETE, F.col("ts"))).alias("completed_at"), F.count(F.lit(1)).alias("n"))


def status(events: DataFrame) -> DataFrame:
    """All of ``latest_state`` and ``furthest_step``, and the number of events."""
    last = F.max_by("event_type", "event_id").alias("status")
    return events.groupBy("user_id").agg(F.max("event_id").alias("seq"), last, F.bool_or(F.col("event_type") == COMPLETE).alias("completed"), F.max(step(F.col("event_type"))).alias("progress"), F.count(F.lit(1)).alias("n"))


def unexpired(states: DataFrame, now: Column, seconds: int = KEPT_SECONDS) -> DataFrame:
    """States of ``completion`` that are still kept at a time: those that have not completed, or not so long ago."""
    return states.where(F.col("completed_at").isNull() | (F.col("completed_at") + F.make_interval(secs=F.lit(seconds)) > now))


def append(stream: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> list[StreamingQueryProgress]:
    """Add what the stream's source holds now, and has not delivered before, to the files of a sink; the run's progress."""
    writer = stream.writeStream.format(kind).outputMode("append").option("path", path).option("checkpointLocation", f"{path}.checkpoint")
    return _run((writer.partitionBy(*by) if by else writer))


def _run(writer: DataStreamWriter) -> list[StreamingQueryProgress]:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def each_batch(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> list[StreamingQueryProgress]:
    """Hand each batch of new rows to ``write``; a batch that is repeated after a failure has the same number."""
    return _run(stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}.checkpoint"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that its source holds now, and return the sink's table: appended rows, or the complete result."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    if mode == "append":
        append(stream, path)
    else:
        each_batch(stream, path, lambda batch, _: batch.write.mode("overwrite").parquet(path), mode)
    return spark.read.schema(stream.schema).parquet(path)


# Keyed state -----------------------------------------------------------------


class Numbering(StatefulProcessor):
    """Counts an id's events on over batches."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        for row in sorted(rows, key=lambda r: r["event_id"]):  # an id's events of one batch
            n += 1
            yield Row(**{c: row[c] for c in self.columns}, n=n)
        self.count.update((n,))

    def close(self) -> None:
        pass


def numbered(events: DataFrame) -> DataFrame:
    """The stream's events with their number ``n`` within their id, in the order of event_id within a batch, counted on over batches."""
    events.sparkSession.conf.set(*STATE_STORE)
    schema = StructType([*events.schema.fields]).add("n", "long")
    return events.groupBy("user_id").transformWithState(Numbering(events.columns), schema, "Append", "None")


class Expiry(StatefulProcessor):
    """An id's open state: when it completed first and its events since it opened. Some time after completion it is dropped; a later event opens a new one."""

    def __init__(self, kept_us: int):
        self.kept_us = kept_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "completed_us long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        completed, n = self.state.get() if self.state.exists() else (None, 0)
        for row in sorted(rows, key=lambda r: (r["us"], r["event_id"])):  # an id's events of one batch
            if completed is not None and row["us"] > completed + self.kept_us:
                completed, n = None, 0
            n += 1
            if completed is None and row["event_type"] == COMPLETE:
                completed = row["us"]
        self.state.update((completed, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if completed is not None:
            self.handle.registerTimer((completed + self.kept_us) // 1000 + 1)
        yield Row(user_id=key[0], completed_us=completed, n=n, kept=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists():
            completed, n = self.state.get()
            self.state.clear()
            yield Row(user_id=key[0], completed_us=completed, n=n, kept=False)

    def close(self) -> None:
        pass


def open_states(events: DataFrame, late: str = "0 seconds", seconds: int = KEPT_SECONDS) -> DataFrame:
    """``(user_id, completed_us, n, kept)``: each id's state whenever it changes, and once more, not kept, when its time has run out.

    Time is that of events: a state goes once the watermark has passed ``seconds`` after completion, and with it its row in the state store.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    timed = events.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithState(Expiry(seconds * 1_000_000), "user_id long, completed_us long, n long, kept boolean", "Update", "EventTime")


# Snapshots -------------------------------------------------------------------


def upsert(stream: DataFrame, path: str) -> list[StreamingQueryProgress]:
    """Keep the rows that a stream in update mode changes, a folder a batch under ``path``; a repeated batch writes its folder anew."""
    return each_batch(stream, path, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}"), "update")


def snapshot(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Each key's last row of those that ``upsert`` keeps under ``path``."""
    rows = _changes(spark, path, schema)
    other = [f.name for f in schema if f.name not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*other), "batch").alias("x"))
    return last.select(*(F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in schema.names))


def _changes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows since the last compaction, and those that it left, with their batch."""
    own = StructType([*schema.fields]).add("batch", "long")
    changes = spark.read.schema(own).parquet(f"{path}/changes")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/base")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return changes
    base = spark.read.schema(StructType([*own.fields]).add("upto", "long")).parquet(f"{path}/base")
    upto = base.agg(F.max("upto")).first()[0]
    if upto is None:
        return changes
    return changes.where(F.col("batch") > upto).unionByName(base.where(F.col("upto") == upto).drop("upto"))


def compact(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> None:
    """Write each key's last row once, so that readers pass over the batches so far; run it between runs of the stream."""
    upto = _changes(spark, path, schema).agg(F.max("batch")).first()[0]
    if upto is not None:
        snapshot(spark, path, schema, keys).withColumn("batch", F.lit(upto)).write.mode("overwrite").parquet(f"{path}/base/upto={upto}")


def latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream over all that its source holds now; each key's last row."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, "snapshot")
    upsert(stream, path)
    return snapshot(spark, path, stream.schema, keys)


def event_name(id_: Column, status: Column, n: Column) -> Column:
    """The name under which an event is kept."""
    return F.concat(F.lit("event_"), id_.cast("string"), F.lit("_"), status, F.lit("_"), n.cast("string"), F.lit(".json"))


def event_files(events: DataFrame, path: str) -> DataFrame:
    """Add a stream's events to JSON lines under ``path``, a folder for each status, each once and with the name of its event; all of them, reread."""
    named = numbered(events).withColumn("name", event_name(F.col("user_id"), F.col("event_type"), F.col("n")))
    append(named, path, "json", ["event_type"])
    return events.sparkSession.read.schema(named.schema).json(path)


def incremental_results(events: DataFrame) -> DataFrame:
    """Messages as they come: a result of each event, or the error of one, which ends nothing."""
    failed = F.col("event_type") == ERROR
    return events.select("user_id", "event_id", F.when(failed, "error").when(F.col("event_type") == COMPLETE, "complete").otherwise("result").alias("status"), F.when(~failed, F.get_json_object("props", "$.k").cast("int")).alias("result"), F.when(failed, F.concat(F.lit("Error processing citation "), F.col("event_id").cast("string"))).alias("error"))
