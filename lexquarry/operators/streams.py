"""Queries over the event table read as a stream; each runs it over all that is there and returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators.queries import query
from lexquarry.plans.workload import table
from lexquarry.sources.store import new_path
from lexquarry.streaming import progress as P


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")


@query("str02_latest_state", "SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS status, bool_or(event_type = 'purchase') AS completed FROM events GROUP BY user_id")
def str02(spark, sf):
    """Latest state of each id."""
    return P.latest(P.latest_state(events(spark, sf)), ["user_id"])


@query("str03_step_progress", "SELECT user_id, max(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END) AS progress FROM events GROUP BY user_id")
def str03(spark, sf):
    """The furthest of the steps 0 to 3 of each id."""
    return P.latest(P.furthest_step(events(spark, sf)), ["user_id"])


@query("str04_replay", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n, event_id, event_type FROM events")
def str04(spark, sf):
    """Every event of each id, numbered in order, delivered once."""
    return P.drain(P.numbered(events(spark, sf)), "append").select("user_id", "n", "event_id", "event_type")


@query("str05_incremental_results", """SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' ELSE 'result' END AS status,
CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INT) END AS result, CASE WHEN event_type = 'error' THEN 'Error processing citation ' || event_id END AS error FROM events""")
def str05(spark, sf):
    """Messages as they come; an error is a row like others."""
    return P.drain(P.incremental_results(events(spark, sf)), "append")


@query("str06_expiry", """SELECT user_id, completed_at, n FROM (SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS completed_at, count(*) AS n FROM events GROUP BY user_id)
WHERE completed_at IS NULL OR completed_at + INTERVAL 300 SECONDS > (SELECT min(ts) + INTERVAL 10 DAYS FROM events)""")
def str06(spark, sf):
    """Of the states by id, those still kept ten days after the first event: not completed, or less than 300 seconds ago or later."""
    now = table(spark, sf, "events").agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("now")).first()["now"]
    return P.unexpired(P.latest(P.completion(events(spark, sf)), ["user_id"]), F.lit(now)).select("user_id", "completed_at", "n")


# From each event on: when the id completes next, and the first event after that state's time.
_SESSIONS = f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_type FROM events),
nexts AS (SELECT DISTINCT user_id, us, min(CASE WHEN event_type = 'purchase' THEN us END) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS completed_us FROM e),
steps AS (SELECT n.user_id, n.us, n.completed_us, min(m.us) AS after FROM nexts n LEFT JOIN (SELECT DISTINCT user_id, us FROM e) m ON m.user_id = n.user_id AND m.us > n.completed_us + {P.KEPT_SECONDS} * 1000000 GROUP BY ALL),
walk AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id UNION ALL SELECT w.user_id, s.after FROM walk w JOIN steps s ON s.user_id = w.user_id AND s.us = w.us WHERE s.after IS NOT NULL),
heads AS (SELECT user_id, max(us) AS us FROM walk GROUP BY user_id)
SELECT h.user_id, s.completed_us, (SELECT count(*) FROM e WHERE e.user_id = h.user_id AND e.us >= h.us) AS n FROM heads h JOIN steps s ON s.user_id = h.user_id AND s.us = h.us
WHERE s.completed_us IS NULL OR s.completed_us + {P.KEPT_SECONDS} * 1000000 >= (SELECT max(us) FROM e)"""


@query("str06_state_expiry", _SESSIONS)
def str06_states(spark, sf):
    """The states by id that are left when all events have been read: an id's events since it opened, unless it completed more than 300 seconds before the last event."""
    return P.latest(P.open_states(events(spark, sf)), ["user_id"]).where("kept").select("user_id", "completed_us", "n")


@query("snk06_snapshot", "SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS status, bool_or(event_type = 'purchase') AS completed, max(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END) AS progress, count(*) AS n FROM events GROUP BY user_id")
def snk06(spark, sf):
    """What is to be shown of each id: its last status, how far it is, and whether it has completed; only ids that changed are written in a batch."""
    return P.latest(P.status(events(spark, sf)), ["user_id"])


@query("str_windows", "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str_windows(spark, sf):
    """Counts by five minutes of event time and type."""
    return P.drain(P.running_windows(events(spark, sf)), "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("snk04_event_files", "SELECT user_id, event_type, n, 'event_' || user_id || '_' || event_type || '_' || n || '.json' AS name FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n FROM events)")
def snk04(spark, sf):
    """Events kept as JSON, each with the name of its event."""
    return P.event_files(events(spark, sf), new_path(spark, "events")).select("user_id", "event_type", "n", "name")
