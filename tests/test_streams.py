import pytest
from pyspark.sql import functions as F

from lexquarry.sources import store
from lexquarry.streaming import progress as P

KIND = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def rows(ids):
    kinds = ["signup", "view", "error", "click", "purchase"]
    return [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, kinds[i % 5], 1.0, '{"k": 7}') for i in ids]


def log(spark, path, ids):
    df = spark.createDataFrame(rows(ids), KIND.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    P.append(log(spark, path, range(10)), out)
    P.append(log(spark, path, range(10, 25)), out)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(25))


def test_numbers_go_on_over_batches(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for ids in (range(10), range(10, 25)):
        P.append(P.numbered(log(spark, path, ids)), out)
    want, seen = {}, {}
    for i in range(25):
        seen[i % 3] = seen.get(i % 3, 0) + 1
        want[i] = seen[i % 3]
    got = spark.read.parquet(out).collect()
    assert {r["event_id"]: r["n"] for r in got} == want and len(got) == 25


def test_a_snapshot_holds_the_last_rows(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = P.status(log(spark, path, range(10))).schema

    def now():
        return {r["user_id"]: (r["seq"], r["status"], r["completed"], r["progress"], r["n"]) for r in P.snapshot(spark, out, schema, ["user_id"]).collect()}

    P.upsert(P.status(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)), out)
    assert now() == {0: (9, "purchase", True, 3, 4), 1: (7, "error", True, 3, 3), 2: (8, "click", False, 2, 3)}
    first = now()
    P.upsert(P.status(log(spark, path, [12])), out)
    assert now() == first | {0: (12, "error", True, 3, 5)}
    changed = spark.read.parquet(f"{out}/changes").where("batch = 1")
    assert [r["user_id"] for r in changed.collect()] == [0]  # only ids that changed
    before = now()
    rows_again = changed.drop("batch").collect()
    spark.createDataFrame(rows_again, schema).write.mode("overwrite").parquet(f"{out}/changes/batch=1")  # a batch repeated after a failure
    assert now() == before
    P.compact(spark, out, schema, ["user_id"])
    assert now() == before
    P.upsert(P.status(log(spark, path, [13, 14])), out)
    assert now()[1][0] == 13 and now()[2][0] == 14 and now()[0] == before[0]


def test_states_run_out(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = spark.createDataFrame([], KIND).schema

    def more(events):
        df = spark.createDataFrame([(i, t, u, k, 1.0, "{}") for i, t, u, k in events], KIND.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(path)
        return P.open_states(spark.readStream.schema(schema).parquet(path))

    stream = more([(i, f"2024-01-01 00:00:{i:02d}", i % 5, "signup") for i in range(10)] + [(10 + i, f"2024-01-01 00:00:{20 + i}", i, "purchase") for i in range(4)])
    held = P.upsert(stream, out)[-1]["stateOperators"][0]["numRowsTotal"]
    got = {r["user_id"]: (r["completed_us"] is not None, r["n"], r["kept"]) for r in P.snapshot(spark, out, stream.schema, ["user_id"]).collect()}
    assert got == {u: (u < 4, 3 if u < 4 else 2, True) for u in range(5)}
    left = P.upsert(more([(20, "2024-01-01 00:05:22", 4, "view"), (21, "2024-01-01 00:05:21.5", 1, "view")]), out)[-1]["stateOperators"][0]["numRowsTotal"]
    got = {r["user_id"]: (r["n"], r["kept"]) for r in P.snapshot(spark, out, stream.schema, ["user_id"]).collect()}
    assert got == {0: (3, False), 1: (1, True), 2: (3, True), 3: (3, True), 4: (3, True)}  # the first ran out, the second's later event opened a new state
    assert left < held


def test_complete_results(spark, tmp_path):
    stream = log(spark, f"{tmp_path}/in", range(25))
    got = {r["user_id"]: (r["seq"], r["status"], r["completed"]) for r in P.drain(P.latest_state(stream), "complete").collect()}
    assert got == {0: (24, "purchase", True), 1: (22, "error", True), 2: (23, "click", True)}
    assert {r["user_id"]: r["progress"] for r in P.drain(P.furthest_step(stream), "complete").collect()} == {0: 3, 1: 3, 2: 3}


def test_errors_end_nothing(spark, tmp_path):
    got = P.drain(P.incremental_results(log(spark, f"{tmp_path}/in", range(25))), "append").collect()
    assert len(got) == 25 and sum(r["error"] is not None for r in got) == 5 and {r["result"] for r in got if r["error"] is None} == {7}


def test_expiry(spark):
    states = spark.createDataFrame([(1, None), (2, "2024-01-01 00:00:00"), (3, "2024-01-01 00:06:00")], "user_id long, at string").select("user_id", F.col("at").cast("timestamp_ntz").alias("completed_at"))
    now = F.lit("2024-01-01 00:05:01").cast("timestamp_ntz")
    assert {r["user_id"] for r in P.unexpired(states, now).collect()} == {1, 3}


def test_event_files_are_written_once(spark, tmp_path):
    for ids in (range(7), range(7, 9)):
        out = P.event_files(log(spark, f"{tmp_path}/in", ids), f"{tmp_path}/events")
    names = ["event_0_signup_1", "event_1_view_1", "event_2_error_1", "event_0_click_2", "event_1_purchase_2", "event_2_signup_2", "event_0_view_3", "event_1_error_3", "event_2_click_3"]
    assert sorted(r["name"] for r in out.collect()) == sorted(f"{n}.json" for n in names)


def test_a_cluster_names_its_shared_folder(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError):
        store.shared_dir(Session)
