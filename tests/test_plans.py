"""Citations of odd tables, and what is shuffled for them."""

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import cases, lookup, verdicts  # noqa: F401  (they add their queries)
from lexquarry.operators.queries import QUERIES, greedy_groups
from lexquarry.plans.workload import cites

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """Keys of the plan's shuffles where nothing is broadcast."""
    spark = df.sparkSession
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Arguments: hashpartitioning(" in line]


@pytest.fixture
def unaided(spark):
    """Nothing is broadcast, as where tables are large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def odd(spark, folder):
    """The tables with keys that are missing, null or there twice."""
    read = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("lineitem", "part", "orders", "customer")}
    part, orders, lines = read["part"], read["orders"], read["lineitem"]
    read["part"] = part.where("p_partkey % 13 <> 5").union(part.where("p_partkey % 7 = 0")).union(part.where("p_partkey % 11 = 0").withColumn("p_name", F.lit(None).cast("string"))).union(part.limit(3).withColumn("p_partkey", F.lit(None).cast("long")))
    read["orders"] = orders.where("o_orderkey % 10 <> 3").union(orders.where("o_orderkey % 17 = 0"))
    read["customer"] = read["customer"].union(read["customer"].where("c_custkey % 9 = 0"))
    read["lineitem"] = lines.withColumn("l_orderkey", F.expr("CASE WHEN l_partkey % 50 = 1 THEN NULL ELSE l_orderkey END")).union(lines.where("l_partkey % 19 = 0"))
    for n, df in read.items():
        df.write.parquet(f"{folder}/{n}.parquet")
    return read


def plainly(lines, part, orders, customer):
    """``(doc_id, ord, page, supp, case name)`` row by row."""
    by_part, by_order, by_customer = {}, {}, {}
    for rows, key, into in ((part, "p_partkey", by_part), (orders, "o_orderkey", by_order), (customer, "c_custkey", by_customer)):
        for r in rows:
            into.setdefault(r[key], []).append(r)
    keys = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    docs = {}
    for r in lines:
        docs.setdefault(r["l_orderkey"], []).append(r)
    out = []
    for doc, own in docs.items():
        segments = [c["c_mktsegment"] for o in (by_order.get(doc, []) if doc is not None else []) for c in by_customer.get(o["o_custkey"], [{"c_mktsegment": None}])] or [None]
        for ord_, r in enumerate(sorted(own, key=lambda r: tuple(r[k] for k in keys)), 1):
            page, supp = r["l_partkey"], r["l_suppkey"]
            for p in by_part.get(page, []):
                for s in segments:
                    n = p["p_name"]
                    if page % 10 == 0:
                        name = None if supp % 2 == 0 else "Unknown case"
                    else:
                        name = None if n is None else {1: "In re " + n, 2: "State v. " + n}.get(page % 10, f"{n} v. {s or 'Doe'}")
                    out.append((doc, ord_, page, supp, name))
    return out


def test_odd_tables(spark, tmp_path):
    tables = odd(spark, str(tmp_path))
    got = [tuple(r) for r in cites(spark, str(tmp_path)).select("doc_id", "ord", "page", "supp", "case_name").collect()]
    want = plainly(*(tables[n].collect() for n in ("lineitem", "part", "orders", "customer")))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_lines_travel_to_their_parts_and_orders_only(unaided):
    """They went to their customers, too, and then again to their documents."""
    assert sum("l_" in k for k in exchanges(cites(unaided, SF))) == 2
    assert sum("l_" in k or "doc_id" in k for k in exchanges(greedy_groups(cites(unaided, SF).select("doc_id", "ord", F.col("case_name").alias("name"))))) == 2


def written(spark, df):
    """Bytes that are shuffled for a table."""

    def total():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        tasks = context.statusStore().executorList(True)
        return sum(tasks.apply(i).totalShuffleWrite() for i in range(tasks.length()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("query, most", [("jon12_token_overlap", 6), ("jon03_two_stages_lenient", 3), ("jon03_two_stages", 3), ("cls01_verdict", 3), ("jon04_first_substring", 3), ("jon05_three_substrings", 3), ("agg04_unique_cases", 3)])
def test_shuffles_a_few_times_the_lines(unaided, query, most):
    """They shuffled 8 to 11 times what the lines alone take."""
    lines = written(unaided, unaided.read.parquet(f"{SF}/lineitem.parquet").repartition(4, "l_orderkey"))
    assert written(unaided, QUERIES[query](unaided, SF)) < most * lines
