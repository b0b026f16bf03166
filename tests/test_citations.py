from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators.queries import greedy_groups


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_extract_citations_across_line_breaks(spark):
    text = F.lit("See 410 U.S.\n113 and 534 F.3d 1290; again 410 U.S. 113. Also 2018 WL 3037217.")
    assert one(spark, T.extract_citations(text)) == ["410 U.S. 113", "534 F.3d 1290", "2018 WL 3037217"]


def test_parts_keep_the_first_pattern(spark):
    parts = one(spark, T.citation_parts(F.lit("196 Wash. 2d 725")))
    assert (parts["volume"], parts["reporter"], parts["page"]) == ("196", "Wash.", "2")


def test_name_similarity(spark):
    assert one(spark, T.name_similarity(F.lit("smith jones"), F.lit("smith jones"))) == 1.0
    assert one(spark, T.name_similarity(F.lit("smith"), F.lit("smith jones"))) == 0.8
    assert one(spark, T.name_similarity(F.lit(""), F.lit("a"))) == 0.0


def test_greedy_groups_compare_with_leaders_only(spark):
    rows = spark.createDataFrame([(1, 1, "a b c"), (1, 2, "a b c d"), (1, 3, "b c d e"), (1, 4, None)], "doc_id long, ord int, name string")
    got = {(r["ord"], r["leader"]) for r in greedy_groups(rows).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_party_names(spark):
    assert one(spark, T.extract_parties(F.lit("see Roe v. Wade and then Roe v Wade."))) == ["Roe v Wade"]
