import pytest
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators import rules

RECORD = "doc_id long, ord int, citation string, case_name string, url string, source string"
ROE, PRESS, WPEA = "https://x/108713/roe-v-wade/", "https://x/4688692/associated-press/", "https://x/4505648/wpea/"
CITATIONS = [
    ("410 U.S. 113", "Roe v. Wade", ROE, "Citation API"),
    ("93 S. Ct. 705", "Roe v. Wade", ROE, "Citation API"),
    ("35 L. Ed. 2d 147", "Roe v. Wade", ROE, "Citation API"),
    ("196 Wash. 2d 725", "Associated Press v. Washington State Legislature", PRESS, "Search API"),
    ("455 P.3d 1164", "Associated Press v. Wash. State Legislature", PRESS, "Search API"),
    ("190 Wash. 2d 1", "WPEA v. Washington State Center for Childhood Deafness", WPEA, "Search API"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, i, *c) for i, c in enumerate(CITATIONS, 1)], RECORD)


def groups(df):
    return [(r["citation"], [a["citation"] for a in r["alternate_citations"]]) for r in df.orderBy("pos").collect()]


def test_groups_by_url_then_name_lose_the_first_stage_s_alternates(rows):
    assert groups(rules.group_citations(rows)) == [("410 U.S. 113", []), ("196 Wash. 2d 725", []), ("190 Wash. 2d 1", [])]


def test_groups_by_url(rows):
    want = [("410 U.S. 113", ["93 S. Ct. 705", "35 L. Ed. 2d 147"]), ("196 Wash. 2d 725", ["455 P.3d 1164"]), ("190 Wash. 2d 1", [])]
    assert groups(rules.group_citations(rows, "url")) == want == groups(rules.group_citations(rows, "something else"))
    assert {a["similarity"] for r in rules.group_citations(rows, "url").collect() for a in r["alternate_citations"]} == {None}


def test_groups_by_name_say_how_alike(rows):
    got = rules.group_citations(rows, "name").orderBy("pos").collect()
    assert groups(rules.group_citations(rows, "name")) == [("410 U.S. 113", ["93 S. Ct. 705", "35 L. Ed. 2d 147"]), ("196 Wash. 2d 725", ["455 P.3d 1164"]), ("190 Wash. 2d 1", [])]
    assert [a["similarity"] for a in got[0]["alternate_citations"]] == [1.0, 1.0] and got[1]["alternate_citations"][0]["similarity"] == pytest.approx(5 / 7)


def test_unknown_names_and_empty_tables(spark, rows):
    odd = spark.createDataFrame([(1, 1, "a", None, "u", "s"), (1, 2, "b", "Unknown case", "u", "s"), (1, 3, "c", "", "u", None), (2, 1, "d", "x v. y", None, "s")], RECORD)
    for method in ("url", "name", "url_then_name"):
        grouped = rules.group_citations(odd, method)
        assert sorted((r["doc_id"], r["citation"], len(r["alternate_citations"])) for r in grouped.collect()) == [(1, "a", 0), (1, "b", 0), (1, "c", 0), (2, "d", 0)]
        assert rules.group_citations(odd.limit(0), method).count() == 0


def test_the_brief_of_nine_citations(spark):
    """The citations of a brief, in order; here with line breaks and repeats among them."""
    nine = ["534 F.3d 1290", "2006 WL 3801910", "2018 WL 2446162", "2019 WL 2516279", "2017 WL 3461055", "2010 WL 4683851", "2011 WL 2160468", "2016 WL 165971", "2018 WL 3037217"]
    text = "Brief. " + " and see ".join(c.replace(" ", "\n") if i % 2 else c for i, c in enumerate(nine)) + f". Again {nine[3]}."
    assert spark.range(1).select(T.extract_citations(F.lit(text)).alias("x")).first()["x"] == nine


@pytest.mark.parametrize("citation, parts", [("196 Wash. App. 138", ("196", "Wash. App.", "138")), ("198 Wash. 383", ("198", "Wash.", "383")), ("410 U.S. 113", ("410", "U.S.", "113"))])
def test_parts_of_state_citations(spark, citation, parts):
    got = spark.range(1).select(T.citation_parts(F.lit(citation)).alias("x")).first()["x"]
    assert (got["volume"], got["reporter"], got["page"]) == parts


def test_details_have_stand_ins(spark):
    df = spark.createDataFrame([(None, "2020-01-02", [(1, "U.S.", 2)]), ("scotus", None, [])], "court string, filed string, c array<struct<volume: int, reporter: string, page: int>>")
    got = [r["d"].asDict() for r in df.select(rules.details(F.col("court"), F.col("filed"), F.col("c")).alias("d")).collect()]
    assert got == [{"court": "Unknown Court", "date_filed": "2020-01-02", "citations": ["1 U.S. 2"]}, {"court": "scotus", "date_filed": "Unknown Date", "citations": []}]


def test_unknown_fields_and_their_summary(spark):
    df = spark.createDataFrame([("Unknown case name", "Unknown court", "Unknown date", "1", "c"), ("n", "Unknown court", "Unknown date", "1", "c")], "case_name string, court string, date_filed string, docket_number string, citation string")
    n, bare = rules.unknown_fields()
    got = df.select(n.alias("n"), bare.alias("bare"), rules.summary(bare).alias("s")).collect()
    assert [(r["n"], r["bare"]) for r in got] == [(3, True), (2, False)]
    assert got[0]["s"].startswith(rules.WARNING) and not got[1]["s"].startswith(rules.WARNING) and "Docket Number: 1" in got[1]["s"]


def test_readable_answers(spark):
    answers = ["[]", '[{"citation": "x"}]', '{"citations": {}}', '{"detail": "no"}', "Service unavailable", "", None]
    got = [r["ok"] for r in spark.createDataFrame([(a,) for a in answers], "a string").select(rules.readable(F.col("a")).alias("ok")).collect()]
    assert got == [True, True, True, False, False, False, False]


def test_search_results(spark):
    pages = [("<h3 class=\"gs_rt\">\n <a href='x'>Roe v. Wade</a></h3> 410 U.S. 113", "410 U.S. 113"), ("410 U.S. 113", "410 U.S. 113"), ("<h3 class=\"gs_rt\"><a>Other</a></h3>", "410 U.S. 113")]
    got = spark.createDataFrame(pages, "html string, asked string").select(rules.search_result(F.col("html"), F.col("asked")).alias("x")).collect()
    assert [tuple(r["x"]) for r in got] == [(True, "Roe v. Wade"), (True, "Unknown Case"), (False, None)]


def test_excerpts(spark):
    rows = spark.createDataFrame([("  short\n",), ("x" * 500,), ("y" * 499 + "  z",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(rules.excerpt(F.col("t"), F.lit("/u/"))).collect()]
    assert [g.split("\n")[2:3] for g in got] == [["            short"], ["            " + "x" * 500], ["            " + "y" * 499 + "..."], [], []]
    assert got[0].endswith("Full opinion available at: /u/\n            ")
