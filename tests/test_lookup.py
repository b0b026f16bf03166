"""The nested answers of a lookup, with values of saved answers: five citations of which four are found, and nine of which one is."""

import json

import pytest

from lexquarry.operators.lookup import lookup_items, match_lookup

CITES, ANSWERS = "doc_id long, ord int, citation string", "doc_id long, answer string"


def case(name, url, *citations, **more):
    return {"id": 1, "absolute_url": url, "case_name": name, "citations": [{"volume": v, "reporter": r, "page": p, "type": 1} for v, r, p in citations]} | more


def item(citation, *cases, status=200, normalized=None):
    return {"citation": citation, "normalized_citations": [citation] if normalized is None else normalized, "start_index": 0, "end_index": 9, "status": status, "error_message": "" if status == 200 else f"Citation not found: '{citation}'", "clusters": list(cases)}


STRICKLAND = case("Strickland v. Washington", "/opinion/111170/strickland-v-washington/", (80, "L. Ed. 2d", "674"), (104, "S. Ct.", "2052"), (466, "U.S.", "668"), (1984, "U.S. LEXIS", "79"))
FIVE = [
    item("466 U.S. 668", STRICKLAND), item("104 S. Ct. 2052", STRICKLAND),
    item("998 F.2d 1460", case("United States v. Anthony Lapierre", "/opinion/611594/united-states-v-anthony-lapierre/", (998, "F.2d", "1460"), (1993, "WL", "248739"))),
    item("977 F.2d 1067", case("United States v. Guy E. McGaughey Jr.", "/opinion/593219/united-states-v-guy-e-mcgaughey-jr/", (977, "F.2d", "1067"), (1992, "WL", "278806"))),
    item("2018 WL 4697269", status=404),
]
CARAWAY = case("United States v. Caraway", "/opinion/171021/united-states-v-caraway/", (534, "F.3d", "1290"), (2008, "U.S. App. LEXIS", "15967"), (2008, "WL", "2877475"))
MISSED = ["2006 WL 3801910", "2018 WL 2446162", "2019 WL 2516279", "2017 WL 3461055", "2010 WL 4683851", "2011 WL 2160468", "2016 WL 165971", "2018 WL 3037217"]
NINE = [item("534 F.3d 1290", CARAWAY), *(item(c, status=404) for c in MISSED)]


@pytest.fixture(scope="module")
def found(spark):
    def run(answer, citations, strict=True):
        said = answer if isinstance(answer, str) else json.dumps(answer)
        df = match_lookup(spark.createDataFrame([(1, i, c) for i, c in enumerate(citations)], CITES), spark.createDataFrame([(1, said), (2, json.dumps(FIVE))], ANSWERS), strict)
        return {r["citation"]: (r["item_ord"], r["stage"], r["case_name"], r["url"]) for r in df.collect()}

    return run


def test_four_of_five(found):
    got = found(FIVE, [x["citation"] for x in FIVE])
    at = "https://example.org/opinion/111170/strickland-v-washington/"
    assert sum(v[0] is not None for v in got.values()) == 4 and got["2018 WL 4697269"] == (None,) * 4
    assert got["466 U.S. 668"] == (0, 1, "Strickland v. Washington", at)
    assert got["104 S. Ct. 2052"] == (0, 2, "Strickland v. Washington", at)  # the first item's case already holds it
    assert found(FIVE, ["2018 WL 4697269"], strict=False) == {"2018 WL 4697269": (4, 1, None, None)}


def test_one_of_nine(found):
    got = found(NINE, ["534 F.3d 1290", *MISSED])
    assert [c for c, v in got.items() if v[0] is not None] == ["534 F.3d 1290"]
    assert all(v[0] is not None for v in found(NINE, MISSED, strict=False).values())


def test_stages_and_order(found):
    twombly = case("Bell Atlantic Corp. v. Twombly", "/opinion/145730/", (127, "S. Ct.", "1955"), (550, "U.S.", "544"))
    answer = [item("127 S.Ct. 1955", twombly, normalized=["127 S. Ct. 1955"]), item("550 U.S. 544", case("Later", "http://a/b", (550, "U.S.", "544")))]
    got = found(answer, ["127 s. ct. 1955", "127 S.Ct. 1955", "550 U. S. 544", "550 u.s. 544", "1 F.2d 1"])
    assert got["127 s. ct. 1955"][:2] == (0, 1) and got["127 S.Ct. 1955"][:2] == (0, 2)
    assert got["550 U. S. 544"][:2] == (0, 2)  # an earlier item by the second stage comes before a later one by the first
    assert got["550 u.s. 544"] == (1, 1, "Later", "http://a/b")  # the second stage minds the case of letters
    assert got["1 F.2d 1"] == (None,) * 4


def test_odd_answers(spark, found):
    nameless = case(None, None, (1, "U.S.", "1"))
    missing = {k: v for k, v in nameless.items() if k != "case_name"}
    got = found([item("a", nameless), item("b", missing), item("c", case("N", "", (3, "U.S.", "3"))), item("d", normalized=[]), None], ["a", "b", "c", "d"])
    assert got == {"a": (0, 1, None, None), "b": (1, 1, "Unknown case", None), "c": (2, 1, "N", ""), "d": (None,) * 4}
    for answer in ("Service unavailable", "", "[]", '{"detail": "throttled"}', None):
        assert lookup_items(spark.createDataFrame([(1, answer)], ANSWERS)).where("status = 200").count() == 0
    assert found("Service unavailable", ["a"]) == {"a": (None,) * 4}
