import re

from lexquarry.operators import cases
from lexquarry.plans.workload import cites

SF = "/root/testdata/sf0.001"


def matches(said, files):
    parts = [w for w in re.split(r"[^\w\d]+", said) if len(w) >= 2]
    year = re.search(r"\((\d{4})\)", said)
    if year and year.group(1) not in parts:
        parts.append(year.group(1))
    least = min(2, max(1, len(parts) // 2))
    return any(sum(p.lower() in f for p in parts) >= least for f in files)


def test_citations_meet_all_file_names(spark):
    files = {r["p_name"].lower() + ".pdf" for r in spark.read.parquet(f"{SF}/part.parquet").collect() if r["p_name"] is not None}
    rows = cites(spark, SF).collect()
    want = {(r["doc_id"], r["ord"]): matches((r["case_name"] + ", " if r["case_name"] is not None else "") + r["citation"], files) for r in rows}
    got = {(r["doc_id"], r["ord"]): r["found"] for r in cases.jon12(spark, SF).collect()}
    assert got == want and len(got) == len(rows) and set(got.values()) == {True, False}


def test_parts_within_names_and_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(cases, "_FILES_A_BLOCK", 2)
    files = [f"red ring {i}.pdf" for i in range(9)] + ["blue.pdf"]
    words = ["red", "ring 3", "in", "pdf", "lue", "no"]
    got = {(r["part"], r["file"]) for r in cases.held(spark.createDataFrame([(w,) for w in words], "part string"), spark.createDataFrame([(f,) for f in files], "file string")).collect()}
    assert got == {(w, f) for w in words for f in files if w in f}
