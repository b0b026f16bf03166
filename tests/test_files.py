import json
import zipfile

import pytest

from lexquarry.operators.cases import check, tfidf_pairs
from lexquarry.sources import files
from lexquarry.streaming.progress import drain


def test_texts_fall_back_to_latin_1(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("410 U.S. 113 é".encode())
    (tmp_path / "b.TXT").write_bytes("é".encode("latin-1"))
    (tmp_path / "c d é.txt").write_bytes(b"")
    (tmp_path / "d.exe").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("410 U.S. 113 é", None), "b.TXT": ("é", None), "c d é.txt": (None, f"Error: File is empty: file:{tmp_path}/c d é.txt")}


def test_listing_and_guards(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, n in (("a.pdf", 0), ("sub/b.PDF", 7), ("c.pdf", 9), ("d.docx", 0), ("e.exe", 3), ("noext", 2)):
        (tmp_path / name).write_bytes(b"x" * n)
    every = files.listing(spark, str(tmp_path))
    assert {(r.path.rpartition("/")[2], r.length) for r in every.collect()} == {("a.pdf", 0), ("b.PDF", 7), ("c.pdf", 9), ("d.docx", 0)}
    assert sorted(r.length for r in files.listing(spark, str(tmp_path), "pdf").collect()) == [0, 7, 9]
    errors = {r.path.rpartition("/")[2]: r.error and r.error.split(":")[1].strip() for r in files.guarded(every, {"pdf": 8, "docx": 1}).collect()}
    assert errors == {"a.pdf": "File is empty", "b.PDF": None, "c.pdf": "File is too large (9 bytes)", "d.docx": "File is empty"}


def test_docx(spark, tmp_path):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:p><w:t>one </w:t><w:t>two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:document>')
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.docx").write_bytes(b"")
    rows = {r.path[-6:]: r for r in files.docx_files(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].text == "one two\nthree" and rows["a.docx"].error is None
    assert rows["b.docx"].text is None and rows["b.docx"].error.startswith("Error")
    assert rows["c.docx"].error.startswith("Error: File is empty")
    assert {r.error.split("(")[0].split(":")[1] for r in files.docx_files(spark, str(tmp_path), max_bytes=5).collect()} == {" File is too large ", " File is empty"}


def test_cases_and_events(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"id": 1, "case_name": "A v. B", "citation": None}]))
    assert files.saved_cases(spark, str(tmp_path / "cases.json")).first().case_name == "A v. B"
    log = tmp_path / "log"
    log.mkdir()
    for n, status in enumerate(["started", "progress", "complete"]):
        (log / f"event_x-1_{status}_{n}.json").write_text(json.dumps({"status": status}))
    rows = drain(files.event_log(spark, str(log)), "append").collect()
    assert sorted((r.analysis_id, r.seq, r.status) for r in rows) == [("x-1", 0, "started"), ("x-1", 1, "progress"), ("x-1", 2, "complete")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", "one"), ("y", "two")], "analysis_id string, text string")
    files.write_texts(df, str(tmp_path / "t"))
    files.write_results(df, str(tmp_path / "r"))
    assert {(r.analysis_id, r.value) for r in spark.read.text(str(tmp_path / "t")).collect()} == {("x", "one"), ("y", "two")}
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_bounds_and_cosine(spark):
    with pytest.raises(ValueError):
        check(11, 0.5)
    texts = [("a bb cc", "a bb cc"), ("bb", "cc"), ("", "bb"), ("x", "y"), ("x y", "y z"), ("", "")]
    rows = [(k, i, t) for k, pair in enumerate(texts) for i, t in enumerate(pair)]
    got = tfidf_pairs(spark.createDataFrame(rows, "citation_id int, iter int, text string"), 2)
    assert [r["sim"] for r in got.orderBy("citation_id").collect()] == [1.0, 0.0, 0.0, 0.0, pytest.approx(1 / 3), 1.0]
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
