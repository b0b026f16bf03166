"""Documents, saved cases and event logs from files, and the tables written back."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.text import allowed_file

#: The largest files that are read, by extension.
MAX_BYTES = {"docx": 50 * 1024 * 1024, "pdf": 100 * 1024 * 1024}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

CASES = "id long, case_name string, court string, date_filed string, citation string, docket_number string, absolute_url string"
EVENT = "status string, current int, total int, message string, total_citations int, hallucinated_citations int, extracted_citations array<string>, citation_index int"


def _scan(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)


def _as_path(uri: str) -> str:
    """A file's URI as Spark's path column writes it."""
    return re.sub(r"^([a-z0-9+.-]+):///", r"\1:/", unquote(uri))


def listing(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """``(path, length)`` of the files that may be analysed, those of 0 bytes as well; contents are not read.

    Spark's own listing of the folder names the files; its scans pass over empty ones, which are those that the scan lacks.
    """
    files = _scan(spark, path, f"*.{{{extension},{extension.upper()}}}" if extension else "*")
    named = spark.createDataFrame([(_as_path(f),) for f in files.inputFiles()], "path string")
    found = named.join(files.select("path", "length"), "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"))
    return found.where(allowed_file(F.col("path")))


def guarded(files: DataFrame, max_bytes: dict[str, int] = MAX_BYTES) -> DataFrame:
    """``(path, length, error)`` of ``listing``'s rows: error is null for files that are to be read."""
    extension = F.lower(F.element_at(F.split("path", "[.]"), -1))
    most = F.lit(None).cast("long")
    for name, n in max_bytes.items():
        most = F.when(extension == name, F.lit(n)).otherwise(most)
    empty = F.concat(F.lit("Error: File is empty: "), "path")
    large = F.concat(F.lit("Error: File is too large ("), F.col("length").cast("string"), F.lit(" bytes): "), "path")
    return files.select("path", "length", F.when(F.col("length") == 0, empty).when(F.col("length") > most, large).alias("error"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text, error)`` of .txt files: UTF-8, or Latin-1 if a file's bytes are not UTF-8. Empty files have an error."""
    files = _scan(spark, path, "*.[tT][xX][tT]").where("length > 0")
    read = files.select("path", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1")).alias("text"))
    every = guarded(listing(spark, path)).where(F.lower("path").endswith(".txt")).select("path", "error")
    return every.join(read, "path", "left").select("path", "text", "error")


def _paragraphs(content: bytes) -> tuple[str | None, str | None]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as parts:
            body = ElementTree.fromstring(parts.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return None, f"Error: {e}"
    text = "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p"))
    return (text, None) if text.strip() else (None, "Error: empty document")


def docx_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES["docx"]) -> DataFrame:
    """``(path, text, error)`` of .docx files: paragraphs joined by a line break.

    Unreadable, empty and too large files, and those without text, have an error
    instead of a text; the contents of too large ones are never read.
    """
    files = _scan(spark, path, "*.[dD][oO][cC][xX]")

    @F.pandas_udf("text string, error string")
    def parse(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in contents:
            yield pd.DataFrame([_paragraphs(c) for c in batch], columns=["text", "error"], dtype="object")

    good = files.where((F.col("length") <= max_bytes) & (F.col("length") > 0)).select("path", parse("content").alias("x")).select("path", "x.text", "x.error")
    bad = guarded(listing(spark, path), {"docx": max_bytes}).where(F.lower("path").endswith(".docx") & F.col("error").isNotNull())
    return good.unionByName(bad.select("path", F.lit(None).cast("string").alias("text"), "error"))


def saved_cases(spark: SparkSession, path: str) -> DataFrame:
    """Saved cases of JSON documents."""
    return spark.read.schema(CASES).option("multiLine", True).json(path)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event files ``event_<id>_<status>_<n>.json``, with the id and number from their names."""
    name = r"event_(.+)_[a-z]+_(\d+)\.json$"
    events = spark.readStream.schema(EVENT).option("multiLine", True).option("pathGlobFilter", "event_*.json").json(path)
    file = F.col("_metadata.file_name")
    return events.select(F.regexp_extract(file, name, 1).alias("analysis_id"), F.regexp_extract(file, name, 2).cast("int").alias("seq"), "*")


def write_texts(texts: DataFrame, path: str) -> None:
    """``(analysis_id, text)`` as text files, a folder an analysis."""
    texts.select("analysis_id", "text").write.partitionBy("analysis_id").mode("append").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    results.write.mode("overwrite").json(path)


def inline_texts(requests: DataFrame, body: str = "body") -> DataFrame:
    """The text that a request's JSON body carries as ``brief_text``, ``briefText`` or ``text``, stripped, in column ``text``; requests without one are passed over."""
    said = F.coalesce(*(F.get_json_object(body, f"$.{name}") for name in ("brief_text", "briefText", "text")))
    return requests.withColumn("text", F.btrim(said, F.lit(" \t\n\r"))).where("text <> ''")
