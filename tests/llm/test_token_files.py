import pathlib
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexquarry.llm import token_files
from lexquarry.sources.store import shared_dir

KIND = "doc_id long, text string"


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def docs():
    rng = random.Random(3)
    words = ["the", "Don't", "naïve", "中文", "😀", "12", "  ", "\n\n", "-", "it's", "\x1c"]
    own = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    x = thue_morse(2048)
    return own + [(50, None), (51, ""), (None, "no id"), (None, "none here either"), (7, "an id again"), (60, "a<|endoftext|>b"), (61, "<|endoftext|>"), (70, x), (71, x.translate(str.maketrans("ab", "ba"))), (72, "long text " * 60000)]


def encoded(special_as_text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    tokenizer.encode_special_tokens = special_as_text
    return sorted((str(d), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in docs())


def test_read_back_equals_the_library(spark):
    rows = token_files.round_trip(spark.createDataFrame(docs(), KIND).repartition(3).selectExpr("*", "'x' AS part", "1 AS doc", "'h' AS h")).collect()
    want = encoded(False)
    assert len(dict(want)["60"]) == 4
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want)
    rows = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)


def test_special_strings_as_text(spark, tmp_path):
    manifest = token_files.write(spark.createDataFrame(docs(), KIND), str(tmp_path), special_as_text=True)
    rows = token_files.read(manifest, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((d, len(x)) for d, x in encoded(True))


def test_as_many_read_tasks_as_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write(spark.createDataFrame(docs(), KIND), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = token_files.read(manifest, str(tmp_path))
    assert read.rdd.getNumPartitions() == manifest.count() > 1 and read.count() == len(docs())
    assert read.select(F.spark_partition_id()).distinct().count() == manifest.count()


def test_no_token_files_are_left(spark):
    token_files.round_trip(spark.createDataFrame(docs(), KIND)).count()
    assert not list(pathlib.Path(shared_dir(spark).removeprefix("file:"), "lexquarry").glob("tokens-?????????????????*/*.ids"))


def test_pieces_of_a_file_that_is_not_local(tmp_path):
    from pyarrow import fs

    np.arange(1000, dtype="<i8").tofile(tmp_path / "x")
    remote = token_files.Flat(fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "x", "<i8")
    assert remote.file is not None and remote[10:15].tolist() == [10, 11, 12, 13, 14] and remote[998:1005].tolist() == [998, 999]


def test_empty_table(spark):
    assert token_files.round_trip(spark.createDataFrame([], KIND)).count() == 0
