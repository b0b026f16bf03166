import hashlib
import random

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], KIND)


def test_one_of_many_copies_stays(spark):
    prose = "\n".join(f"line {i} tells of river {i * 7} and hill {i * 11} in plain words" for i in range(8))
    docs = [(i, prose) for i in range(12)] + [(50 + i, f"shared by all of them\nown text number {i} of another kind {i * i}") for i in range(12)]
    lines = corpus_pipeline.dedup_lines(spark, table(spark, docs), "")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_duplicates(spark, lines, "").collect()}
    assert [t for d, t in kept.items() if d < 50] == [prose]
    assert sum(t.startswith("shared by all of them\n") for d, t in kept.items() if d >= 50) == 1


def test_first_occurrence_stays_where_ids_repeat(spark):
    docs = [(0, "the common line"), (0, "the common line")] + [(i, f"the common line\nown {i}") for i in range(1, 12)]
    kept = [r["text"] for r in corpus_pipeline.dedup_lines(spark, table(spark, docs).repartition(1), "").where("doc_id = 0").collect()]
    assert kept == ["the common line"] * 2


def test_rows_without_id_stay(spark, tmp_path):
    item = "Which of the following rivers flows through the largest number of capitals?"
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(None, "a text of its own without any id at all"), (None, "another one, said twice in this table of texts"), (None, "another one, said twice in this table of texts")]
    docs += [(None, "before " + item + " after"), (3, "a text that has an id and one copy without it"), (None, "a text that has an id and one copy without it")]
    kept = corpus_pipeline.near_duplicates(spark, table(spark, docs), "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted({t: (str(d), t) for d, t in reversed(docs)}.values())
    clean = corpus_pipeline.drop_leaks(spark, kept, str(tmp_path))
    assert sorted(r["text"] for r in clean.collect()) == sorted({t for _, t in docs if item not in t})


def test_sure_of_no_language(spark, monkeypatch):
    docs = table(spark, [(i, "plain words of one language " * 5) for i in range(20)] + [(30, None), (31, "12 34"), (32, "")])
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == set(range(20))
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.1)
    assert corpus_pipeline.language_id(spark, docs, "").count() == 0


def tokens_of(text):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return len(encoding.encode_ordinary(text))


def test_run_equals_brute_force(spark, tmp_path):
    """All stages over one small table: what goes, what stays, and its tokens."""
    item = "Which of the following rivers flows through the largest number of capitals?"
    words = [f"word{i}" for i in range(400)]
    rng = random.Random(3)
    prose = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(6))
    clean = {i: prose() for i in range(30)}
    docs = dict(clean)
    docs |= {40 + i: clean[3] for i in range(14)}  # copies of 3, whose lines are common
    docs[60] = clean[5].replace("word1 ", "word2 ") + " end"  # nearly 5
    docs[61] = "before it\n" + item + "\n" + prose()
    docs |= {70: None, 71: "", 72: "12 34 ! 5", 73: " \n "}
    docs |= {80 + i: f"Shared by many\n{prose()}" for i in range(12)}  # the first occurrence stays
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs.items()] + [(None, prose(), None, None, None), (5, docs[5], "en", "s", 0)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {d: t for d, t in docs.items() if d < 60 and d < 40 or d >= 80} | {None: rows[-2][1]}
    kept = {d: t.replace("Shared by many\n", "") if d and d > 80 else t for d, t in kept.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, kept))
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: tokens_of(t) for d, t in kept.items()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in kept.items()}


def test_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
