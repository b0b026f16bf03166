import math
import re
from collections import Counter

import pytest

from lexquarry.operators import cases  # noqa: F401
from lexquarry.operators import verdicts  # noqa: F401  (adds its queries)
from lexquarry.operators.queries import QUERIES

START = "The same first words stand in every one of these texts until the hundred and sixtieth character has gone by, and nothing differs up to this place, not one word of it all. "
TEXTS = {1: START + "alpha beta gamma " * 50, 2: START + "alpha alpha alpha " * 50 + "end", 3: "a b", 4: "", 5: " \n one\ttwo  three one"}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([*TEXTS.items(), (6, None)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def thirds(d):
    return [" ".join(TEXTS[d].split()[i::3]) for i in range(3)]


def pairs():
    return {(d, i, j): (thirds(d)[i], thirds(d)[j]) for d in TEXTS for i in range(3) for j in range(i + 1, 3)}


def jaccard(x, y):
    a, b = (set(re.sub(r"[^\w\s]", " ", t.lower()).split()) for t in (x, y))
    return len(a & b) / len(a | b) if a and b else 0.0


def overlap(x, y):
    a, b = set(x.lower().split()), set(y.lower().split())
    return len(a & b) / max(len(a), len(b)) if a or b else 0.0


def cosine(x, y):
    if x == y:
        return 1.0
    p, q = (Counter(re.findall(r"\w\w+", t.lower())) for t in (x, y))
    if not p or not q:
        return jaccard(x, y) if not p and not q else 0.0
    idf = {w: math.log(3 / (1 + (w in p) + (w in q))) + 1 for w in p | q}
    norm = math.prod(math.sqrt(sum((n * idf[w]) ** 2 for w, n in t.items())) for t in (p, q))
    return sum(p[w] * q[w] * idf[w] ** 2 for w in p) / norm


def test_summary_pairs_hold_whole_texts(spark, sf):
    got = {(r["citation_id"], r["i"], r["j"]): (r["x"], r["y"]) for r in QUERIES["jon10_summary_pairs"](spark, sf).collect()}
    assert got == pairs()


@pytest.mark.parametrize("name, rule", [("scl13_word_jaccard", jaccard), ("scl14_tfidf_cosine", cosine), ("scl15_overlap", overlap)])
def test_similarities_equal_brute_force(spark, sf, name, rule):
    got = {(r["citation_id"], r["i"], r["j"]): r["sim"] for r in QUERIES[name](spark, sf).collect()}
    assert got == {k: pytest.approx(rule(*v), abs=2e-6) for k, v in pairs().items()}


def test_verdicts_equal_brute_force(spark, sf):
    mean = {}
    for d in TEXTS:
        alike = [round(jaccard(*pairs()[d, i, j]), 6) for i, j in ((0, 1), (0, 2), (1, 2)) if all(pairs()[d, i, j])]
        mean[d] = sum(alike) / len(alike) if alike else 1.0
    assert {r["citation_id"]: r["sim"] for r in QUERIES["agg11_mean_similarity"](spark, sf).collect()} == {d: pytest.approx(m, abs=2e-8) for d, m in mean.items()}
    assert {r["citation_id"]: r["hallucinated"] for r in QUERIES["cls09_similarity_verdict"](spark, sf).collect()} == {d: m < 0.3 for d, m in mean.items()}
    verdict = {}
    for d in TEXTS:
        x, y = pairs()[d, 0, 1]
        long = (len(x) > 50) + (len(y) > 50)
        verdict[d] = "real" if long == 1 or (long == 2 and overlap(x, y) > 0.3) else "not real"
    assert {r["citation_id"]: r["verdict"] for r in QUERIES["cls08_two_summaries"](spark, sf).collect()} == verdict
