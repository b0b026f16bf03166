"""More queries of the inventory: groupings, verdicts, joins within a document, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators.queries import _GREEDY, _GROUPABLE, _NORM, _PAIRS, QUERIES, WESTLAW, C, N, U, _words, greedy_groups, query, scalar, summary_pairs
from lexquarry.plans.workload import W_CITES, W_SUMMARIES, briefs, cites, derived, table
from lexquarry.sources.store import new_path

# Scalars ---------------------------------------------------------------------

#: Fixed value: the title link of a result page.
TITLE_PATTERN = r'<h3 class="gs_rt">\s*<a[^>]*>([^<]+)</a>'
_NAME = "coalesce(case_name, '')"
_PAGE = "'<h3 class=\"gs_rt\"> <a href=\"x\">' || case_name || '</a></h3> ' || citation"

scalar("scl24_json", lambda: F.to_json(F.struct("doc_id", "ord", "citation")), "CAST(to_json({'doc_id': doc_id, 'ord': ord, 'citation': citation}) AS VARCHAR)")
scalar("set01_shared_words", lambda: F.size(F.array_intersect(T.words(F.coalesce(N(), F.lit(""))), T.words(C()))), f"CAST(len(list_intersect({_words(_NAME)}, {_words('citation')})) AS INT)")
scalar("prj08_complete", lambda: N().isNotNull() & (U() != ""), "case_name IS NOT NULL AND url <> ''")
scalar("src15_result_title", lambda: F.when(F.contains(F.expr(_PAGE), C()), F.regexp_extract(F.expr(_PAGE), TITLE_PATTERN, 1)), f"CASE WHEN contains({_PAGE}, citation) THEN regexp_extract({_PAGE}, '{TITLE_PATTERN}', 1) END")
scalar("snk08_badge", lambda: F.format_string("<span class=\"%s\">%s</span>", F.when(F.col("found"), "verified").otherwise("hallucinated"), C()), "'<span class=\"' || CASE WHEN found THEN 'verified' ELSE 'hallucinated' END || '\">' || citation || '</span>'")
scalar("cls13_default_citation", lambda: F.coalesce(F.when(F.col("page") % 4 != 0, C()), F.lit("2016 WL 165971")), "coalesce(CASE WHEN page % 4 <> 0 THEN citation END, '2016 WL 165971')")


@query("scl03_party_names", f"SELECT DISTINCT doc_id, a || ' v ' || b AS parties FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{T.PARTY_PATTERN}', 1)) AS a, unnest(regexp_extract_all(text, '{T.PARTY_PATTERN}', 2)) AS b FROM (SELECT doc_id, replace(text, ' v. ', ' Roe v. ') AS text FROM w_briefs))", "w_cites", "w_briefs")
def scl03(spark, sf):
    return briefs(spark, sf).select("doc_id", F.explode(T.extract_parties(F.replace("text", F.lit(" v. "), F.lit(" Roe v. ")))).alias("parties"))


# Similarities ----------------------------------------------------------------

_TOKEN = r"[\p{L}\p{N}_]{2,}"


#: What a word of one of the two texts counts for, against 1 for a word of both.
_ALONE = math.log(1.5) + 1


def tfidf_pairs(summaries: DataFrame, iterations: int = 3) -> DataFrame:
    """``(citation_id, i, j, sim)`` of ``summaries(citation_id, iter, text)``: cosine of two texts' TF-IDF vectors over a corpus of these two.

    1 if they are equal, their words' Jaccard if neither has a token, 0 if one has
    none. Tokens are counted by text, so that neither a text's tokens nor its
    vector is ever one value; a token's counts in all of an id's texts meet in one
    row, and the sums over these rows give every pair.
    """
    pairs = [(i, j) for i in range(iterations) for j in range(i + 1, iterations)]
    tokens = summaries.select("citation_id", "iter", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), 0)).alias("w"))
    met = tokens.groupBy("citation_id", "w").agg(*(F.count_if(F.col("iter") == i).cast("double").alias(f"n{i}") for i in range(iterations)))

    def n(i: int) -> Column:
        return F.col(f"n{i}")

    def weight(i: int, j: int) -> Column:
        return F.pow(n(i) * F.when(n(j) > 0, 1.0).otherwise(_ALONE), F.lit(2.0))

    sums = [F.sum(n(i) * n(j)).alias(f"dot_{i}_{j}") for i, j in pairs] + [F.sum(weight(*p)).alias(f"norm_{p[0]}_{p[1]}") for i, j in pairs for p in ((i, j), (j, i))]
    totals = met.groupBy("citation_id").agg(*sums)
    looks = summaries.groupBy("citation_id").agg(*(F.max(F.when(F.col("iter") == i, F.md5(F.col("text").cast("binary")))).alias(f"look{i}") for i in range(iterations)))

    def sim(i: int, j: int) -> Column:
        a, b = (F.coalesce(F.col(f"norm_{p}_{q}"), F.lit(0.0)) for p, q in ((i, j), (j, i)))
        cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"dot_{i}_{j}") / F.sqrt(a * b)))
        return F.when(F.col(f"look{i}") == F.col(f"look{j}"), 1.0).when((a == 0) & (b == 0), None).when((a == 0) | (b == 0), 0.0).otherwise(cosine)

    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), sim(i, j).alias("sim"), F.col(f"look{i}").isNotNull() & F.col(f"look{j}").isNotNull() & sim(i, j).isNull() & (F.col(f"look{i}") != F.col(f"look{j}"))) for i, j in pairs))
    names = "array<struct<i: int, j: int, sim: double, bare: boolean>>"
    found = looks.join(totals, "citation_id", "left").select("citation_id", F.explode(rows.cast(names)).alias("r")).select("citation_id", "r.*").where("sim IS NOT NULL OR bare")
    bare = summaries.where(~F.col("text").rlike(_TOKEN))  # few: texts of single letters
    x, y = (bare.select("citation_id", F.col("iter").alias(k), F.col("text").alias(t)) for k, t in (("i", "x"), ("j", "y")))
    words = x.join(y, "citation_id").where("i < j").select("citation_id", "i", "j", T.word_jaccard(F.col("x"), F.col("y")).alias("by_words"))
    return found.join(words, ["citation_id", "i", "j"], "left").select("citation_id", "i", "j", F.when(F.col("bare"), F.coalesce("by_words", F.lit(0.0))).otherwise(F.col("sim")).alias("sim"))


_TFIDF = f"""SELECT p.citation_id, p.i, p.j, round(CASE WHEN p.x = p.y THEN 1.0 WHEN a.norm IS NULL OR b.norm IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, coalesce(d.dot, 0.0) / (a.norm * b.norm))) END, 6) AS sim
FROM ({_PAIRS}) p LEFT JOIN dots d USING (citation_id, i, j)
LEFT JOIN norms a ON a.citation_id = p.citation_id AND a.own = p.i AND a.other = p.j LEFT JOIN norms b ON b.citation_id = p.citation_id AND b.own = p.j AND b.other = p.i"""
_COUNTS = f"""counts AS (SELECT citation_id, iter, w, count(*) AS n FROM (SELECT citation_id, iter, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS w FROM w_summaries) GROUP BY ALL),
dots AS (SELECT p.citation_id, p.iter AS i, q.iter AS j, CAST(sum(p.n * q.n) AS DOUBLE) AS dot FROM counts p JOIN counts q ON q.citation_id = p.citation_id AND q.w = p.w AND p.iter < q.iter GROUP BY ALL),
norms AS (SELECT p.citation_id, p.iter AS own, o.iter AS other, sqrt(sum(pow(p.n * CASE WHEN q.w IS NOT NULL THEN 1.0 ELSE ln(CAST(1.5 AS DOUBLE)) + 1 END, 2))) AS norm
  FROM counts p JOIN (SELECT unnest([0, 1, 2]) AS iter) o ON o.iter <> p.iter LEFT JOIN counts q ON q.citation_id = p.citation_id AND q.iter = o.iter AND q.w = p.w GROUP BY ALL)"""
_OVERLAP = f"CAST(CASE WHEN greatest(len({_words('lower(x)')}), len({_words('lower(y)')})) = 0 THEN 0.0 ELSE len(list_intersect({_words('lower(x)')}, {_words('lower(y)')})) / greatest(len({_words('lower(x)')}), len({_words('lower(y)')})) END AS DOUBLE)"


@query("scl14_tfidf_cosine", f"WITH w_summaries AS ({W_SUMMARIES}), {_COUNTS} {_TFIDF}")
def scl14(spark, sf):
    return tfidf_pairs(derived(spark, sf, "w_summaries")).select("citation_id", "i", "j", F.round("sim", 6).alias("sim"))


@query("scl15_overlap", f"SELECT citation_id, i, j, round({_OVERLAP}, 6) AS sim FROM ({_PAIRS})", "w_summaries")
def scl15(spark, sf):
    return summary_pairs(spark, sf).select("citation_id", "i", "j", F.round(T.overlap_similarity(F.col("x"), F.col("y")), 6).alias("sim"))


def check(iterations: int, threshold: float) -> None:
    """The bounds of a similarity verdict's parameters."""
    if not 1 <= iterations <= 10 or not 0.1 <= threshold <= 1.0:
        raise ValueError("iterations must be 1 to 10, threshold 0.1 to 1.0")


# Joins -----------------------------------------------------------------------


#: Of a longer citation, its last so many characters are looked up, and the whole compared after.
_TAIL = 24
#: Places of equal citations of a document that matter: the row itself and three others.
_PLACES = 4


def distinct_places(rows: DataFrame) -> DataFrame:
    """``(doc_id, x, places)`` of rows ``(doc_id, ord, x, n)``: a document's distinct texts, with the first places of each and how many rows have them."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "x").orderBy("ord"))
    return rows.withColumn("k", nth).where(F.col("k") <= _PLACES).groupBy("doc_id", "x").agg(F.array_sort(F.collect_list(F.struct("ord", "n"))).alias("places"))


def held_pairs(texts: DataFrame) -> DataFrame:
    """``(doc_id, x, y)`` of distinct texts ``(doc_id, x)`` of a document of which y holds x; x is not y.

    A text is looked up among the substrings that others have of its length (or of
    its last characters, if it is long), so texts meet only where they share one.
    """
    short = F.least(F.length("x"), F.lit(_TAIL))
    asked = texts.select("doc_id", "x", short.alias("size"), F.right("x", short).alias("part"))
    sizes = asked.groupBy("doc_id").agg(F.collect_set("size").alias("sizes"))  # _TAIL numbers at most
    own = texts.select("doc_id", F.col("x").alias("y")).join(sizes, "doc_id")
    cut = F.flatten(F.transform("sizes", lambda n: F.when(n <= F.length("y"), F.transform(F.sequence(F.lit(1), F.length("y") - n + 1), lambda i: F.substring("y", i, n))).otherwise(F.array().cast("array<string>"))))
    parts = own.select("doc_id", "y", F.explode(F.array_distinct(cut)).alias("part"))
    return asked.join(parts, ["doc_id", "part"]).where((F.col("x") != F.col("y")) & F.contains("y", "x")).select("doc_id", "x", "y")


#: Documents of so many citations at most have them compared with one another as one row; those of longer ones are looked up.
_FEW = 32


def first_places(citations: DataFrame, n: int, both_ways: bool) -> DataFrame:
    """``(doc_id, i, js)`` of ``(doc_id, ord, citation)``: the first n (three at most) other places of a document whose citation holds the one at i (or either the other), whatever the case of letters."""
    rows = citations.select("doc_id", "ord", F.lower("citation").alias("x")).where("doc_id IS NOT NULL AND x IS NOT NULL")
    rows = rows.groupBy("doc_id", "ord", "x").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return compared(rows.where(F.col("size") <= _FEW), n, both_ways).unionByName(looked_up(rows.where(F.col("size") > _FEW), n, both_ways))


def _first(own: Column, met: Column, n: int) -> Column:
    """The first n places of met, once for each pair of rows that have own's place and theirs."""
    return F.slice(F.flatten(F.transform(met, lambda b: F.array_repeat(b["ord"], F.least(own * b["n"], F.lit(n))))), 1, n)


def compared(rows: DataFrame, n: int, both_ways: bool) -> DataFrame:
    """``first_places`` of rows ``(doc_id, ord, x, n)`` of documents that have few; n rows have the place."""

    def places(a: Column) -> Column:
        met = F.filter("m", lambda b: (b["ord"] != a["ord"]) & ((F.contains(b["x"], a["x"]) | F.contains(a["x"], b["x"])) if both_ways else F.contains(b["x"], a["x"])))
        return _first(a["n"], met, n)

    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "n"))).alias("m"))
    found = docs.select("doc_id", F.explode(F.filter(F.transform("m", lambda a: F.struct(a["ord"].alias("i"), places(a).alias("js"))), lambda r: F.size(r["js"]) > 0)).alias("r"))
    return found.select("doc_id", "r.i", "r.js")


def looked_up(rows: DataFrame, n: int, both_ways: bool) -> DataFrame:
    """``first_places`` of rows ``(doc_id, ord, x, n)`` of documents of any length; n rows have the place."""
    texts = distinct_places(rows.select("doc_id", "ord", "x", "n"))
    pairs = held_pairs(texts.select("doc_id", "x"))
    if both_ways:
        pairs = pairs.unionByName(pairs.select("doc_id", F.col("y").alias("x"), F.col("x").alias("y")))
    same = texts.select("doc_id", "x", F.explode("places").alias("j"))
    other = pairs.join(same.withColumnRenamed("x", "y"), ["doc_id", "y"]).select("doc_id", "x", "j")
    met = same.unionByName(other)
    nth = F.row_number().over(Window.partitionBy("doc_id", "x").orderBy("j"))
    least = met.withColumn("k", nth).where(F.col("k") <= n + 1).groupBy("doc_id", "x").agg(F.array_sort(F.collect_list("j")).alias("m"))
    js = _first(F.col("n"), F.filter("m", lambda b: b["ord"] != F.col("i")), n)
    return rows.select("doc_id", F.col("ord").alias("i"), "x", "n").join(least, ["doc_id", "x"]).select("doc_id", "i", js.alias("js")).where(F.size("js") > 0)


_WITHIN = "SELECT a.doc_id, a.ord AS i, b.ord AS j FROM w_cites a JOIN w_cites b ON a.doc_id = b.doc_id AND a.ord <> b.ord AND (contains(lower(b.citation), lower(a.citation)){0})"


@query("jon04_first_substring", f"SELECT doc_id, i, min(j) AS j FROM ({_WITHIN.format('')}) GROUP BY doc_id, i", "w_cites")
def jon04(spark, sf):
    return first_places(cites(spark, sf), 1, False).select("doc_id", "i", F.col("js")[0].alias("j"))


@query("jon05_three_substrings", f"SELECT doc_id, i, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS js FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY j) AS k FROM ({_WITHIN.format(' OR contains(lower(a.citation), lower(b.citation))')})) WHERE k <= 3 GROUP BY doc_id, i", "w_cites")
def jon05(spark, sf):
    return first_places(cites(spark, sf), 3, True).select("doc_id", "i", F.array_join(F.col("js").cast("array<string>"), ",").alias("js"))


@query("jon07_three_steps", f"SELECT c.citation, coalesce(s.source, 'none') AS source FROM (SELECT DISTINCT citation FROM w_cites) c LEFT JOIN (SELECT citation, min_by(source, priority) AS source FROM w_sources WHERE priority <= 3 AND (priority > 1 OR NOT {WESTLAW}) GROUP BY citation) s ON s.citation = c.citation", "w_cites", "w_sources")
def jon07(spark, sf):
    """Lookup (not for Westlaw), then two searches."""
    usable = derived(spark, sf, "w_sources").where((F.col("priority") <= 3) & ((F.col("priority") > 1) | ~T.is_westlaw(C())))
    best = usable.groupBy("citation").agg(F.min_by("source", "priority").alias("source"))
    return cites(spark, sf).select("citation").distinct().join(best, "citation", "left").select("citation", F.coalesce("source", F.lit("none")).alias("source"))


@query("jon11_fuzzy_pairs", f"SELECT doc_id, leader, ord FROM ({_GREEDY}) WHERE ord <> leader", "w_cites")
def jon11(spark, sf):
    return QUERIES["agg08_greedy_names"](spark, sf).where("ord <> leader").select("doc_id", "leader", "ord")


_FILES = rf"""WITH w_cites AS ({W_CITES}), said AS (SELECT doc_id, ord, coalesce(case_name || ', ', '') || citation AS said FROM w_cites),
texts AS (SELECT said, list_filter(regexp_split_to_array(lower(said), '[^\w\d]+'), lambda w: len(w) >= 2) AS parts FROM (SELECT DISTINCT said FROM said)),
files AS (SELECT DISTINCT lower(p_name || '.pdf') AS file FROM part WHERE p_name IS NOT NULL),
held AS (SELECT part, file FROM (SELECT DISTINCT unnest(parts) AS part FROM texts) w JOIN files ON contains(file, part)),
hits AS (SELECT DISTINCT said FROM (SELECT t.said, h.file FROM (SELECT said, len(parts) AS n, unnest(parts) AS part FROM texts) t JOIN held h ON h.part = t.part GROUP BY t.said, h.file, t.n HAVING count(*) >= least(2, greatest(1, t.n // 2))))
SELECT s.doc_id, s.ord, h.said IS NOT NULL AS found FROM said s LEFT JOIN hits h ON h.said = s.said"""


@query("jon12_token_overlap", _FILES)
def jon12(spark, sf):
    """Whether some file of all has enough of a citation's parts in its name.

    Never more than two parts are asked for, so parts are looked up singly or as
    pairs that one file name holds: no citation meets every file. These pairs are
    written first, so that they are broadcast if they are few. Most parts are in
    no file name and so in no pair; they are known by their hashes, and no pair is
    made of them.
    """
    said = F.concat(F.coalesce(F.concat(N(), F.lit(", ")), F.lit("")), C())
    parts = F.array_sort(F.transform(T.search_tokens(F.col("said")), F.lower))
    words = cites(spark, sf).select(said.alias("said")).select(F.explode(parts).alias("part")).distinct()
    files = table(spark, sf, "part").where("p_name IS NOT NULL").select(F.lower(F.concat("p_name", F.lit(".pdf"))).alias("file")).distinct()
    inside = held(words, files).groupBy("file").agg(F.array_sort(F.collect_set("part")).alias("parts"))  # a file name has few parts
    path = new_path(spark, "pairs")
    inside.select(F.explode(F.concat(_twice("parts"), _pairs("parts"))).alias("k")).select("k.*").distinct().write.parquet(path)
    known = spark.read.schema("p string, q string").parquet(path)
    rows = cites(spark, sf).select("doc_id", "ord", said.alias("said")).groupBy("doc_id", "ord", "said").agg(F.count(F.lit(1)).cast("int").alias("n"))
    some = rows.select("*", parts.alias("parts")).select("*", F.filter("parts", _marked(known.where("p = q").select("p"))).alias("own"))
    asked = some.select("doc_id", "ord", "said", "n", F.explode_outer(F.when(F.size("parts") >= 4, _pairs("own")).otherwise(_twice("own"))).alias("k"))
    met = asked.select("doc_id", "ord", "said", "n", "k.*").join(known.withColumn("hit", F.lit(True)), ["p", "q"], "left")
    found = met.groupBy("doc_id", "ord", "said", "n").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("found"))
    return found.select("doc_id", "ord", "found", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).drop("copy")


#: Hashes of parts that are told apart, a byte each in every task.
_MARKS = 1 << 16


def _marked(words: DataFrame) -> Callable[[Column], Column]:
    """Whether a word's hash is that of one of these words: true of all of them, and of few others while they are fewer than _MARKS."""

    def mark(w: Column) -> Column:
        return F.pmod(F.xxhash64(w), F.lit(_MARKS)).cast("int")

    marks = bytearray(_MARKS)
    for (at,) in words.select(mark(F.col(words.columns[0]))).distinct().collect():  # _MARKS numbers at most
        marks[at] = 1
    return lambda w: F.substring(F.lit(marks), mark(w) + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))


#: File names of one gram that meet its parts in one task.
_FILES_A_BLOCK = 4096


def _twice(parts: str) -> Column:
    return F.transform(parts, lambda x: F.struct(x.alias("p"), x.alias("q")))


def _pairs(parts: str) -> Column:
    """Pairs of a sorted array's members; a member that is there twice makes a pair with itself."""
    return F.flatten(F.transform(parts, lambda x, i: F.transform(F.slice(parts, i + 2, F.size(parts)), lambda y: F.struct(x.alias("p"), y.alias("q")))))


def held(words: DataFrame, files: DataFrame) -> DataFrame:
    """``(part, file)`` where the file name holds the part (two characters or more), joined on the part's first two or three characters.

    A gram's files are dealt over blocks, so that one in every name spreads over many tasks.
    """

    def cut(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("file") - n + 1), lambda i: F.substring("file", i, F.lit(n)))

    grams = files.select("file", F.explode(F.array_distinct(F.concat(cut(2), cut(3)))).alias("gram"))
    sizes = grams.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / _FILES_A_BLOCK).cast("int").alias("blocks"))
    dealt = grams.join(sizes, "gram").select("gram", F.pmod(F.xxhash64("file"), "blocks").cast("int").alias("block"), "file")
    asked = words.select("part", F.substring("part", 1, 3).alias("gram")).join(sizes, "gram")
    asked = asked.select("part", "gram", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return asked.join(dealt, ["gram", "block"]).where(F.contains("file", "part")).select("part", "file")


@query("prj06_merge", "SELECT doc_id, ord, CASE WHEN p_partkey IS NOT NULL THEN p_name ELSE case_name END AS name FROM w_cites LEFT JOIN (SELECT * FROM part WHERE p_size % 2 = 0) ON p_partkey = page", "w_cites")
def prj06(spark, sf):
    right = table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("page"), F.lit(True).alias("there"), "p_name")
    return cites(spark, sf).join(right, "page", "left").select("doc_id", "ord", F.when(F.col("there"), F.col("p_name")).otherwise(N()).alias("name"))


@query("prj03_case_row", "SELECT item_ord AS id, coalesce(case_name, 'Unknown Case') AS case_name, absolute_url AS url, status = 200 AS found FROM w_mirror", "w_cites", "w_mirror")
def prj03(spark, sf):
    return derived(spark, sf, "w_mirror").select(F.col("item_ord").alias("id"), F.coalesce("case_name", F.lit("Unknown Case")).alias("case_name"), F.col("absolute_url").alias("url"), (F.col("status") == 200).alias("found"))


# Groupings -------------------------------------------------------------------

_SPLIT = f"SELECT *, coalesce({_GROUPABLE}, false) AS good FROM w_cites"
_HEADS = f"""SELECT doc_id, case_name, found, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN big THEN 0 ELSE 1 END, ord) AS INT) AS ord FROM (
  SELECT *, good AND count(*) OVER (PARTITION BY doc_id, good, CASE WHEN good THEN url END) >= 2 AS big,
    row_number() OVER (PARTITION BY doc_id, good, CASE WHEN good THEN url END ORDER BY ord) AS k FROM ({_SPLIT})) WHERE NOT big OR k = 1"""


def heads(spark, sf) -> DataFrame:
    """Each document's groups by URL (their first citations), then its other citations, numbered in this order."""
    rows = cites(spark, sf).withColumn("good", F.coalesce(F.expr(_GROUPABLE), F.lit(False)))
    same = Window.partitionBy("doc_id", "good", F.when(F.col("good"), U()))
    rows = rows.withColumn("big", F.col("good") & (F.count(F.lit(1)).over(same) >= 2)).withColumn("k", F.row_number().over(same.orderBy("ord")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(F.col("big"), 0).otherwise(1), "ord"))
    return rows.where(~F.col("big") | (F.col("k") == 1)).select("doc_id", "case_name", "found", place.alias("ord"))


_GROUPS = _GREEDY.replace(f"{_NORM.format('case_name')} AS nm FROM w_cites", f"{_NORM.format('case_name')} AS nm FROM ({_HEADS})")


@query("agg09_url_then_name", _GROUPS, "w_cites")
def agg09(spark, sf):
    """Grouped by URL, then the groups' first citations by name; ord and leader count groups."""
    return greedy_groups(heads(spark, sf).select("doc_id", "ord", T.normalize_case_name(N()).alias("name")))


@query("agg04_unique_cases", f"SELECT g.doc_id, count(*) AS cases, count(*) FILTER (h.found) AS verified_cases FROM ({_GROUPS}) g JOIN ({_HEADS}) h ON h.doc_id = g.doc_id AND h.ord = g.ord WHERE g.ord = g.leader GROUP BY g.doc_id", "w_cites")
def agg04(spark, sf):
    """Groups of citations by URL and then by name, and those whose first citation was found."""
    first = heads(spark, sf).where("doc_id IS NOT NULL").select("doc_id", "ord", T.normalize_case_name(N()).alias("name"), "found")
    groups = greedy_groups(first, carry=("found",)).where("ord = leader")
    return groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cases"), F.count_if("found").alias("verified_cases"))


@query("agg17_recount", f"SELECT doc_id, count(*) FILTER (NOT found) AS hallucinated, count(*) FILTER (found) AS verified FROM ({_HEADS}) GROUP BY doc_id", "w_cites")
def agg17(spark, sf):
    return heads(spark, sf).groupBy("doc_id").agg(F.count_if(~F.col("found")).alias("hallucinated"), F.count_if("found").alias("verified"))


_VERIFIED = f"coalesce(found AND {_GROUPABLE}, false)"


def keyed(spark, sf) -> DataFrame:
    ok = F.expr(_VERIFIED)
    rows = cites(spark, sf).select("doc_id", "ord", "page", "citation", ok.alias("ok"), F.when(ok, U()).otherwise(C()).alias("key"))
    rest = F.array_sort(F.collect_list(F.struct("ord", "citation")))
    groups = rows.groupBy("doc_id", "ok", "key").agg(F.min("ord").alias("pos"), F.min_by("page", "ord").alias("first"), F.max_by("page", "ord").alias("last"), rest.alias("m"))
    return groups.withColumn("others", F.transform(F.slice("m", 2, 1 << 30), lambda x: x["citation"]))


@query("agg10_parallel", f"SELECT doc_id, ok AS verified, key, min(ord) AS pos, CASE WHEN ok THEN min_by(page, ord) ELSE max_by(page, ord) END AS page FROM (SELECT *, {_VERIFIED} AS ok, CASE WHEN {_VERIFIED} THEN url ELSE citation END AS key FROM w_cites) GROUP BY doc_id, ok, key", "w_cites")
def agg10(spark, sf):
    """Verified citations by URL, the first leading; others by their text, the last one's values at the first one's place."""
    return keyed(spark, sf).select("doc_id", F.col("ok").alias("verified"), "key", "pos", F.when(F.col("ok"), F.col("first")).otherwise(F.col("last")).alias("page"))


@query("prj02_group_output", f"SELECT doc_id, url, members[1] AS primary_citation, array_to_string(members[2:], '; ') AS parallel_citations FROM (SELECT doc_id, url, list(citation ORDER BY ord) AS members FROM w_cites WHERE {_VERIFIED} GROUP BY doc_id, url)", "w_cites")
def prj02(spark, sf):
    return keyed(spark, sf).where("ok").select("doc_id", F.col("key").alias("url"), F.col("m")[0]["citation"].alias("primary_citation"), F.array_join("others", "; ").alias("parallel_citations"))


@query("agg16_group_size", f"SELECT doc_id, url, count(*) AS size FROM w_cites WHERE {_VERIFIED} GROUP BY doc_id, url", "w_cites")
def agg16(spark, sf):
    return keyed(spark, sf).where("ok").select("doc_id", F.col("key").alias("url"), (F.size("others") + 1).cast("long").alias("size"))


@query("cls04_no_key_totals", "SELECT doc_id, count(*) AS total, count(*) AS hallucinated, CAST(0 AS BIGINT) AS verified FROM w_cites GROUP BY doc_id", "w_cites")
def cls04(spark, sf):
    return cites(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count(F.lit(1)).alias("hallucinated"), F.lit(0).cast("long").alias("verified"))


@query("src17_most_recent", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def src17(spark, sf, n: int = 10):
    """The n most recent of two courts; n is the feature."""
    own = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return own.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(n)
