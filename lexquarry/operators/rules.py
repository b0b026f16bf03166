"""Queries whose rule needs more columns than a citation row has: case records, search hits, a lookup's answer, groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators.cases import _GROUPABLE, TITLE_PATTERN
from lexquarry.operators.queries import _GREEDY, _NORM, MEANS, ORACLE_SQL, C, greedy_groups, mean_similarity, query
from lexquarry.plans.workload import cites, derived, table
from lexquarry.sources.files import inline_texts

# What a field says when it is unknown.
UNKNOWN = {"case_name": "Unknown case name", "court": "Unknown court", "date_filed": "Unknown date", "docket_number": "Unknown docket number", "citation": "Unknown citation"}

# Reporters whose citations are searched in these courts only.
STATE_REPORTERS = ["Wash.", "Wash. 2d", "Wash. App."]
STATE_COURTS = ["wash", "washctapp", "washag", "washterr"]

# Fixed value: cases that are known to be made up.
DENIED = ["Pringle v JP Morgan Chase"]

# How a lookup's summary begins if it is none.
NO_SUMMARY = ["Error", "Case citation", "CourtListener API is not available"]

# The warning of a summary whose record is mostly unknown, and the explanation of an answer that can't be read.
WARNING = "WARNING: CASE VERIFICATION FAILED - INSUFFICIENT DATA\n\n"
UNREAD = "Citation not verified by CourtListener API"

# The summary that stands in for one, around the citation.
STAND_IN = ("Summary of ", " would be generated by an LLM in a real implementation.")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Records ---------------------------------------------------------------------


def unknown_fields(least: int = 3) -> tuple[Column, Column]:
    """How many of a record's five fields are unknown, and whether that is too many."""
    n = sum((F.when(F.col(c) == said, 1).otherwise(0) for c, said in UNKNOWN.items()), F.lit(0))
    return n, n >= least


_UNKNOWN = " + ".join(f"CAST({c} = '{said}' AS INT)" for c, said in UNKNOWN.items())


@query("agg12_missing_fields", f"SELECT doc_id, ord, {_UNKNOWN} AS missing, {_UNKNOWN} >= 3 AS insufficient FROM w_records", "w_cites", "w_records")
def agg12(spark, sf):
    n, insufficient = unknown_fields()
    return derived(spark, sf, "w_records").select("doc_id", "ord", n.alias("missing"), insufficient.alias("insufficient"))


def summary(record_is_bare: Column) -> Column:
    """The text that sums up a record's five fields."""
    lines = [("Case Summary: ", "case_name"), None, ("Citation: ", "citation"), ("Court: ", "court"), ("Date Filed: ", "date_filed"), ("Docket Number: ", "docket_number"), None]
    said = [F.concat(F.lit("\n        "), *([F.lit(x[0]), F.col(x[1])] if x else [])) for x in lines]
    return F.concat(F.when(record_is_bare, WARNING).otherwise(""), *said, F.lit("\n        "))


_INDENT = "chr(10) || '        '"
_SUMMARY = (
    f"CASE WHEN {_UNKNOWN} >= 3 THEN 'WARNING: CASE VERIFICATION FAILED - INSUFFICIENT DATA' || chr(10) || chr(10) ELSE '' END || {_INDENT} || 'Case Summary: ' || case_name || {_INDENT} || {_INDENT} || 'Citation: ' || citation "
    f"|| {_INDENT} || 'Court: ' || court || {_INDENT} || 'Date Filed: ' || date_filed || {_INDENT} || 'Docket Number: ' || docket_number || {_INDENT} || {_INDENT}"
)


@query("scl26_summary", f"SELECT doc_id, ord, {_SUMMARY} AS result FROM w_records", "w_cites", "w_records")
def scl26(spark, sf):
    return derived(spark, sf, "w_records").select("doc_id", "ord", summary(unknown_fields()[1]).alias("result"))


#: Characters of an opinion that a summary shows.
EXCERPT = 500
#: What stands around an opinion's excerpt.
EXCERPT_HEAD, EXCERPT_FOOT = "\n            Opinion Excerpt:\n            ", "\n            \n            Full opinion available at: "


def excerpt(opinion: Column, url: Column) -> Column:
    """The begin of an opinion, stripped, and where all of it is; nothing without one."""
    cut = F.regexp_replace(F.substring(opinion, 1, EXCERPT), r"(?U)^\s+|\s+$", "")
    said = F.concat(F.lit(EXCERPT_HEAD), cut, F.when(F.length(opinion) > EXCERPT, "...").otherwise(""), F.lit(EXCERPT_FOOT), url, F.lit("\n            "))
    return F.when(F.coalesce(opinion, F.lit("")) != "", said).otherwise("")


_EXCERPT = rf"""CASE WHEN coalesce(opinion, '') <> '' THEN chr(10) || '            Opinion Excerpt:' || chr(10) || '            ' || regexp_replace(substr(opinion, 1, {EXCERPT}), '^[\t-\r\x{{85}}\p{{Z}}]+|[\t-\r\x{{85}}\p{{Z}}]+$', '', 'g') || CASE WHEN length(opinion) > {EXCERPT} THEN '...' ELSE '' END
|| chr(10) || '            ' || chr(10) || '            Full opinion available at: ' || '/opinion/' || page || '/' || chr(10) || '            ' ELSE '' END"""


@query("scl26_summary_with_excerpt", f"SELECT doc_id, ord, {_SUMMARY} || {_EXCERPT} AS result FROM (SELECT r.*, o.text AS opinion FROM w_records r LEFT JOIN documents o ON o.doc_id = r.page)", "w_cites", "w_records")
def scl26_excerpt(spark, sf):
    """Summaries with the begin of the opinion; a record's opinion is the document whose id is its page."""
    opinions = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.substring("text", 1, EXCERPT + 1).alias("opinion"))
    rows = derived(spark, sf, "w_records").join(opinions, "page", "left")
    at = F.concat(F.lit("/opinion/"), F.col("page").cast("string"), F.lit("/"))
    return rows.select("doc_id", "ord", F.concat(summary(unknown_fields()[1]), excerpt(F.col("opinion"), at)).alias("result"))


_FAILED = " OR ".join(f"starts_with(lookup, '{x}')" for x in NO_SUMMARY)


@query("cls12_summary_source", f"""SELECT doc_id, ord, CASE WHEN web IS NOT NULL THEN 'web' WHEN {_FAILED} THEN 'mock' ELSE 'lookup' END AS source,
CASE WHEN web IS NOT NULL THEN web WHEN {_FAILED} THEN '{STAND_IN[0]}' || citation || '{STAND_IN[1]}' ELSE lookup END AS summary FROM w_told""", "w_cites", "w_told")
def cls12(spark, sf):
    """The first source that has a summary: the web, the lookup unless it reports a failure, a stand-in text."""
    usable = ~any_of([F.col("lookup").startswith(x) for x in NO_SUMMARY])
    source = F.when(F.col("web").isNotNull(), "web").when(usable, "lookup").otherwise("mock")
    mock = F.concat(F.lit(STAND_IN[0]), C(), F.lit(STAND_IN[1]))
    return derived(spark, sf, "w_told").select("doc_id", "ord", source.alias("source"), F.coalesce("web", F.when(usable, F.col("lookup")), mock).alias("summary"))


# Search hits -----------------------------------------------------------------


def in_court() -> Column:
    """Citations of the state's reporters are looked for in the state's courts only."""
    return ~F.col("reporter").isin(STATE_REPORTERS) | F.col("court").isin(STATE_COURTS)


_IN_COURT = f"(reporter NOT IN ({sql_list(STATE_REPORTERS)}) OR court IN ({sql_list(STATE_COURTS)}))"
query("flt07_washington_courts", f"SELECT citation, hit_id, court FROM w_hits WHERE {_IN_COURT}", "w_cites", "w_hits")(lambda spark, sf: derived(spark, sf, "w_hits").where(in_court()).select("citation", "hit_id", "court"))


@query("srt01_best_hit", f"SELECT citation, hit_id, score, court, case_name, absolute_url FROM (SELECT *, row_number() OVER (PARTITION BY citation ORDER BY score DESC, hit_id) AS k FROM w_hits WHERE {_IN_COURT}) WHERE k = 1", "w_cites", "w_hits")
def srt01(spark, sf):
    """The whole row of each citation's best hit, of equal ones the first."""
    row = ["hit_id", "score", "court", "case_name", "absolute_url"]
    best = derived(spark, sf, "w_hits").where(in_court()).groupBy("citation").agg(F.min_by(F.struct(*row), F.struct(-F.col("score"), "hit_id")).alias("x"))
    return best.select("citation", "x.*")


# A lookup's answer -----------------------------------------------------------


@query("flt09_denied", f"SELECT doc_id, ord, found AND NOT ({' OR '.join(f'contains(asked, {sql_list([d])})' for d in DENIED)}) AS result FROM w_checks", "w_cites", "w_checks")
def flt09(spark, sf, denied: list[str] = DENIED):
    """A citation that names a case of the deny-list does not exist, whatever was found."""
    named = any_of([F.contains(F.col("asked"), F.lit(d)) for d in denied])
    return derived(spark, sf, "w_checks").select("doc_id", "ord", (F.col("found") & ~named).alias("result"))


def readable(answer: Column) -> Column:
    """Whether an answer is a list, or an object with citations."""
    return F.coalesce(F.json_array_length(answer).isNotNull() | F.get_json_object(answer, "$.citations").isNotNull(), F.lit(False))


@query("cls03_unrecognised", f"""SELECT doc_id, ord, CASE WHEN ok THEN NOT found ELSE true END AS is_hallucinated, CASE WHEN NOT ok THEN CAST(0.7 AS DOUBLE) WHEN found THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS confidence,
CASE WHEN NOT ok THEN '{UNREAD}' END AS explanation FROM (SELECT *, CASE WHEN json_valid(answer) THEN json_type(answer) = 'ARRAY' OR json_extract(answer, '$.citations') IS NOT NULL ELSE false END AS ok FROM w_answers)""", "w_cites", "w_answers")
def cls03(spark, sf):
    """An answer that can't be read makes every citation of its brief hallucinated, at 0.7."""
    ok, found = readable(F.col("answer")), F.col("found")
    verdict = [F.when(ok, ~found).otherwise(True).alias("is_hallucinated"), F.when(~ok, 0.7).when(found, 0.95).otherwise(0.85).alias("confidence"), F.when(~ok, UNREAD).alias("explanation")]
    return derived(spark, sf, "w_answers").select("doc_id", "ord", *verdict)


@query("jon13_within_document", "SELECT a.doc_id, a.ord AS i, b.item_ord AS j, b.item, b.case_name FROM (SELECT doc_id, ord, citation FROM w_cites) a JOIN w_items b ON a.doc_id = b.doc_id AND contains(lower(b.item), lower(a.citation))", "w_cites", "w_items")
def jon13(spark, sf):
    """Each brief's citations with the items of the answer to this brief that hold them."""
    own = cites(spark, sf).select("doc_id", F.col("ord").alias("i"), F.lower(C()).alias("low"))
    items = derived(spark, sf, "w_items").withColumnRenamed("item_ord", "j")
    return own.join(items, "doc_id").where(F.contains(F.lower("item"), F.col("low"))).select("doc_id", "i", "j", "item", "case_name")


def details(court: Column, date_filed: Column, citations: Column) -> Column:
    """A case's details, its citations put together from their parts."""
    said = F.transform(citations, lambda c: F.concat_ws(" ", c["volume"].cast("string"), c["reporter"], c["page"].cast("string")))
    return F.struct(F.coalesce(court, F.lit("Unknown Court")).alias("court"), F.coalesce(date_filed, F.lit("Unknown Date")).alias("date_filed"), said.alias("citations"))


@query("prj04_details", "SELECT id, coalesce(max(court), 'Unknown Court') AS court, coalesce(max(date_filed), 'Unknown Date') AS date_filed, string_agg(volume || ' ' || reporter || ' ' || id, '; ' ORDER BY volume, reporter) AS citations FROM w_clusters GROUP BY id", "w_cites", "w_clusters")
def prj04(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("volume", "reporter", F.col("id").alias("page"))))
    cases = derived(spark, sf, "w_clusters").groupBy("id").agg(F.max("court").alias("court"), F.max("date_filed").alias("date_filed"), parts.alias("citations"))
    said = cases.select("id", details(F.col("court"), F.col("date_filed"), F.col("citations")).alias("d"))
    return said.select("id", "d.court", "d.date_filed", F.array_join("d.citations", "; ").alias("citations"))


# Verdicts --------------------------------------------------------------------


def by_similarity(sim: Column, threshold: float) -> tuple[Column, Column]:
    return sim < threshold, F.round(T.confidence(sim, F.lit(threshold)), 6)


_SIMILAR = "round(least(2 * abs(sim - CAST(0.7 AS DOUBLE)) / CAST(0.7 AS DOUBLE), 1.0), 6)"
_WESTLAW = f"regexp_matches(c.citation, '{T.WESTLAW_PATTERN}')"


@query("cls10_brief_verdict", f"""SELECT doc_id, ord, method, CASE method WHEN 'courtlistener' THEN bare WHEN 'westlaw_unverifiable' THEN false ELSE sim < CAST(0.7 AS DOUBLE) END AS is_hallucinated,
CASE method WHEN 'courtlistener' THEN CASE WHEN bare THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END WHEN 'westlaw_unverifiable' THEN CAST(0 AS DOUBLE) ELSE {_SIMILAR} END AS confidence,
CASE method WHEN 'courtlistener' THEN NOT bare WHEN 'westlaw_unverifiable' THEN NULL ELSE sim >= CAST(0.7 AS DOUBLE) END AS "exists"
FROM (SELECT c.doc_id, c.ord, {_UNKNOWN.replace('CAST(', 'CAST(r.')} >= 3 AS bare, coalesce(m.sim, 1.0) AS sim,
  CASE WHEN c.found AND NOT {_WESTLAW} THEN 'courtlistener' WHEN m.sim IS NOT NULL THEN 'langsearch_comparison' WHEN {_WESTLAW} THEN 'westlaw_unverifiable' ELSE 'summary_comparison' END AS method
  FROM w_cites c JOIN w_records r ON r.doc_id = c.doc_id AND r.ord = c.ord LEFT JOIN ({MEANS}) m ON m.citation_id = c.page)""", "w_cites", "w_records", "w_summaries")
def cls10(spark, sf, threshold: float = 0.7):
    """Found by the lookup, else by comparing summaries; a Westlaw citation without either can't be verified.

    Summaries of a citation are those of the document whose id is its page; without any, the same stand-in text is compared with itself.
    """
    bare = unknown_fields()[1]
    records = derived(spark, sf, "w_records").select("doc_id", "ord", "page", "found", bare.alias("bare"), F.concat_ws(" ", "reporter").alias("reporter"))
    mean = mean_similarity(derived(spark, sf, "w_summaries")).select(F.col("citation_id").alias("page"), "sim")
    westlaw = F.col("reporter") == "WL"
    rows = records.join(mean, "page", "left")
    method = F.when(F.col("found") & ~westlaw, "courtlistener").when(F.col("sim").isNotNull(), "langsearch_comparison").when(westlaw, "westlaw_unverifiable").otherwise("summary_comparison")
    rows = rows.withColumn("method", method).withColumn("sim", F.coalesce("sim", F.lit(1.0)))
    other, sure = by_similarity(F.col("sim"), threshold)
    lookup, unverifiable = F.col("method") == "courtlistener", F.col("method") == "westlaw_unverifiable"
    hallucinated = F.when(lookup, F.col("bare")).when(unverifiable, False).otherwise(other)
    confidence = F.when(lookup, F.when(F.col("bare"), 0.7).otherwise(0.8)).when(unverifiable, 0.0).otherwise(sure)
    return rows.select("doc_id", "ord", "method", hallucinated.alias("is_hallucinated"), confidence.alias("confidence"), F.when(~unverifiable, ~hallucinated).alias("exists"))


# Groups of citations of one case ---------------------------------------------

_RECORD = ["citation", "case_name", "url", "source"]


def group_by_url(rows: DataFrame) -> DataFrame:
    """Citations of one URL under the first of them, then all others; ``pos`` numbers what is left, from 1.

    rows: ``(doc_id, ord, citation, case_name, url, source)``. Alternates have no similarity.
    """
    good = F.coalesce(F.expr(_GROUPABLE), F.lit(False))
    rows = rows.withColumn("key", F.when(good, F.col("url")))
    member = F.struct("ord", F.struct(*_RECORD, F.lit(None).cast("double").alias("similarity")).alias("x"))
    groups = rows.where("key is not null").groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(member)).alias("m"))
    heads = groups.select("doc_id", F.col("m")[0]["ord"].alias("ord"), F.col("m")[0]["x"].alias("x"), (F.size("m") >= 2).alias("big"), F.transform(F.slice("m", 2, 1 << 30), lambda v: v["x"]).alias("alternate_citations"))
    heads = heads.select("doc_id", "ord", "big", *(F.col(f"x.{c}").alias(c) for c in _RECORD), "alternate_citations")
    none = F.array().cast(heads.schema["alternate_citations"].dataType)
    single = rows.where("key is null").select("doc_id", "ord", F.lit(False).alias("big"), *_RECORD, none.alias("alternate_citations"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(F.col("big"), 0).otherwise(1), "ord"))
    return heads.unionByName(single).select("doc_id", place.alias("pos"), "ord", *_RECORD, "alternate_citations")


def group_by_name(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Citations of like case names under the first of them; ``rows(doc_id, pos, ord, ...)`` are taken in the order of pos, and alternates they had are not kept."""
    name = T.normalize_case_name(F.col("case_name"))
    named = rows.select("doc_id", F.col("pos").alias("ord"), name.alias("name"))
    places = greedy_groups(named, threshold).select("doc_id", F.col("ord").alias("pos"), "leader")
    rows = rows.withColumn("name", name).join(places, ["doc_id", "pos"])
    heads = rows.where("pos = leader").select("doc_id", "leader", "ord", *_RECORD, F.col("name").alias("head"))
    others = rows.where("pos <> leader").join(heads.select("doc_id", "leader", "head"), ["doc_id", "leader"])
    other = F.struct("pos", F.struct(*_RECORD, T.name_similarity(F.col("head"), F.col("name")).alias("similarity")).alias("x"))
    members = others.groupBy("doc_id", "leader").agg(F.transform(F.array_sort(F.collect_list(other)), lambda v: v["x"]).alias("alternate_citations"))
    grouped = heads.join(members, ["doc_id", "leader"], "left")
    none = F.array().cast(grouped.schema["alternate_citations"].dataType)
    return grouped.select("doc_id", F.col("leader").alias("pos"), "ord", *_RECORD, F.coalesce("alternate_citations", none).alias("alternate_citations"))


def group_citations(rows: DataFrame, method: str = "url_then_name") -> DataFrame:
    """Citations of one case as one row with ``alternate_citations``, by ``url``, ``name``, or both (any other method: by URL)."""
    if method == "name":
        return group_by_name(rows.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))))
    grouped = group_by_url(rows)
    return group_by_name(grouped) if method == "url_then_name" else grouped


def _flat(grouped: DataFrame) -> DataFrame:
    said = F.transform("alternate_citations", lambda a: F.concat_ws("|", a["citation"], a["case_name"], a["url"], a["source"], F.format_string("%.6f", a["similarity"])))
    return grouped.select("doc_id", "pos", "citation", F.array_join(said, "; ").alias("alternates"))


_ROWS = "doc_id", "ord", *_RECORD
_MEMBER = "concat_ws('|', citation, case_name, url, source)"


@query("agg07_url_groups", f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN size >= 2 THEN 0 ELSE 1 END, ord) AS INT) AS pos, citation, coalesce(alternates, '') AS alternates FROM (
SELECT doc_id, min(ord) AS ord, count(*) AS size, min_by(citation, ord) AS citation, string_agg({_MEMBER}, '; ' ORDER BY ord) FILTER (k > 1) AS alternates FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, url ORDER BY ord) AS k FROM w_cites WHERE {_GROUPABLE}) GROUP BY doc_id, url
UNION ALL SELECT doc_id, ord, 1, citation, NULL FROM w_cites WHERE NOT coalesce({_GROUPABLE}, false))""", "w_cites")
def agg07_groups(spark, sf):
    grouped = group_citations(cites(spark, sf).select(*_ROWS), "url")
    said = F.transform("alternate_citations", lambda a: F.concat_ws("|", a["citation"], a["case_name"], a["url"], a["source"]))
    return grouped.select("doc_id", "pos", "citation", F.array_join(said, "; ").alias("alternates"))


_SIM_TO_HEAD = "CASE WHEN h.nm = o.nm THEN 1.0 WHEN contains(h.nm, o.nm) OR contains(o.nm, h.nm) THEN 0.8 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END".format(*(f"list_distinct(list_filter(regexp_split_to_array({x}.nm, '\\s+'), lambda w: w <> ''))" for x in "ho"))


@query("agg08_name_groups", f"""SELECT h.doc_id, h.ord AS pos, h.citation, coalesce(string_agg(concat_ws('|', o.citation, o.case_name, o.url, o.source, printf('%.6f', CAST({_SIM_TO_HEAD} AS DOUBLE))), '; ' ORDER BY o.ord) FILTER (o.ord IS NOT NULL), '') AS alternates
FROM (SELECT *, {_NORM.format('case_name')} AS nm FROM w_cites) h LEFT JOIN (SELECT g.doc_id, g.ord, g.leader, c.citation, c.case_name, c.url, c.source, {_NORM.format('c.case_name')} AS nm FROM ({_GREEDY}) g JOIN w_cites c ON c.doc_id = g.doc_id AND c.ord = g.ord WHERE g.ord <> g.leader) o ON o.doc_id = h.doc_id AND o.leader = h.ord
WHERE (h.doc_id, h.ord) IN (SELECT (doc_id, ord) FROM ({_GREEDY}) WHERE ord = leader) GROUP BY h.doc_id, h.ord, h.citation""", "w_cites")
def agg08_groups(spark, sf):
    return _flat(group_citations(cites(spark, sf).select(*_ROWS), "name"))


# Windows ---------------------------------------------------------------------


@query("win02_running_count", ORACLE_SQL["agg13_running_hallucinated"])
def win02(spark, sf):
    """How many of a document's citations so far were not found."""
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return cites(spark, sf).select("doc_id", "ord", F.count_if(~F.col("found")).over(upto).alias("n"))


@query("win03_first_match", ORACLE_SQL["jon01_first_match"])
def win03(spark, sf):
    """The first mirror item of each citation, by numbering its items."""
    items = derived(spark, sf, "w_mirror").where("status = 200").select("normalized", "item_ord", F.col("case_name").alias("name"), "absolute_url")
    hits = cites(spark, sf).select("doc_id", "ord", "citation").join(items, F.lower("citation") == F.col("normalized"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy("item_ord"))
    return hits.withColumn("k", nth).where("k = 1").select("doc_id", "ord", "citation", "item_ord", F.col("name").alias("case_name"), "absolute_url")


# Pages -----------------------------------------------------------------------

_PAGE = f"regexp_extract(html, '{TITLE_PATTERN}', 1)"


@query("src15_pages", f"SELECT page_id, contains(html, 'attion') AS found, CASE WHEN contains(html, 'attion') THEN CASE WHEN {_PAGE} <> '' THEN {_PAGE} ELSE 'Unknown Case' END END AS case_name FROM pages")
def src15_pages(spark: SparkSession, sf: str, said: str = "attion") -> DataFrame:
    """Whether a page says what was searched for, and the first result's title or a stand-in for it."""
    title = F.regexp_extract("html", TITLE_PATTERN, 1)
    found = F.contains(F.col("html"), F.lit(said))
    return table(spark, sf, "pages").select("page_id", found.alias("found"), F.when(found, F.when(title != "", title).otherwise("Unknown Case")).alias("case_name"))


def search_result(html: Column, asked: Column) -> Column:
    """``(found, case_name)``: whether a page holds what was searched for, and then its first result's title or a stand-in."""
    title = F.regexp_extract(html, TITLE_PATTERN, 1)
    found = F.contains(html, asked)
    return F.struct(found.alias("found"), F.when(found, F.when(title != "", title).otherwise("Unknown Case")).alias("case_name"))


@query("src15_search_pages", f"SELECT page_id, contains(html, asked) AS found, CASE WHEN contains(html, asked) THEN CASE WHEN {_PAGE} <> '' THEN {_PAGE} ELSE 'Unknown Case' END END AS case_name FROM w_results", "w_results")
def src15_search(spark, sf):
    """Every result page, asked for its own words."""
    return derived(spark, sf, "w_results").select("page_id", search_result(F.col("html"), F.col("asked")).alias("x")).select("page_id", "x.*")


# Requests --------------------------------------------------------------------

_INLINE = "trim(coalesce(json_extract_string(body, '$.brief_text'), json_extract_string(body, '$.briefText'), json_extract_string(body, '$.text')), ' ' || chr(9) || chr(10) || chr(13))"


@query("src08_inline_text", f"SELECT doc_id, ord, {_INLINE} AS text FROM w_bodies WHERE {_INLINE} <> ''", "w_cites", "w_bodies")
def src08(spark, sf):
    """Texts that come in a request's body."""
    return inline_texts(derived(spark, sf, "w_bodies")).select("doc_id", "ord", "text")
