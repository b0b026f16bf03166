"""The engine's own queries, by the inventory's ids, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators.greedy import greedy_groups
from lexquarry.plans.workload import briefs, cites, derived, oracle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOST = "https://example.org"


def C() -> Column:  # noqa: N802
    return F.col("citation")


def N() -> Column:  # noqa: N802
    return F.col("case_name")


def U() -> Column:  # noqa: N802
    return F.col("url")



def query(name: str, sql: str | None = None, *names: str):
    """Register a query, and its SQL over the derived tables ``names``."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, *names) if names else sql
        return f

    return add


def scalar(name: str, column: Callable[[], Column], sql: str) -> None:
    """A function of each citation row."""
    query(name, f"SELECT doc_id, ord, {sql} AS result FROM w_cites", "w_cites")(lambda spark, sf: cites(spark, sf).select("doc_id", "ord", column().alias("result")))


# Scalars ---------------------------------------------------------------------

_NORM = (
    "trim(regexp_replace(regexp_replace(CASE WHEN starts_with(lower(coalesce({0}, '')), 'in re ') THEN substr(lower({0}), 7) "
    "WHEN starts_with(lower(coalesce({0}, '')), 'state v. ') THEN substr(lower({0}), 10) "
    "WHEN starts_with(lower(coalesce({0}, '')), 'state of washington v. ') THEN substr(lower({0}), 24) ELSE lower(coalesce({0}, '')) END, "
    "'[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"
)


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def _sim(a: str, b: str) -> str:
    return (
        f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.8 "
        f"ELSE round(len(list_intersect({_words(a)}, {_words(b)})) / len(list_distinct(list_concat({_words(a)}, {_words(b)}))), 6) END"
    )


WESTLAW = f"regexp_matches(citation, '{T.WESTLAW_PATTERN}')"


def _two(x: str, pattern: str, between: str) -> str:
    return f"regexp_extract({x}, '{pattern}', 1) || '{between}' || regexp_extract({x}, '{pattern}', 2)"


_MESSY = "citation || ', ' || source || ' (19' || (10 + ord) || ')'"


def _messy() -> Column:
    return F.concat(C(), F.lit(", "), F.col("source"), F.lit(" (19"), 10 + F.col("ord"), F.lit(")"))

scalar("scl05_dedup_key", lambda: T.dedup_key(F.concat(F.lit(" "), C(), F.lit(" "))), f"CASE WHEN regexp_matches(lower(citation), '{T.WESTLAW_KEY_PATTERN}') THEN {_two('lower(citation)', T.WESTLAW_KEY_PATTERN, 'wl')} ELSE regexp_replace(lower(citation), '[^\\w\\d]', '', 'g') END")
scalar("scl06_westlaw", lambda: T.westlaw(F.concat(F.lit("see "), C())), f"CASE WHEN {WESTLAW} THEN {_two('citation', T.WESTLAW_PATTERN, ' WL ')} ELSE 'see ' || citation END")
scalar("scl07_washington_format", lambda: T.washington_format(F.regexp_replace(C(), "Wash. 2d", "wash 2d")), f"regexp_replace(replace(citation, 'Wash. 2d', 'wash 2d'), '{T.WASHINGTON_FORMATS[0][0]}', '\\1 Wash. 2d \\2', 'gi')")
scalar("scl08_washington_citation", lambda: T.washington_citation(C()), f"regexp_extract(citation, '{T.WASHINGTON_PATTERN}', 1)")
scalar("scl09_citation_parts", lambda: F.concat_ws("|", T.citation_parts(C())["volume"], T.citation_parts(C())["reporter"], T.citation_parts(C())["page"]), "CASE " + " ".join(f"WHEN regexp_matches(citation, '{p}') THEN regexp_extract(citation, '{p}', 1) || '|' || trim(regexp_extract(citation, '{p}', 2)) || '|' || regexp_extract(citation, '{p}', 3)" for p in T.PARTS_PATTERNS) + " ELSE '' END")
scalar("scl10_case_name", lambda: T.normalize_case_name(N()), _NORM.format("case_name"))
scalar("scl11_clean_key", lambda: T.clean_key(C()), "replace(replace(citation, ' ', ''), '.', '')")
scalar("scl16_confidence", lambda: F.round(T.confidence(F.col("conf"), F.lit(0.7)), 6), "round(least(2 * abs(conf - CAST(0.7 AS DOUBLE)) / CAST(0.7 AS DOUBLE), 1.0), 6)")
scalar("scl17_confidence", lambda: F.round(F.when(F.col("conf") > 0.3, 0.8 + 0.2 * F.col("conf")).otherwise(0.7), 6), "round(CASE WHEN conf > CAST(0.3 AS DOUBLE) THEN CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * conf ELSE CAST(0.7 AS DOUBLE) END, 6)")
scalar("scl18_format", lambda: F.format_string("%d %s %d", "volume", "reporter", "page"), "volume || ' ' || reporter || ' ' || page")
scalar("scl19_last_segment", lambda: T.last_segment(U()), "list_extract(string_split(rtrim(url, '/'), '/'), -1)")
scalar("scl20_search_tokens", lambda: F.array_join(T.search_tokens(_messy()), "|"), rf"array_to_string(list_filter(regexp_split_to_array({_MESSY}, '[^\w\d]+'), lambda w: len(w) >= 2), '|')")
scalar("scl21_denials", lambda: T.denies(F.concat(F.when(F.col("page") % 4 == 0, "Unable to find ").when(F.col("page") % 4 == 1, "There is NO INFORMATION on ").otherwise(""), C())), "page % 4 IN (0, 1)")
scalar("scl22_percent", lambda: F.floor(F.col("conf") * 100 + 0.5).cast("long"), "CAST(floor(conf * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT)")
scalar("scl25_backoff", lambda: F.pow(F.lit(2.0), F.col("ord") % 5), "pow(CAST(2 AS DOUBLE), ord % 5)")
scalar("src01_allowed_file", lambda: T.allowed_file(F.concat(C(), F.element_at(F.array(F.lit("x.PDF"), F.lit(".docx"), F.lit(".exe"), F.lit("")), (F.col("page") % 4 + 1).cast("int")))), "page % 4 < 2")
scalar("prj01_grouping_record", lambda: F.concat_ws("|", F.coalesce(N(), F.lit("Unknown Case")), U(), F.coalesce("source", F.lit("Unknown"))), "coalesce(case_name, 'Unknown Case') || '|' || url || '|' || coalesce(source, 'Unknown')")
scalar("prj05_absolute_url", lambda: T.absolute_url(U(), HOST), f"CASE WHEN url <> '' AND NOT starts_with(url, 'http') THEN '{HOST}' || url ELSE url END")
scalar("prj07_truncate", lambda: T.truncate(F.concat(F.repeat(F.lit("x"), (F.col("page") % 130).cast("int")), C()), 100), "CASE WHEN len(repeat('x', CAST(page % 130 AS INT)) || citation) > 100 THEN substr(repeat('x', CAST(page % 130 AS INT)) || citation, 1, 100) || '...' ELSE repeat('x', CAST(page % 130 AS INT)) || citation END")
scalar("cls06_two_way", lambda: F.when(F.col("found"), 0.95).otherwise(0.85), "CASE WHEN found THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END")
scalar("cls11_display_state", lambda: F.when(~F.col("found"), "hallucinated").when((U() == "") | (T.is_westlaw(C()) & N().isNull()), "unconfirmed").otherwise("verified"), f"CASE WHEN NOT found THEN 'hallucinated' WHEN url = '' OR ({WESTLAW} AND case_name IS NULL) THEN 'unconfirmed' ELSE 'verified' END")

# Texts -----------------------------------------------------------------------


@query("scl01_collapse_whitespace", r"SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS result FROM w_briefs", "w_cites", "w_briefs")
def scl01(spark, sf):
    return briefs(spark, sf).select("doc_id", T.collapse_whitespace(F.col("text")).alias("result"))


def _extract_sql(n: int) -> str:
    found = "[]"
    for p in T.CITATION_PATTERNS[:n]:
        found = f"list_concat({found}, regexp_extract_all(t, '{p}', 0, 'i'))"
    return (
        r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) AS INT) AS ord, citation FROM (SELECT doc_id, citation, min(pos) AS p FROM "
        r"(SELECT doc_id, unnest(l) AS citation, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, " + found + r" AS l FROM (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM w_briefs))) GROUP BY doc_id, citation)"
    )


def extracted(spark: SparkSession, sf: str, patterns: int = 8) -> DataFrame:
    """Ordered distinct citations of every brief."""
    found = briefs(spark, sf).select("doc_id", F.posexplode(T.extract_citations(F.col("text"), patterns)).alias("ord", "citation"))
    return found.withColumn("ord", F.col("ord") + 1)


query("scl02_extract_citations", _extract_sql(8), "w_cites", "w_briefs")(lambda spark, sf: extracted(spark, sf))
query("scl02_extract_citations_short", _extract_sql(5), "w_cites", "w_briefs")(lambda spark, sf: extracted(spark, sf, 5))
query("agg01_citations_per_brief", "SELECT doc_id, count(*) AS n FROM (" + _extract_sql(8) + ") GROUP BY doc_id", "w_cites", "w_briefs")(lambda spark, sf: extracted(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))


@query("scl23_occurrences", "SELECT doc_id, CAST((len(lower(text)) - len(replace(lower(text), 'as held', ''))) / 7 AS BIGINT) AS n FROM w_briefs", "w_cites", "w_briefs")
def scl23(spark, sf):
    return briefs(spark, sf).select("doc_id", F.regexp_count(F.lower("text"), F.lit("as held")).cast("long").alias("n"))


# Similarities ----------------------------------------------------------------

_PAIRS = "SELECT a.citation_id, a.iter AS i, b.iter AS j, a.text AS x, b.text AS y FROM w_summaries a JOIN w_summaries b ON a.citation_id = b.citation_id AND a.iter < b.iter"


def summary_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a = derived(spark, sf, "w_summaries")
    left, right = a.select("citation_id", F.col("iter").alias("i"), F.col("text").alias("x")), a.select("citation_id", F.col("iter").alias("j"), F.col("text").alias("y"))
    return left.join(right, "citation_id").where("i < j")


_clean = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
_JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE round(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))), 6) END".format(_words(_clean.format("x")), _words(_clean.format("y")))


@query("scl13_word_jaccard", f"SELECT citation_id, i, j, CAST({_JACCARD} AS DOUBLE) AS sim FROM ({_PAIRS})", "w_summaries")
def scl13(spark, sf):
    return summary_pairs(spark, sf).select("citation_id", "i", "j", F.round(T.word_jaccard(F.col("x"), F.col("y")), 6).alias("sim"))


def mean_similarity(summaries: DataFrame) -> DataFrame:
    """``(citation_id, n, sim)`` of ``summaries(citation_id, iter, text)``: how many there are that say anything, and the mean similarity of two; 1 if there are no two."""
    said = summaries.where("text <> ''")
    left, right = (said.select("citation_id", F.col("iter").alias(i), F.col("text").alias(x)) for i, x in (("i", "x"), ("j", "y")))
    pairs = left.join(right, "citation_id").where("i < j").groupBy("citation_id").agg(F.avg(F.round(T.word_jaccard(F.col("x"), F.col("y")), 6)).alias("mean"))
    counts = summaries.groupBy("citation_id").agg(F.count_if(F.col("text") != "").alias("n"))
    return counts.join(pairs, "citation_id", "left").select("citation_id", "n", F.round(F.coalesce("mean", F.lit(1.0)), 8).alias("sim"))


MEANS = f"""SELECT citation_id, n, round(coalesce(mean, CAST(1 AS DOUBLE)), 8) AS sim FROM (SELECT citation_id, count(*) FILTER (text <> '') AS n FROM w_summaries GROUP BY citation_id)
LEFT JOIN (SELECT citation_id, avg(CAST({_JACCARD} AS DOUBLE)) AS mean FROM ({_PAIRS}) WHERE x <> '' AND y <> '' GROUP BY citation_id) USING (citation_id)"""


@query("agg11_mean_similarity", f"SELECT citation_id, n, sim FROM ({MEANS})", "w_summaries")
def agg11(spark, sf):
    return mean_similarity(derived(spark, sf, "w_summaries"))


@query("scl12_name_similarity", f"SELECT doc_id, i, j, CAST({_sim('x', 'y')} AS DOUBLE) AS sim FROM (SELECT a.doc_id, a.ord AS i, b.ord AS j, {_NORM.format('a.case_name')} AS x, {_NORM.format('b.case_name')} AS y FROM w_cites a JOIN w_cites b ON a.doc_id = b.doc_id AND a.ord < b.ord)", "w_cites")
def scl12(spark, sf):
    name = T.normalize_case_name(N())
    named = cites(spark, sf).select("doc_id", "ord", name.alias("name"), T.words(name).alias("words"))
    a, b = (named.select("doc_id", F.col("ord").alias(k), F.col("name").alias(f"name_{k}"), F.col("words").alias(f"words_{k}")) for k in "ij")
    return a.join(b, "doc_id").where("i < j").select("doc_id", "i", "j", F.round(T.alike(F.col("name_i"), F.col("name_j"), F.col("words_i"), F.col("words_j")), 6).alias("sim"))


# Filters ---------------------------------------------------------------------


def filtered(name: str, condition: Callable[[], Column], sql: str) -> None:
    query(name, f"SELECT doc_id, ord, citation FROM w_cites WHERE {sql}", "w_cites")(lambda spark, sf: cites(spark, sf).where(condition()).select("doc_id", "ord", "citation"))


filtered("flt01_hallucinated", lambda: ~F.col("found"), "NOT found")
filtered("flt02_unverified", lambda: ~F.col("found") & C().isNotNull(), "NOT found AND citation IS NOT NULL")
filtered("flt03_groupable", lambda: N().isNotNull() & (F.lower(N()) != "unknown case"), "case_name IS NOT NULL AND lower(case_name) <> 'unknown case'")
filtered("flt04_westlaw", lambda: T.is_westlaw(C()), WESTLAW)
filtered("flt05_not_lexis", lambda: ~F.contains(F.lower(F.concat(C(), F.when(F.col("page") % 4 == 0, " LEXIS").otherwise(""))), F.lit("lexis")), "page % 4 <> 0")
filtered("flt06_flag", lambda: F.col("found") & (F.col("conf") > 0), "found AND conf > 0")

# Joins -----------------------------------------------------------------------

_FIRST = "SELECT doc_id, ord, citation, item_ord, case_name, absolute_url FROM (SELECT c.doc_id, c.ord, c.citation, m.item_ord, m.case_name, m.absolute_url, row_number() OVER (PARTITION BY c.doc_id, c.ord ORDER BY m.item_ord) AS k FROM w_cites c {0} JOIN w_mirror m ON {1} AND m.status = 200) WHERE k = 1"


def first_match(left: DataFrame, right: DataFrame, on: Column, how: str) -> DataFrame:
    """The first mirror item that matches each citation."""
    hits = left.alias("c").join(right.where("status = 200").alias("m"), on, how)
    hits = hits.groupBy("c.doc_id", "c.ord", "c.citation").agg(F.min_by(F.struct("m.item_ord", "m.case_name", "m.absolute_url"), "m.item_ord").alias("x"))
    return hits.select("doc_id", "ord", "citation", "x.item_ord", "x.case_name", "x.absolute_url")


@query("jon01_first_match", _FIRST.format("", "lower(c.citation) = m.normalized"), "w_cites", "w_mirror")
def jon01(spark, sf):
    return first_match(cites(spark, sf), derived(spark, sf, "w_mirror"), F.lower("c.citation") == F.col("m.normalized"), "inner")


@query("jon02_alternate_format", _FIRST.format("", "replace(replace(c.citation, ' ', ''), '.', '') = replace(replace(m.citation, ' ', ''), '.', '')"), "w_cites", "w_mirror")
def jon02(spark, sf):
    return first_match(cites(spark, sf), derived(spark, sf, "w_mirror"), T.clean_key(F.col("c.citation")) == T.clean_key(F.col("m.citation")), "inner")


@query("jon03_matched_or_null", _FIRST.format("LEFT", "lower(c.citation) = m.normalized"), "w_cites", "w_mirror")
def jon03(spark, sf):
    return first_match(cites(spark, sf), derived(spark, sf, "w_mirror"), F.lower("c.citation") == F.col("m.normalized"), "left")


@query("jon06_cascade", "SELECT c.citation, coalesce(s.source, 'none') AS source, s.name FROM (SELECT DISTINCT citation FROM w_cites) c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY citation ORDER BY priority, name) AS k FROM w_sources) WHERE k = 1) s ON s.citation = c.citation", "w_cites", "w_sources")
def jon06(spark, sf):
    """The first source by priority that knows a citation."""
    best = derived(spark, sf, "w_sources").groupBy("citation").agg(F.min(F.struct("priority", "name", "source")).alias("s"))
    return cites(spark, sf).select("citation").distinct().join(best, "citation", "left").select("citation", F.coalesce("s.source", F.lit("none")).alias("source"), "s.name")


@query("jon08_opinion_cluster", "SELECT doc_id, ord, CAST(list_extract(string_split(rtrim(url, '/'), '/'), -1) AS BIGINT) AS id, p_name FROM w_cites LEFT JOIN part ON p_partkey = CAST(list_extract(string_split(rtrim(url, '/'), '/'), -1) AS BIGINT) WHERE url <> ''", "w_cites")
def jon08(spark, sf):
    own = cites(spark, sf).where("url <> ''").select("doc_id", "ord", T.last_segment(U()).cast("long").alias("id"))
    return own.join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id", "left").select("doc_id", "ord", "id", "p_name")


@query("jon09_exists", "SELECT DISTINCT citation FROM w_cites c WHERE EXISTS (SELECT 1 FROM w_mirror m WHERE m.citation = c.citation AND m.status = 200)", "w_cites", "w_mirror")
def jon09(spark, sf):
    return cites(spark, sf).select("citation").distinct().join(derived(spark, sf, "w_mirror").where("status = 200"), "citation", "left_semi")


@query("jon09_missing", "SELECT DISTINCT citation FROM w_cites c WHERE NOT EXISTS (SELECT 1 FROM w_mirror m WHERE m.citation = c.citation AND m.status = 200)", "w_cites", "w_mirror")
def jon09_missing(spark, sf):
    return cites(spark, sf).select("citation").distinct().join(derived(spark, sf, "w_mirror").where("status = 200"), "citation", "left_anti")


query("jon10_summary_pairs", f"SELECT citation_id, i, j, x, y FROM ({_PAIRS})", "w_summaries")(lambda spark, sf: summary_pairs(spark, sf))


# Aggregates ------------------------------------------------------------------


@query("agg02_normalised_dedup", r"SELECT doc_id, ord, citation FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(citation, '[^\w\d]', '', 'g')) ORDER BY ord) AS k FROM w_cites) WHERE k = 1", "w_cites")
def agg02(spark, sf):
    first = Window.partitionBy("doc_id", T.dedup_key(C())).orderBy("ord")
    return cites(spark, sf).withColumn("k", F.row_number().over(first)).where("k = 1").select("doc_id", "ord", "citation")


@query("agg03_report", "SELECT doc_id, count(*) AS total, count(*) FILTER (NOT found) AS hallucinated, count(*) - count(*) FILTER (NOT found) AS verified FROM w_cites GROUP BY doc_id", "w_cites")
def agg03(spark, sf):
    bad = F.count_if(~F.col("found"))
    return cites(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), bad.alias("hallucinated"), (F.count(F.lit(1)) - bad).alias("verified"))


@query("agg05_success_share", "SELECT count(*) AS total, count(*) FILTER (found) AS good, round(100.0 * count(*) FILTER (found) / count(*), 1) AS pct FROM w_cites", "w_cites")
def agg05(spark, sf):
    return cites(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if("found").alias("good"), F.round(100.0 * F.count_if("found") / F.count(F.lit(1)), 1).alias("pct"))


@query("agg06_by_source", "SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM w_cites WHERE found GROUP BY source", "w_cites")
def agg06(spark, sf):
    counts = cites(spark, sf).where("found").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("source", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))  # one row


_GROUPABLE = "url <> '' AND case_name IS NOT NULL AND lower(case_name) <> 'unknown case'"


@query("agg07_group_by_url", f"SELECT doc_id, url, min(ord) AS first_ord, count(*) AS size, string_agg(citation, '; ' ORDER BY ord) AS members FROM w_cites WHERE {_GROUPABLE} GROUP BY doc_id, url HAVING count(*) >= 2", "w_cites")
def agg07(spark, sf):
    groups = cites(spark, sf).where(_GROUPABLE).groupBy("doc_id", "url").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("ord", "citation"))).alias("m"))
    return groups.where("size >= 2").select("doc_id", "url", "first_ord", "size", F.array_join(F.transform("m", lambda x: x["citation"]), "; ").alias("members"))


_GREEDY = f"""SELECT doc_id, ord, leader FROM (
WITH RECURSIVE named AS (SELECT doc_id, ord, {_NORM.format('case_name')} AS nm FROM w_cites),
good AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM named WHERE nm <> '' AND nm <> 'unknown case'),
walk AS (
  SELECT doc_id, k, ord, ord AS leader, [{{'o': ord, 'nm': nm}}] AS leaders FROM good WHERE k = 1
  UNION ALL
  SELECT doc_id, k, ord, coalesce(hit, ord), CASE WHEN hit IS NULL THEN list_append(leaders, {{'o': ord, 'nm': nm}}) ELSE leaders END FROM (
    SELECT g.doc_id, g.k, g.ord, g.nm, w.leaders, list_filter(w.leaders, lambda l: {_sim('l.nm', 'g.nm')} >= 0.7)[1].o AS hit FROM walk w JOIN good g ON g.doc_id = w.doc_id AND g.k = w.k + 1))
SELECT doc_id, ord, leader FROM walk UNION ALL SELECT doc_id, ord, ord FROM named WHERE nm = '' OR nm = 'unknown case') t"""


@query("agg08_greedy_names", _GREEDY, "w_cites")
def agg08(spark, sf):
    return greedy_groups(cites(spark, sf).select("doc_id", "ord", T.normalize_case_name(N()).alias("name")))


@query("agg13_running_hallucinated", "SELECT doc_id, ord, CAST(sum(CASE WHEN found THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM w_cites", "w_cites")
def agg13(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return cites(spark, sf).select("doc_id", "ord", F.sum(F.when(F.col("found"), 0).otherwise(1)).over(w).alias("n"))


query("agg14_concat_results", "SELECT doc_id, string_agg(citation, ' ' ORDER BY ord) AS summary FROM w_cites GROUP BY doc_id", "w_cites")(lambda spark, sf: cites(spark, sf).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "citation"))), lambda x: x["citation"]), " ").alias("summary")))
query("agg15_distinct_verified", "SELECT DISTINCT citation FROM w_cites WHERE found", "w_cites")(lambda spark, sf: cites(spark, sf).where("found").select("citation").distinct())

# Windows, sorts, sets --------------------------------------------------------

query("win01_positions", "SELECT doc_id, citation, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS INT) AS k FROM w_cites", "w_cites")(lambda spark, sf: cites(spark, sf).select("doc_id", "citation", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("k")))
query("snk01_numbered_list", "SELECT doc_id, ord, ord || '. ' || citation AS line FROM w_cites", "w_cites")(lambda spark, sf: cites(spark, sf).select("doc_id", "ord", F.format_string("%d. %s", "ord", "citation").alias("line")))
query("srt02_most_recent", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")(lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10))
query("srt03_first_three", "SELECT doc_id, ord, citation FROM w_cites WHERE ord <= 3", "w_cites")(lambda spark, sf: cites(spark, sf).where("ord <= 3").select("doc_id", "ord", "citation"))
query("set02_union_distinct", "SELECT citation FROM w_cites WHERE page % 2 = 0 UNION SELECT citation FROM w_cites WHERE page % 3 = 0", "w_cites")(lambda spark, sf: cites(spark, sf).where("page % 2 = 0 OR page % 3 = 0").select("citation").distinct())
query("set03_difference", f"SELECT doc_id, ord FROM w_cites EXCEPT SELECT doc_id, ord FROM w_cites WHERE {_GROUPABLE}", "w_cites")(lambda spark, sf: cites(spark, sf).where(~F.coalesce(F.expr(_GROUPABLE), F.lit(False))).select("doc_id", "ord"))
