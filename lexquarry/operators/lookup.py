"""A citation lookup's nested answer, matched with a document's citations in two stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import reporters as R
from lexquarry.functions import text as T
from lexquarry.operators.queries import HOST, query
from lexquarry.plans.workload import briefs, cites, derived

# Fixed value: the name of a case that has none.
UNKNOWN_CASE = "Unknown case"

#: An answer's items; a case is kept as JSON, since a name that is missing is not a name that is null.
ITEMS = "array<struct<citation: string, normalized_citations: array<string>, status: int, error_message: string, clusters: array<string>>>"
CASE = "struct<absolute_url: string, case_name: string, citations: array<struct<volume: int, reporter: string, page: string>>>"


#: Code points of an answer up to which its items are asked one by one, as one row; a longer one's are told apart by what they know.
_SHORT = 1 << 14


def lookup_items(answers: DataFrame) -> DataFrame:
    """``(doc_id, item_ord, status, normalized, named, case)`` of answers ``(doc_id, answer)``: items in order, each with its first case.

    An answer that is no list of items has none. named: whether the case has the field of a name at all.
    """
    items = answers.select("doc_id", F.posexplode(F.from_json("answer", ITEMS)).alias("item_ord", "x")).where("x is not null")
    return items.select("doc_id", "item_ord", F.col("x.status").alias("status"), F.col("x.normalized_citations").alias("normalized"), *_first_case(F.col("x")))


def _first_case(x: Column) -> tuple[Column, Column]:
    first = F.get(x["clusters"], F.lit(0))
    return F.array_contains(F.json_object_keys(first), "case_name").alias("named"), F.from_json(first, CASE).alias("case")


def _same(c: Column) -> Column:
    return F.lower(c)


def _knows(x: Column, host: str) -> list[Column]:
    """Of an item with its first case: what it says of a citation that it knows, and both stages' keys."""
    name = F.when(x["case"].isNotNull(), F.when(x["named"], x["case"]["case_name"]).otherwise(UNKNOWN_CASE))
    spelt = F.transform(x["normalized"], _same)
    parts = F.transform(x["case"]["citations"], lambda c: T.clean_key(F.concat_ws(" ", c["volume"].cast("string"), c["reporter"], c["page"])))
    return [x["item_ord"].alias("item_ord"), name.alias("case_name"), T.absolute_url(x["case"]["absolute_url"], host).alias("url"), F.coalesce(spelt, F.array().cast("array<string>")).alias("spelt"), F.coalesce(parts, F.array().cast("array<string>")).alias("parts")]


def match_lookup(citations: DataFrame, answers: DataFrame, strict: bool = True, host: str = HOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, ord, citation, item_ord, stage, case_name, url)``, and the columns ``carry``: every citation with the first item of its document's answer that knows it.

    Items are asked in order, and each in two stages: 1, one of its normalised
    spellings is the citation, whatever the case of letters; 2, one of the
    citations of its first case is, spaces and points aside. The first item that
    knows the citation in either stage wins; item_ord is null if none does.

    strict: only items that were found and have a case. Otherwise an item that was
    not found can match by its own spelling, and has neither name nor URL then.

    Equal rows are one, unless they carry something. Short answers meet their
    documents' citations by document alone, so what holds a document's rows
    together is not shuffled; documents with long ones go by document and key.
    """
    rows = citations.select("doc_id", "ord", "citation", *carry)
    rows = rows if carry else rows.distinct()
    rows, lost = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")  # apart, so that both sides of the join read the same
    answers = answers.where("doc_id IS NOT NULL")
    long = F.sum(F.length("answer")).over(Window.partitionBy("doc_id")) > _SHORT
    sized = answers.select("doc_id", "answer", F.coalesce(long, F.lit(False)).alias("long"))
    apart = sized.where("long")
    in_order = asked_in_order(rows, sized, strict, host, carry)
    by_key = asked_by_key(rows.join(apart.select("doc_id").distinct(), "doc_id", "left_semi"), apart, strict, host, carry)
    none = lost.select("doc_id", "ord", "citation", *(F.lit(None).cast(in_order.schema[c].dataType).alias(c) for c in ("item_ord", "stage", "case_name", "url")), *carry)
    return in_order.unionByName(by_key).unionByName(none)


def _found(strict: bool):
    """Whether a match may rest on an item with its first case."""
    return lambda x: (x["status"] == 200) & x["case"].isNotNull() if strict else F.lit(True)


def asked_in_order(rows: DataFrame, sized: DataFrame, strict: bool, host: str, carry: tuple[str, ...]) -> DataFrame:
    """``match_lookup`` of the citations whose documents have no long answer, of answers ``(doc_id, answer, long)``."""
    items = F.filter(F.transform(F.from_json("answer", ITEMS), lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("item_ord"), x["status"].alias("status"), x["normalized_citations"].alias("normalized"), *_first_case(x)))), lambda x: x.isNotNull())
    known = F.transform(F.filter("items", _found(strict)), lambda x: F.struct(*_knows(x, host)))
    read = sized.select("doc_id", "long", F.when(~F.col("long"), items).alias("items")).select("doc_id", "long", known.alias("known"))
    docs = read.groupBy("doc_id").agg(F.max("long").alias("long"), F.array_sort(F.flatten(F.collect_list("known"))).alias("known"))
    asked = rows.select("*", _same(F.col("citation")).alias("spelling"), T.clean_key(F.col("citation")).alias("key"))
    first = F.get(F.filter("known", lambda x: F.array_contains(x["spelt"], F.col("spelling")) | F.array_contains(x["parts"], F.col("key"))), F.lit(0))
    met = asked.join(docs, "doc_id", "left").where(~F.coalesce("long", F.lit(False))).select("doc_id", "ord", "citation", *carry, "spelling", first.alias("m"))
    stage = F.when(F.array_contains("m.spelt", F.col("spelling")), 1).when(F.col("m").isNotNull(), 2)
    return met.select("doc_id", "ord", "citation", "m.item_ord", stage.alias("stage"), "m.case_name", "m.url", *carry)


def asked_by_key(rows: DataFrame, answers: DataFrame, strict: bool, host: str, carry: tuple[str, ...]) -> DataFrame:
    """``match_lookup`` of citations and answers of any length."""
    items = lookup_items(answers)
    known = items.where(_found(strict)({c: F.col(c) for c in items.columns})).select("doc_id", *_knows({c: F.col(c) for c in items.columns}, host))
    spelt = F.transform("spelt", lambda k: F.struct(F.lit(1).alias("stage"), k.alias("key")))
    parts = F.transform("parts", lambda k: F.struct(F.lit(2).alias("stage"), k.alias("key")))
    keys = known.select("doc_id", "item_ord", "case_name", "url", F.explode(F.concat(spelt, parts)).alias("k"))
    first = keys.groupBy("doc_id", "k.stage", "k.key").agg(F.min_by(F.struct("item_ord", "case_name", "url"), "item_ord").alias("x"))
    asked = F.explode(F.array(F.struct(F.lit(1).alias("stage"), _same(F.col("citation")).alias("key")), F.struct(F.lit(2).alias("stage"), T.clean_key(F.col("citation")).alias("key"))))
    hits = rows.select("*", asked.alias("a")).select("doc_id", "ord", "citation", *carry, "a.*").join(first, ["doc_id", "stage", "key"], "left")
    every = F.collect_list(F.when(F.col("stage") == 1, F.struct(F.lit(1).alias("one"), *carry)))
    best = hits.groupBy("doc_id", "ord", "citation").agg(F.min(F.when(F.col("x").isNotNull(), F.struct("x.item_ord", "stage", "x.case_name", "x.url"))).alias("m"), every.alias("c"))
    return best.select("doc_id", "ord", "citation", "m.item_ord", "m.stage", "m.case_name", "m.url", F.explode("c").alias("c")).select("doc_id", "ord", "citation", "item_ord", "stage", "case_name", "url", *(f"c.{x}" for x in carry))


# The same in SQL: an answer's items by position, then both stages' keys.
_ITEMS = """SELECT doc_id, CAST(k AS INT) AS item_ord, CAST(item ->> '$.status' AS INT) AS status, CAST(item -> '$.normalized_citations' AS VARCHAR[]) AS normalized, item -> '$.clusters[0]' AS "case"
FROM (SELECT doc_id, k, json_extract(answer, '$[' || k || ']') AS item FROM (SELECT doc_id, answer, unnest(range(CAST(json_array_length(answer) AS BIGINT))) AS k FROM (SELECT doc_id, CAST(answer AS JSON) AS answer FROM w_lookup WHERE json_valid(answer))))"""
_NAMED = f"""SELECT doc_id, item_ord, CASE WHEN "case" IS NOT NULL THEN CASE WHEN json_exists("case", '$.case_name') THEN "case" ->> '$.case_name' ELSE '{UNKNOWN_CASE}' END END AS case_name,
  CASE WHEN starts_with("case" ->> '$.absolute_url', 'http') THEN "case" ->> '$.absolute_url' ELSE '{HOST}' || ("case" ->> '$.absolute_url') END AS url, normalized, "case" -> '$.citations' AS citations
FROM ({_ITEMS}) WHERE {{0}}"""
_KEYS = f"""SELECT doc_id, item_ord, case_name, url, 1 AS stage, lower(unnest(normalized)) AS key FROM ({_NAMED})
UNION ALL SELECT doc_id, item_ord, case_name, url, 2, replace(replace(json_extract_string(c, '$.volume') || json_extract_string(c, '$.reporter') || json_extract_string(c, '$.page'), ' ', ''), '.', '')
FROM (SELECT doc_id, item_ord, case_name, url, json_extract(citations, '$[' || k || ']') AS c FROM (SELECT *, unnest(range(CAST(json_array_length(citations) AS BIGINT))) AS k FROM ({_NAMED})))"""
MATCHED = f"""SELECT doc_id, ord, citation, item_ord, stage, case_name, url FROM (SELECT c.doc_id, c.ord, c.citation, m.item_ord, m.stage, m.case_name, m.url, row_number() OVER (PARTITION BY c.doc_id, c.ord ORDER BY m.item_ord, m.stage) AS k
FROM w_cites c LEFT JOIN ({_KEYS}) m ON m.doc_id = c.doc_id AND m.key = CASE m.stage WHEN 1 THEN lower(c.citation) ELSE replace(replace(c.citation, ' ', ''), '.', '') END) WHERE k = 1"""
STRICT = """status = 200 AND "case" IS NOT NULL"""


@query("jon03_two_stages", MATCHED.format(STRICT), "w_cites", "w_lookup")
def jon03_two_stages(spark, sf):
    """Each citation's first item by normalised spelling, else by the citations of its case, out of the nested answer."""
    return match_lookup(cites(spark, sf), derived(spark, sf, "w_lookup"))


@query("jon03_two_stages_lenient", MATCHED.format("true"), "w_cites", "w_lookup")
def jon03_lenient(spark, sf):
    """The same, where items that were not found match by their own spelling."""
    return match_lookup(cites(spark, sf), derived(spark, sf, "w_lookup"), strict=False)


@query("src10_lookup_items", f"""SELECT doc_id, item_ord, status, array_to_string(normalized, '; ') AS normalized, "case" ->> '$.case_name' AS case_name, CAST(coalesce(json_array_length("case" -> '$.citations'), 0) AS INT) AS n_citations FROM ({_ITEMS})""", "w_cites", "w_lookup")
def src10(spark, sf):
    """The items of every answer, with their first case."""
    items = lookup_items(derived(spark, sf, "w_lookup"))
    return items.select("doc_id", "item_ord", "status", F.array_join("normalized", "; ").alias("normalized"), "case.case_name", F.coalesce(F.size("case.citations"), F.lit(0)).alias("n_citations"))


# Spellings of reporters -----------------------------------------------------

_VARIED = "replace(replace(replace(replace(text, 'S. Ct.', 'Sup.Ct.'), 'L. Ed. 2d', 'l ed 2D'), 'Wash. 2d', 'Wn.2d'), 'F. Supp. 2d', 'F.Supp.  2d')"
_PARTS = ", ".join(f"regexp_extract_all(t, '{R.CITATION}', {i}, 'i') AS p{i}" for i in range(4))
_EDITION = "CASE lower(replace(replace(p2[k], ' ', ''), '.', '')) " + " ".join(f"WHEN '{k}' THEN '{e}'" for k, e in R.BY_KEY.items()) + " END"


@query("scl04_corrected_citations", f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS ord, found, corrected FROM (SELECT doc_id, corrected, min(k) AS k, min_by(found, k) AS found FROM (
SELECT doc_id, k, p0[k] AS found, p1[k] || ' ' || {_EDITION} || ' ' || p3[k] AS corrected FROM (SELECT *, unnest(range(1, len(p0) + 1)) AS k FROM (SELECT doc_id, {_PARTS} FROM (SELECT doc_id, regexp_replace({_VARIED}, '\\s+', ' ', 'g') AS t FROM w_briefs)))) GROUP BY doc_id, corrected)""", "w_cites", "w_briefs")
def scl04(spark, sf):
    """Citations of briefs that spell reporters in several ways, by their right spelling."""
    return R.corrected(briefs(spark, sf).select("doc_id", F.expr(_VARIED).alias("text")))
