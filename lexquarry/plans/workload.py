"""Citation tables derived from the star schema, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The place of a line in its order.
_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus)"

#: What is said of each line, with the part and the customer that it has.
_FIELDS = """
SELECT doc_id, ord, volume, reporter, page, volume || ' ' || reporter || ' ' || page AS citation, case_name, url, found, source, conf, supp, court, date_filed, docket_number
FROM (
  SELECT l_orderkey AS doc_id, CAST(ord AS INT) AS ord, l_partkey AS page, l_suppkey AS supp,
    CASE WHEN l_partkey % 8 = 5 THEN 1990 + l_suppkey % 35 ELSE 1 + l_suppkey END AS volume,
    CASE l_partkey % 8 WHEN 0 THEN 'U.S.' WHEN 1 THEN 'S. Ct.' WHEN 2 THEN 'F.2d' WHEN 3 THEN 'F.3d'
      WHEN 4 THEN 'F. Supp. 2d' WHEN 5 THEN 'WL' WHEN 6 THEN 'Wash. 2d' ELSE 'L. Ed. 2d' END AS reporter,
    CASE WHEN l_partkey % 10 = 0 AND l_suppkey % 2 = 0 THEN NULL WHEN l_partkey % 10 = 0 THEN 'Unknown case'
      WHEN l_partkey % 10 = 1 THEN 'In re ' || p_name WHEN l_partkey % 10 = 2 THEN 'State v. ' || p_name
      ELSE p_name || ' v. ' || coalesce(c_mktsegment, 'Doe') END AS case_name,
    CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '/opinion/' || (l_partkey % 50) || '/' END AS url,
    l_partkey % 7 <> 0 AS found,
    CASE l_suppkey % 3 WHEN 0 THEN 'citation_api' WHEN 1 THEN 'search_api' ELSE 'scholar' END AS source,
    CAST(l_partkey % 10 AS DOUBLE) / 10 AS conf,
    CASE WHEN l_suppkey % 4 = 0 THEN 'Unknown court' WHEN l_partkey % 8 = 6 THEN 'wash' ELSE 'scotus' END AS court,
    CASE WHEN l_partkey % 3 = 0 THEN 'Unknown date' ELSE '' || CAST(l_shipdate AS DATE) END AS date_filed,
    CASE WHEN l_suppkey % 3 = 0 THEN 'Unknown docket number' ELSE l_orderkey || '-' || l_linenumber END AS docket_number
"""

W_CITES = f"""{_FIELDS}  FROM (
    SELECT *, {_PLACE} AS ord
    FROM lineitem
  ) l
  JOIN part ON p_partkey = l_partkey
  LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
) x
"""

SENTENCE = "'As held in ' || coalesce(case_name, 'the case') || ', ' || CASE ord % 3 WHEN 0 THEN replace(citation, ' ', '  ') WHEN 1 THEN replace(citation, ' ', chr(10)) ELSE citation END || ', it was so.'"

W_BRIEFS = f"SELECT doc_id, string_agg({SENTENCE}, ' ' ORDER BY ord) AS text FROM w_cites GROUP BY doc_id"

#: Two items a citation, so that the first has to win; one in eleven was not found.
W_MIRROR = """
SELECT 2 * page + k AS item_ord, citation, lower(citation) AS normalized, CASE WHEN (page + k) % 11 = 0 THEN 404 ELSE 200 END AS status,
  'Case ' || page || ' of ' || k AS case_name, '/opinion/' || page || '/' AS absolute_url
FROM (SELECT DISTINCT citation, page FROM w_cites WHERE page % 5 <> 1) c CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) two
"""

#: Lower-priority sources that overlap in part.
W_SOURCES = """
SELECT DISTINCT 1 AS priority, 'citation_api' AS source, citation, 'C' || page AS name FROM w_cites WHERE page % 2 = 0
UNION ALL SELECT DISTINCT 2, 'search_api', citation, 'S' || page FROM w_cites WHERE page % 3 = 0
UNION ALL SELECT DISTINCT 3, 'cluster_api', citation, 'K' || page FROM w_cites WHERE page % 5 = 0
UNION ALL SELECT DISTINCT 4, 'web_search', citation, 'W' || page FROM w_cites WHERE page % 7 = 0
UNION ALL SELECT DISTINCT 5, 'scholar', citation, 'G' || page FROM w_cites WHERE page % 11 = 0
"""

#: Three summaries an id that together hold the whole text: the words at places 0, 3, 6 ..., 1, 4, 7 ... and 2, 5, 8 ... (DuckDB's side; Spark's is ``summaries``).
W_SUMMARIES = r"""
SELECT citation_id, iter, array_to_string(list_filter(words, lambda w, k: (k - 1) % 3 = iter), ' ') AS text
FROM (SELECT doc_id AS citation_id, list_filter(regexp_split_to_array(text, '[\t-\r\x{85}\p{Z}]+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL)
CROSS JOIN (SELECT 0 AS iter UNION ALL SELECT 1 AS iter UNION ALL SELECT 2 AS iter) i
"""

#: The five fields of a case record, any of which may be unknown.
W_RECORDS = """
SELECT doc_id, ord, page, reporter, url, found, coalesce(case_name, 'Unknown case name') AS case_name, court, date_filed, docket_number,
  CASE WHEN page % 6 = 0 THEN 'Unknown citation' ELSE citation END AS citation
FROM w_cites
"""

#: Three search hits of each citation, of several courts; equal scores occur.
W_HITS = """
SELECT citation, reporter, page * 3 + k AS hit_id, CAST((page * 7 + k * 13) % 5 AS DOUBLE) / 4 AS score,
  CASE (page + k) % 6 WHEN 0 THEN 'wash' WHEN 1 THEN 'scotus' WHEN 2 THEN 'washctapp' WHEN 3 THEN 'ca9' WHEN 4 THEN 'washag' ELSE 'nysd' END AS court,
  'Hit ' || k || ' of ' || page AS case_name, '/opinion/' || page || '/' || k || '/' AS absolute_url
FROM (SELECT DISTINCT citation, reporter, page FROM w_cites WHERE page % 7 <> 3) c CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) three
"""

#: What the lookup answered for each brief: a list, an object with citations, or something else.
W_ANSWERS = """
SELECT doc_id, ord, citation, found, CASE doc_id % 5 WHEN 0 THEN '[{"citation": "' || citation || '"}]' WHEN 1 THEN '{"citations": {"a": 1}}'
  WHEN 2 THEN '{"detail": "Request was throttled."}' WHEN 3 THEN 'Service unavailable' ELSE '[]' END AS answer
FROM w_cites
"""

#: Items of the lookup's answer to each brief, some of which hold a citation within other words.
W_ITEMS = """
SELECT doc_id, ord AS item_ord, CASE WHEN ord % 2 = 0 THEN 'See ' || upper(citation) || ', at 5' ELSE citation END AS item, case_name FROM w_cites WHERE page % 9 <> 0
"""

#: Cases as a lookup returns them: some fields missing, and the parts of each citation of the case.
W_CLUSTERS = """
SELECT page AS id, max(CASE WHEN court <> 'Unknown court' THEN court END) AS court, max(CASE WHEN date_filed <> 'Unknown date' THEN date_filed END) AS date_filed, volume, reporter
FROM w_cites WHERE found GROUP BY page, volume, reporter
"""

#: An item of the lookup's answer in its nested form. Some items know a citation by its normalised spelling, some only among
#: the citations of their first case; some were not found; a case may lack a URL, or a name, or have a name that is null.
LOOKUP_ITEM = """'{"citation": "' || citation || '", "normalized_citations": ' || CASE page % 4 WHEN 1 THEN '[]' WHEN 2 THEN '["' || upper(citation) || '"]' ELSE '["' || citation || '", "' || citation || ' n. 2"]' END
  || ', "status": ' || CASE WHEN page % 11 = 0 THEN '404, "error_message": "Citation not found", "clusters": []}' ELSE '200, "error_message": "", "clusters": [{"id": ' || page
  || CASE WHEN page % 5 = 0 THEN '' WHEN page % 5 = 1 THEN ', "absolute_url": "https://example.net/opinion/' || page || '/"' ELSE ', "absolute_url": "/opinion/' || page || '/"' END
  || CASE page % 7 WHEN 1 THEN '' WHEN 2 THEN ', "case_name": null' WHEN 3 THEN ', "case_name": "Unknown case"' ELSE ', "case_name": "Case ' || page || '"' END
  || ', "citations": [{"volume": ' || (volume + 1) || ', "reporter": "L. Ed. 2d", "page": "' || page || '", "type": 1}, {"volume": ' || volume || ', "reporter": "' || replace(reporter, ' ', '') || '", "page": "' || page || '", "type": 1}]}'
  || CASE WHEN page % 3 = 0 THEN ', {"id": 0, "case_name": "Second case", "citations": []}' ELSE '' END || ']}' END"""

#: The lookup's answer to each brief; one in nineteen is not an answer.
W_LOOKUP = f"""
SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'Service unavailable' ELSE '[' || string_agg({LOOKUP_ITEM}, ', ' ORDER BY ord) || ']' END AS answer FROM w_cites WHERE page % 9 <> 0 GROUP BY doc_id
"""

#: What other services say of each citation: two summaries with their responses, whether there is a key, and what went wrong.
W_CHECKS = """
SELECT doc_id, ord, page, citation, reporter, case_name, url, found, page % 17 <> 0 AS has_key, CASE WHEN page % 13 = 0 THEN 500 ELSE 200 END AS first_status, CASE WHEN page % 13 = 1 THEN 429 ELSE 200 END AS second_status,
  CASE page % 12 WHEN 2 THEN 'We were Unable to find this case.' WHEN 3 THEN 'Too short.' WHEN 4 THEN '' ELSE 'The case ' || citation || ' turns on whether notice was given before the contract ended.' END AS first_text,
  CASE page % 12 WHEN 5 THEN 'There is NO INFORMATION on it.' WHEN 6 THEN 'Also short.' WHEN 3 THEN 'Short, too.' WHEN 7 THEN 'Nobody remembers anything; several witnesses described unrelated events elsewhere.' ELSE 'In ' || citation || ' the court asked whether notice was given before the contract ended.' END AS second_text,
  CASE page % 19 WHEN 1 THEN 'generation' WHEN 2 THEN 'similarity' WHEN 3 THEN 'none' WHEN 4 THEN 'other' END AS problem,
  CASE WHEN page % 23 = 0 THEN 500 WHEN page % 23 = 1 THEN 429 ELSE 200 END AS service_status,
  CASE WHEN page % 29 = 0 THEN '  ' WHEN page % 29 = 1 THEN 'see Pringle v JP Morgan Chase, ' || citation WHEN page % 29 < 6 THEN replace(citation, reporter, 'U.S. LEXIS') ELSE citation END AS asked
FROM w_cites
"""

#: Result pages: a page with what was searched for, which every other page holds, and a result's title on three in four.
W_RESULTS = """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Result for ' || page_id || ' U.S. ' || (page_id % 997) ELSE 'no such words ' || page_id END AS asked,
  CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<h3 class="gs_rt"><a href="/x?' || page_id || '">Page ' || page_id || ' v. State</a></h3>' WHEN 2 THEN '<h3 class="gs_rt">' || chr(10) || '  <a id="a" href="#">In re ' || page_id || '</a></h3><h3 class="gs_rt"><a>Second</a></h3>'
    ELSE '<h3 class="gs_rt"><a></a></h3>' END || html || '<p>Result for ' || page_id || ' U.S. ' || (page_id % 997) || '</p>' AS html
FROM pages
"""

#: What two sources say of each citation: a summary of the web, where there is one, and the lookup's, which may report a failure.
W_TOLD = """
SELECT doc_id, ord, citation, CASE WHEN page % 3 = 0 THEN 'Web summary of ' || citation END AS web,
  CASE page % 5 WHEN 0 THEN 'Error: timed out' WHEN 1 THEN 'Case citation not found' WHEN 2 THEN 'CourtListener API is not available' ELSE 'Case Summary: ' || citation END AS lookup
FROM w_cites
"""

#: Bodies of requests that hold a citation under one of three names, or blanks only; one line break is written as JSON has it.
W_BODIES = """
SELECT doc_id, ord, CASE ord % 4 WHEN 0 THEN '{"brief_text": "  ' || citation || ' "}' WHEN 1 THEN '{"briefText": "' || citation || '"}'
  WHEN 2 THEN '{"text": "' || citation || chr(92) || 'n", "id": 1}' ELSE '{"text": " "}' END AS body
FROM w_cites
"""

CTES = {"w_told": W_TOLD, "w_bodies": W_BODIES, "w_results": W_RESULTS, "w_lookup": W_LOOKUP, "w_checks": W_CHECKS, "w_cites": W_CITES, "w_briefs": W_BRIEFS, "w_mirror": W_MIRROR, "w_sources": W_SOURCES, "w_summaries": W_SUMMARIES, "w_records": W_RECORDS, "w_hits": W_HITS, "w_answers": W_ANSWERS, "w_items": W_ITEMS, "w_clusters": W_CLUSTERS}


def oracle(body: str, *names: str) -> str:
    """SQL for DuckDB with the derived tables that it needs."""
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in names) + " " + body


def _sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(query.format(**{k: "{" + k + "}" for k in tables}) if tables else query, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations, as ``W_CITES`` states them; a document's rows are in one partition, so what goes by document needs no further shuffle.

    Lines travel twice: to their parts, and with the parts' names to their orders,
    where they get their places and the customer's segment. A part's names meet a
    line as an array, since a line has one place however many parts have its key.
    """
    lines, part, orders, customer = (table(spark, sf_dir, n) for n in ("lineitem", "part", "orders", "customer"))
    names = part.groupBy("p_partkey").agg(F.transform(F.collect_list(F.struct("p_name")), lambda x: x["p_name"]).alias("names"))
    segments = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").select("o_orderkey", "c_mktsegment")
    placed = lines.join(names, lines["l_partkey"] == names["p_partkey"], "left").withColumn("ord", F.expr(_PLACE))
    met = placed.join(segments, placed["l_orderkey"] == segments["o_orderkey"], "left")
    rows = met.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "ord", "c_mktsegment", F.explode("names").alias("p_name"))
    return spark.sql(f"{_FIELDS}  FROM {{rows}}\n) x", rows=rows)


def in_order(rows: DataFrame, said: Column, between: str) -> DataFrame:
    """``(doc_id, text)``: what is said of a document's citations, in their order."""
    met = rows.select("doc_id", "ord", said.alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "s"))).alias("x"))
    return met.select("doc_id", F.array_join(F.transform("x", lambda x: x["s"]), between).alias("text"))


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brief a document: its sentences in order. A document has few sentences."""
    return in_order(cites(spark, sf_dir), F.expr(SENTENCE), " ")


def lookup_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, answer)``, as ``W_LOOKUP`` states them."""
    rows = cites(spark, sf_dir).where("page % 9 <> 0").withColumn("said", F.expr(LOOKUP_ITEM))
    return in_order(rows, F.col("said"), ", ").select("doc_id", F.when(F.col("doc_id") % 19 == 0, "Service unavailable").otherwise(F.concat(F.lit("["), "text", F.lit("]"))).alias("answer"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three summaries an id that together hold the whole text: the words at places 0, 3, 6 ..., 1, 4, 7 ... and 2, 5, 8 ..."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("citation_id"), words.alias("words"), F.explode(F.array(*map(F.lit, range(3)))).alias("iter"))
    return docs.select("citation_id", "iter", F.array_join(F.filter("words", lambda w, k: k % 3 == F.col("iter")), " ").alias("text"))


#: Priority, name, divisor of the page and letter of each source of ``W_SOURCES``.
SOURCES = [(1, "citation_api", 2, "C"), (2, "search_api", 3, "S"), (3, "cluster_api", 5, "K"), (4, "web_search", 7, "W"), (5, "scholar", 11, "G")]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``W_SOURCES`` in one pass over the citations."""
    known = cites(spark, sf_dir).select("citation", "page").distinct()
    rows = F.array(*(F.when(F.col("page") % d == 0, F.struct(F.lit(k).alias("priority"), F.lit(name).alias("source"), F.concat(F.lit(letter), F.col("page").cast("string")).alias("name"))) for k, name, d, letter in SOURCES))
    return known.select("citation", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.priority", "r.source", "citation", "r.name")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("w_summaries", "w_sources"):
        return (summaries if name == "w_summaries" else sources)(spark, sf_dir)
    if name == "w_lookup":
        return lookup_answers(spark, sf_dir)
    if name == "w_results":
        return spark.sql(W_RESULTS.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    query = CTES[name].replace("{", "{{").replace("}", "}}").replace("FROM w_cites", "FROM {w_cites}")
    return spark.sql(query, w_cites=cites(spark, sf_dir))
