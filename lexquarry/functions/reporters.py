"""Citations in whatever spelling of their reporter, and the spelling that is right.

One pattern, built from the editions below, finds all spellings in one scan of a
text; what it finds is looked up under its letters and digits alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Each edition as it is cited, and what else its parts may be.
EDITIONS = ["U.S.", "S. Ct.", "L. Ed.", "L. Ed. 2d", "F.", "F.2d", "F.3d", "F.4th", "F. Supp.", "F. Supp. 2d", "F. Supp. 3d", "F.R.D.", "B.R.", "WL", "Wash.", "Wash. 2d", "Wash. App.", "P.", "P.2d", "P.3d"]
OTHER_SPELLINGS = {"Wash. 2d": ["Wn. 2d"], "Wash. App.": ["Wn. App."], "F.": ["Fed."], "F. Supp.": ["Fed. Supp."], "S. Ct.": ["Sup. Ct."], "P.": ["Pac."]}


def key_of(spelling: str) -> str:
    return re.sub(r"[\s.]", "", spelling).lower()


#: Edition by key; every edition under its own and its other spellings.
BY_KEY = {key_of(s): e for e in EDITIONS for s in [e, *OTHER_SPELLINGS.get(e, [])]}


def _pattern(spelling: str) -> str:
    """A spelling whose points may be missing, and whose spaces may be missing or more."""
    parts = re.findall(r"\d+[a-z]*|[A-Z](?:[a-z]+|L\b)?|[a-z]+", spelling)
    return r"\.?\s*".join(parts) + r"\.?"


_SPELLINGS = sorted((s for e in EDITIONS for s in [e, *OTHER_SPELLINGS.get(e, [])]), key=lambda s: (-len(key_of(s)), s))
#: Volume, reporter and page; longer editions are tried first.
CITATION = r"\b(\d+)\s+(" + "|".join(_pattern(s) for s in _SPELLINGS) + r")\s+(\d+)\b"


def corrected_citations(text: Column) -> Column:
    """Array of structs (found, corrected) of all citations of a text, in order."""
    one = F.regexp_replace(text, r"(?U)\s+", " ")
    parts = [F.regexp_extract_all(one, F.lit(f"(?i){CITATION}"), group).alias(name) for group, name in enumerate(("found", "volume", "reporter", "page"))]
    editions = F.create_map(*(F.lit(x) for kv in BY_KEY.items() for x in kv))
    return F.transform(F.arrays_zip(*parts), lambda r: F.struct(r["found"].alias("found"), F.concat_ws(" ", r["volume"], F.try_element_at(editions, F.lower(F.translate(r["reporter"], " .", ""))), r["page"]).alias("corrected")))


def corrected(texts: DataFrame) -> DataFrame:
    """``(doc_id, ord, found, corrected)`` of texts ``(doc_id, text)``: distinct corrected citations by first place, each as it was first written."""
    every = texts.select("doc_id", F.posexplode(corrected_citations(F.col("text"))).alias("at", "c"))
    first = every.groupBy("doc_id", "c.corrected").agg(F.min(F.struct("at", "c.found")).alias("x"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("x.at"))
    return first.select("doc_id", place.alias("ord"), F.col("x.found").alias("found"), "corrected")
