"""Text functions over columns: citations, case names and their similarities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The citation patterns of eight reporters, in the order in which matches are listed.
CITATION_PATTERNS = [
    r"\b\d+\s+U\.?\s*S\.?\s+\d+\b",
    r"\b\d+\s+S\.?\s*Ct\.?\s+\d+\b",
    r"\b\d+\s+F\.?\s*(?:2d|3d)?\s+\d+\b",
    r"\b\d+\s+F\.?\s*Supp\.?\s*(?:2d|3d)?\s+\d+\b",
    r"\b\d{4}\s+WL\s+\d+\b",
    r"\b\d+\s+F\.R\.D\.\s+\d+\b",
    r"\b\d+\s+B\.R\.\s+\d+\b",
    r"\b\d+\s+L\.\s*Ed\.\s*(?:2d)?\s+\d+\b",
]
# Fixed value: two parties around "v."
PARTY_PATTERN = r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+v\.?\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)"
WESTLAW_PATTERN = r"(\d{4})\s*W\.?\s*L\.?\s*(\d+)"
# Fixed value: a Westlaw citation in small letters, as citations are told apart.
WESTLAW_KEY_PATTERN = r"(\d{4})(?:\s*w\.?\s*l\.?\s*)(\d+)"
# Spellings of the state's reporters, of which the first that fits is made regular, and that reporter.
WASHINGTON_FORMATS = [(r"(\d+)\s+Wash\.?\s*2d\s+(\d+)", "Wash. 2d"), (r"(\d+)\s+Wash\.?\s+(\d+)", "Wash."), (r"(\d+)\s+Wash\.?\s*App\.?\s+(\d+)", "Wash. App.")]
# Fixed value: a citation of the state's reporters in a case name.
WASHINGTON_PATTERN = r"(\d+\s+Wash\.\s+(?:2d|App\.)?\s+\d+)"
# Volume, reporter and page, of which the first that fits counts.
PARTS_PATTERNS = [r"(\d+)\s+([A-Za-z\.\s]+)\s+(\d+)", r"(\d+)\s+([A-Za-z\.\s]+\d+[a-z]*\s+)\s*(\d+)"]
# Prefixes of case names, of which the first that fits is dropped.
CASE_PREFIXES = ["in re ", "state v. ", "state of washington v. "]
# Phrases by which a summary says that it knows nothing.
DENIALS = ["unable to find", "no information", "not a valid"]


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def extract_citations(c: Column, patterns: int = 8) -> Column:
    """Distinct citations, by pattern and then position; 5 patterns for the short list."""
    text = collapse_whitespace(c)
    found = [F.regexp_extract_all(text, F.lit(f"(?i){p}"), 0) for p in CITATION_PATTERNS[:patterns]]
    return F.array_distinct(F.concat(*found))


def extract_parties(c: Column) -> Column:
    first, second = (F.regexp_extract_all(c, F.lit(PARTY_PATTERN), i) for i in (1, 2))
    return F.array_distinct(F.zip_with(first, second, lambda a, b: F.concat(a, F.lit(" v "), b)))


def is_westlaw(c: Column) -> Column:
    return c.rlike(WESTLAW_PATTERN)


def westlaw(c: Column) -> Column:
    """"{year} WL {number}" if the text holds a Westlaw citation, else the text."""
    return F.when(is_westlaw(c), F.concat_ws(" WL ", F.regexp_extract(c, WESTLAW_PATTERN, 1), F.regexp_extract(c, WESTLAW_PATTERN, 2))).otherwise(c)


def dedup_key(c: Column) -> Column:
    """Key under which spellings of a citation are one (upper-case W and L only occur before lower-casing)."""
    low = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    pattern = WESTLAW_KEY_PATTERN
    return F.when(low.rlike(pattern), F.concat_ws("wl", F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2))).otherwise(F.regexp_replace(low, r"(?U)[^\w\d]", ""))


def washington_format(c: Column) -> Column:
    out = c
    for pattern, name in reversed(WASHINGTON_FORMATS):
        out = F.when(c.rlike(f"(?i){pattern}"), F.regexp_replace(c, f"(?i){pattern}", f"$1 {name} $2")).otherwise(out)
    return out


def washington_citation(c: Column) -> Column:
    return F.regexp_extract(c, WASHINGTON_PATTERN, 1)


def citation_parts(c: Column) -> Column:
    """Struct of volume, reporter, page; null if no pattern fits."""
    out = F.lit(None)
    for p in reversed(PARTS_PATTERNS):
        parts = [F.regexp_extract(c, p, i) for i in (1, 2, 3)]
        out = F.when(c.rlike(p), F.struct(parts[0].alias("volume"), F.trim(parts[1]).alias("reporter"), parts[2].alias("page"))).otherwise(out)
    return out


def normalize_case_name(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    cut = low
    for prefix in reversed(CASE_PREFIXES):
        cut = F.when(low.startswith(prefix), F.substring(low, len(prefix) + 1, 1 << 30)).otherwise(cut)
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def clean_key(c: Column) -> Column:
    return F.translate(c, " .", "")


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def _share(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def alike(a: Column, b: Column, words_a: Column, words_b: Column) -> Column:
    """Of normalised names and their words: 0 if one is empty, 1 if equal, 0.8 if one holds the other, else the words' Jaccard."""
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(F.contains(a, b) | F.contains(b, a), F.lit(0.8))
        .otherwise(_share(words_a, words_b))
    )


def name_similarity(a: Column, b: Column) -> Column:
    """``alike`` of two names whose words are not at hand."""
    return alike(a, b, words(a), words(b))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = (words(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " ")) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(_share(x, y))


def overlap_similarity(a: Column, b: Column) -> Column:
    x, y = words(F.lower(a)), words(F.lower(b))
    return F.when(F.greatest(F.size(x), F.size(y)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def confidence(average: Column, threshold: Column) -> Column:
    return F.least(2 * F.abs(average - threshold) / F.greatest(threshold, 1 - threshold), F.lit(1.0))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def search_tokens(c: Column) -> Column:
    """Parts of two characters or more, and a year in parentheses if it is not among them."""
    parts = F.filter(F.split(c, r"(?U)[^\w\d]+"), lambda w: F.length(w) >= 2)
    year = F.regexp_extract(c, r"\((\d{4})\)", 1)
    return F.when((year != "") & ~F.array_contains(parts, year), F.array_append(parts, year)).otherwise(parts)


def denies(c: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(p)) for p in DENIALS))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def absolute_url(url: Column, host: str) -> Column:
    return F.when((url != "") & ~url.startswith("http"), F.concat(F.lit(host), url)).otherwise(url)


def allowed_file(path: Column) -> Column:
    return F.contains(path, F.lit(".")) & F.lower(F.element_at(F.split(path, "[.]"), -1)).isin("txt", "pdf", "docx", "doc")
