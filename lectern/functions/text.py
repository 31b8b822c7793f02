"""Scalar functions on identifiers, dates, titles and headers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latest year that counts as valid is this plus one; pinned so that results don't depend on the clock.
AS_OF_YEAR = 2025

# Words that stop a title comparison.
STOP_WORDS = ("the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "but", "with", "by", "from", "as", "is", "was")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def lowered(c: Column) -> Column:
    """c in lower case; İ gives i, as in the SQL: Java gives an i and a dot."""
    return F.lower(F.replace(c, F.lit("\u0130"), F.lit("i")))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the string holds one of the words; false for null."""
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(c.contains(w), F.lit(False))
    return out


def first_case(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds: an ordered CASE."""
    out = F.when(rules[0][0], rules[0][1])
    for test, value in rules[1:]:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def _doi_or_null(c: Column, least: int, most: int) -> Column:
    return F.when(c.startswith("10.") & F.length(c).between(least, most), c)


def doi_shared(c: Column) -> Column:
    """Case kept; funder DOIs and implausible ones are null; one trailing sign and glued suffixes go."""
    d = strip(c)
    out = F.regexp_replace(d, r"https?://(dx\.)?doi\.org/", "")
    for pattern in (r"[).]$", r"(?i)\(reprinted.*", "/-/DC.*", r"(REVIEWS?|Date[0-9]{4}|\.pdf|\.html|[Ss]upplemental).*$"):
        out = F.regexp_replace(out, pattern, "")
    return F.when(~d.contains("10.13039"), _doi_or_null(out, 7, 200))


def doi_lookup(c: Column, least: int = 7, most: int = 100) -> Column:
    """Lower case; a URL's DOI or null; cut at glued words; trailing signs go."""
    d = F.lower(strip(c))
    query = F.regexp_extract(d, "doi=([^&]+)", 1)
    url = F.when(d.contains("doi.org/"), F.substring_index(d, "doi.org/", -1)).when(query != "", query)
    bare = F.when(d.startswith("http"), url).otherwise(d)
    cut = F.substring_index(F.substring_index(bare, ".from", 1), "keywords", 1)
    return _doi_or_null(F.regexp_replace(cut, "[.)•]+$", ""), least, most)


def doi_core(c: Column) -> Column:
    return doi_lookup(c, 10, 100)


# Text that extraction glues to DOIs.
GLUED = ("REvIEWS", "REVIEWS", "Date2024", "Date2023", "Date2022", "Date2021", "Date2020", ".pdf", ".html", "Supplemental", "supplemental")


def doi_aggressive(c: Column) -> Column:
    """Glued text is deleted wherever it stands; nothing is validated."""
    out = F.substring_index(F.regexp_replace(c, r"\.+$", ""), "/-/DC", 1)
    for w in GLUED:
        out = F.replace(out, F.lit(w), F.lit(""))
    return F.regexp_replace(strip(F.replace(out, F.lit("//"), F.lit("/"))), "[.,;:]+$", "")


def doi_plain(c: Column) -> Column:
    return F.replace(F.replace(strip(c), F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit(""))


def doi_key(c: Column) -> Column:
    """The key of reference-manager items: lower case, without the resolver."""
    return F.regexp_replace(strip(F.lower(c)), "https?://doi.org/", "")


def doi_reject_reason(c: Column) -> Column:
    return first_case([(~present(c), "empty"), (c.contains("10.13039"), "funding"), (doi_shared(c).isNull(), "invalid")], "accepted")


def doi_prefix(c: Column) -> Column:
    return F.when(c.contains("/"), F.split_part(c, F.lit("/"), F.lit(1))).otherwise(F.substring(c, 1, 15))


def doi_problem(c: Column) -> Column:
    """The first problem of a DOI; null without one."""
    return first_case([
        (~present(c), None), (c.contains(".From") | c.contains(".from"), "from_suffix"), (F.lower(c).contains("http"), "url"),
        (c.contains("KEYWORDS"), "keywords"), (F.length(c) > 100, "too_long"), (~c.startswith("10."), "not_a_doi"),
    ])


def _year_in_range(c: Column, as_of: int) -> Column:
    y = c.try_cast("int")
    return F.when(y.between(1900, as_of + 1), y)


def year_from_date(c: Column, as_of: int = AS_OF_YEAR) -> Column:
    """Leading four digits if that is a valid year, else the first 19xx or 20xx that stands alone."""
    return (
        F.coalesce(
            _year_in_range(F.regexp_extract(c, "^([0-9]{4})", 1), as_of),
            _year_in_range(F.regexp_extract(c, r"\b(19[0-9]{2}|20[0-9]{2})\b", 1), as_of)
        )
    )


def year_first(c: Column) -> Column:
    out = F.regexp_extract(c, r"\b((19|20)[0-9]{2})\b", 1)
    return F.when(out != "", out)


def title_arxiv(c: Column) -> Column:
    out = F.substring(F.regexp_replace(F.regexp_replace(strip(c), "<[^>]+>", ""), r"\s+", " "), 1, 250)
    return F.when(F.length(out) > 5, out)


def title_core(c: Column) -> Column:
    out = F.substring(strip(F.regexp_replace(F.regexp_replace(c, r"""["'()\[\]{}]""", " "), r"\s+", " ")), 1, 200)
    return F.when(F.length(out) > 10, out)


def title_key(c: Column) -> Column:
    return F.substring(strip(F.lower(c)), 1, 50)


def arxiv_id(c: Column) -> Column:
    out = F.regexp_replace(F.replace(F.replace(strip(c), F.lit("arXiv:"), F.lit("")), F.lit("arxiv:"), F.lit("")), "v[0-9]+$", "")
    return F.when(out.rlike(r"^[0-9]{4}\.[0-9]{4,5}$") | out.rlike("^[a-z-]+/[0-9]{7}$"), out)


def last_name(c: Column) -> Column:
    return F.when(c.contains(","), strip(F.split_part(c, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(strip(c), r"(\S+)$", 1))


def header(c: Column) -> Column:
    """A section header without case, numbering and signs. Lower case comes first, so Roman numerals stay."""
    out = F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"^[0-9IVX]+\.?\s*", ""), r"^[0-9]+\.[0-9]+\.?\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(out, "[:\\-–—()]", " "), r"\s+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^<]+?>", "")


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def shard(c: Column, n: int = 2) -> Column:
    """Folder of an id: its first n characters in upper case, XX where it has fewer."""
    return F.when(F.length(c) >= n, F.upper(F.substring(c, 1, n))).otherwise("XX")


def duration(seconds: Column) -> Column:
    """30 seconds, 1.5 minutes, 2.0 hours."""
    s = seconds.cast("double")
    return first_case(
        [(s < 60, F.format_string("%d seconds", s.cast("long"))), (s < 3600, F.format_string("%.1f minutes", s / 60))],
        F.format_string("%.1f hours", s / 3600)
    )


def duration_short(seconds: Column) -> Column:
    """45s, 1m30s, 1h5m."""
    s = seconds.cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    return first_case([(s < 60, F.format_string("%ds", s)), (s < 3600, F.format_string("%dm%ds", m, s % 60))], F.format_string("%dh%dm", h, m % 60))


def tokens(c: Column) -> Column:
    """Distinct words of a lower-cased title."""
    return F.filter(F.array_distinct(F.split(F.lower(c), r"\s+")), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def jaccard_stop(a: Column, b: Column) -> Column:
    """Jaccard similarity without stop words; where one side has none left, 1 for equal titles and 0 for others."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    x, y = F.array_except(tokens(a), stop), F.array_except(tokens(b), stop)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), (F.lower(a) == F.lower(b)).cast("double")).otherwise(jaccard(x, y))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def long_words(c: Column) -> Column:
    """Words of four characters and more, in any script, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w{4,}\b"), F.lit(0))


def year_issued(c: Column) -> Column:
    """The first four digits of a date."""
    return F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit(""))


def year_from_references(references: DataFrame, paper: str, year: str, as_of: int = AS_OF_YEAR) -> DataFrame:
    """(paper, year): the year behind a paper's latest valid reference, but not after as_of."""
    y = F.col(year).try_cast("int")
    rows = references.select(paper, y.alias("_y")).where(F.col("_y").between(1900, as_of + 1))
    return rows.groupBy(paper).agg(F.least(F.max("_y") + 1, F.lit(as_of)).alias("year"))
