"""Rules that keep, reject or label papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import AS_OF_YEAR, contains_any, first_case, present, strip

# Fixed values of the rules, in their order.
SUPPLEMENTAL = ("/-/dcsupplemental", "/suppl", ".supplemental", "supplementary", "supp_")
DATASET_DOI = ("figshare", "zenodo", "dryad", "dataverse", "osf.io", "mendeley.com/datasets")
DATASET_TITLE = ("dataset", "data from:", "supplementary data", "additional file")
OTHER_TITLE = ("correction to:", "erratum", "corrigendum", "retraction", "comment on", "response to", "author reply", "editorial", "book review")
PROBLEM_TITLE = (
    "editorial", "comment on", "response to", "erratum", "corrigendum", "retraction", "correction to", "book review", "conference report",
    "meeting report", "news", "announcement", "letter to editor", "author reply", "author response"
)
PROBLEM_DOI = ("dcsupplemental", "supplemental", "supplement", "figshare", "zenodo", "dryad", "dataverse", "osf.io")
MALFORMED = ("REVIEWS", "REvIEWS", "Date2024", "Date2023", "Date2022", ".pdf", ".html")
DOCUMENT_TYPES = (
    "editorial", "comment", "correspondence", "letter to", "erratum", "correction", "supplement", "book review", "news", "announcement",
    "abstract only", "poster"
)
REJECT_TITLE = (
    "table of contents", "editorial", "erratum", "correction", "retraction", "comment on", "response to", "letter to", "book review",
    "conference report", "announcement", "corrigendum", "withdrawal", "expression of concern", "author index", "subject index",
    "reviewer acknowledgment"
)


def has_doi(papers: DataFrame) -> DataFrame:
    return papers.where(present(strip(F.col("doi"))))


def malformed_doi(doi: Column) -> Column:
    return contains_any(doi, MALFORMED)


def article_category(title: Column, doi: Column) -> Column:
    """supplemental_materials, datasets (needs a DOI), other_non_articles or article."""
    t, d = F.lower(title), F.lower(doi)
    return first_case([
        (contains_any(d, SUPPLEMENTAL), "supplemental_materials"),
        (present(doi) & (contains_any(d, DATASET_DOI) | contains_any(t, DATASET_TITLE)), "datasets"),
        (contains_any(t, OTHER_TITLE), "other_non_articles"),
    ], "article")


def quality_flags(title: Column, abstract_length: Column, chars: Column, n_sections: Column, n_references: Column, year: Column) -> Column:
    return F.array_compact(F.array(
        F.when((chars < 2000) & (n_sections < 3), "very_short"), F.when((abstract_length < 50) & (chars < 3000), "no_abstract_minimal_text"),
        F.when(n_references == 0, "no_references"),
        F.when(~present(year), "no_year"), F.when(F.length(title).between(1, 9), "very_short_title"),
    ))


def problem_category(title: Column, doi: Column, abstract_length: Column, chars: Column, n_sections: Column, flags: Column) -> Column:
    failed = (n_sections == 0) | ((chars < 500) & (abstract_length < 100) & ~present(title))
    other = contains_any(F.lower(title), PROBLEM_TITLE) | contains_any(F.lower(doi), PROBLEM_DOI)
    return first_case([
        (failed, "grobid_failures"), (other, "non_articles"), ((chars < 1000) & (abstract_length < 200), "minimal_content"),
        (~present(title) & ~present(doi), "metadata_issues"), (F.size(flags) > 0, "quality_issues"),
    ], "ok")


def removal_action(category: Column, flags: Column) -> Column:
    severe = F.array_contains(flags, "very_short") & F.array_contains(flags, "no_references")
    return first_case(
        [
            (category.isin("grobid_failures", "non_articles"), "REMOVE"), (category.isin("minimal_content", "metadata_issues"), "REVIEW"),
            ((category == "quality_issues") & severe, "REVIEW")
        ],
        "KEEP"
    )


def document_type(title: Column, abstract: Column, doi: Column, chars: Column) -> Column:
    """The last rule to speak wins: lost text, then data and supplements by name, then a word of the title or abstract."""
    t, a, d = F.lower(title), F.lower(F.substring(F.coalesce(abstract, F.lit("")), 1, 200)), F.coalesce(doi, F.lit(""))
    words = [(t.rlike(rf"\b{w}\b") | a.rlike(rf"\b{w}\b"), w) for w in DOCUMENT_TYPES]
    return first_case([
        (chars == 0, "extraction_failure"), (chars < 1000, "partial_extraction"), (d.contains("figshare") | d.contains("zenodo"), "dataset"),
        (t.contains("supplement") | t.contains("additional file"), "supplementary material"), *words,
    ], "unknown")


def reject_reason(title: Column, abstract: Column, n_sections: Column, chars: Column) -> Column:
    t, head = F.lower(title), F.substring(abstract, 1, 500)
    special = F.length(F.regexp_replace(head, r"[\p{L}\p{N}\s]", "")) / F.length(head)
    return first_case([
        (chars < 500, "no_content"), *((t.contains(w), f"non_research: {w}") for w in REJECT_TITLE),
        ((F.length(abstract) >= 500) & (special > 0.3), "corrupted_ocr"),
        ((n_sections == 0) & (chars < 2000), "no_structure"), ((chars < 1000) & ~present(abstract), "insufficient_content"),
    ], "accept")


def severity(issues: Column) -> Column:
    return first_case([(F.size(issues) == 0, "include"), (F.size(issues) == 1, "review")], "exclude")


def completeness_issues(abstract: Column, n_sections: Column, chars: Column, doi: Column, year: Column, as_of: int = AS_OF_YEAR) -> Column:
    y = year.try_cast("int")
    return F.array_compact(F.array(
        F.when(present(abstract) & (F.length(abstract) < 50), "short_abstract"),
        F.when(n_sections == 0, "no_full_text").when(chars < 1000, "short_full_text"),
        F.when(present(doi) & ~doi.rlike(r"^10\.[0-9]{4,}/.+"), "malformed_doi"),
        F.when(present(year) & y.isNull(), "non_numeric_year").when(present(year) & ~y.between(1900, as_of + 1), "invalid_year"),
    ))
