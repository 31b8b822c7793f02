"""Selections over papers: structure classes, filter cascades, entity and discovery filters, corrections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import contains_any, first_case, present

# Fixed values of the structure classes.
METHOD_NAMES = (
    "method", "methodology", "material", "procedure", "protocol", "study design", "study population", "participant", "patient", "data collection",
    "statistical analysis", "randomization", "inclusion criteria", "exclusion criteria", "sample size"
)
METHOD_WORDS = ("we recruited", "participants were", "data were collected", "randomized controlled", "inclusion criteria")
RESULT_NAMES = ("result", "finding", "outcome", "analysis result", "baseline characteristic", "efficacy", "effectiveness")
RESULT_PATTERN = r"p\s*[<=]\s*0\.[0-9]+|95%\s*ci|mean\s*±|n\s*=\s*[0-9]+"
NOT_PAPERS = ("table of contents", "editorial", "erratum", "correction", "retraction", "comment on", "response to", "letter to")
STUDY_TITLES = ("study", "trial", "analysis", "evaluation", "assessment", "investigation", "examination", "validation", "comparison")
OPINIONS = ("commentary", "perspective", "opinion")
THEORIES = ("framework", "model", "theory", "conceptual")
# Fixed values of discovery.
QUALITY_FLOORS = {"HIGH": 80, "MEDIUM": 60, "LOW": 40}
MOST_AUTHORS = 5


def structure_flags(sections: DataFrame) -> DataFrame:
    """(paper_id, has_methods, has_results, section_chars); booleans and sums combine before the shuffle."""
    name, head = F.lower("header"), F.lower(F.substring("content", 1, 2000))
    long = F.length("content") > 100
    told = sum((head.contains(w).cast("int") for w in METHOD_WORDS), F.lit(0)) >= 2
    return sections.groupBy("paper_id").agg(
        F.bool_or(contains_any(name, METHOD_NAMES) | (long & told)).alias("has_methods"),
        F.bool_or(contains_any(name, RESULT_NAMES) | (long & head.rlike(RESULT_PATTERN))).alias("has_results"),
        F.sum(F.length("content")).alias("section_chars"),
    )


def structure_class(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """papers with structure (IMRaD, non-IMRaD, rejected) and reason; the first rule that holds decides."""
    rows = papers.join(structure_flags(sections), "paper_id", "left")
    m, r = F.coalesce("has_methods", F.lit(False)), F.coalesce("has_results", F.lit(False))
    title, chars = F.lower("title"), F.coalesce(F.length("abstract"), F.lit(0)) + F.coalesce("section_chars", F.lit(0))
    study, review = contains_any(title, STUDY_TITLES), title.contains("review")
    rules = [
        (chars < 500, "rejected", "no_content"), (contains_any(title, NOT_PAPERS), "rejected", "likely_not_paper"), (m & r, "IMRaD", "has_methods_and_results"),
        (m & study, "IMRaD", "has_methods_with_study_design"), (r & study, "IMRaD", "has_results_with_study_design"),
        (review & m, "IMRaD", "systematic_review_with_methods"),
        (review, "non-IMRaD", "review_article"), (contains_any(title, OPINIONS), "non-IMRaD", "commentary"),
        (contains_any(title, THEORIES) & ~m & ~r, "non-IMRaD", "theoretical_paper"),
        ((chars > 5000) & (m | r), "IMRaD", "partial_imrad_structure"), (chars > 5000, "non-IMRaD", "substantial_non_imrad"),
    ]
    return rows.withColumns(
        {
            "structure": first_case([(t, s) for t, s, _ in rules], "rejected"),
            "reason": first_case([(t, w) for t, _, w in rules], "insufficient_content")
        }
    )


def cascade(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(stage, removed): rows by the first rule that removes them, 'kept' for the others. One pass and one aggregate."""
    return rows.groupBy(first_case([(test, name) for name, test in rules], "kept").alias("stage")).agg(F.count("*").alias("removed"))


def document_class(doi: Column, size: Column, title: Column, abstract: Column, chars: Column) -> Column:
    """By DOI, then size (books), then title, then what text there is."""
    return first_case([
        (doi.contains("DCSupplemental"), "supplement"), (doi.contains("figshare") | doi.contains("zenodo"), "dataset"), (size > 5_000_000, "book"),
        (contains_any(F.lower(title), ("editorial", "erratum", "correction")), "editorial"), (~present(abstract) & (chars < 1000), "fragment"),
    ], "article")


def retry_with_models(abstract: Column, n_sections: Column, seconds: Column) -> Column:
    """Poor extraction that was not slow."""
    return ((n_sections < 4) | ~present(abstract)) & (seconds < 30)


def needs_retry(abstract: Column, n_sections: Column) -> Column:
    return (n_sections < 4) | (F.coalesce(F.length(abstract), F.lit(0)) < 100)


def entity_search(
    rows: DataFrame, study_type: str | None = None, min_sample: int | None = None, max_p: float | None = None, software: list[str] | None = None,
    datasets: list[str] | None = None, year_from: int | None = None
) -> DataFrame:
    """Rows that meet every filter given. rows: study_types, sample_sizes, p_values, software, datasets (arrays), year."""
    tests = [
        study_type is not None and F.array_contains("study_types", study_type),
        min_sample is not None and F.exists("sample_sizes", lambda x: x >= min_sample),
        max_p is not None and F.exists("p_values", lambda x: x <= max_p),
        software and F.forall(F.array(*map(F.lit, software)), lambda x: F.array_contains("software", x)),
        datasets and F.forall(F.array(*map(F.lit, datasets)), lambda x: F.array_contains("datasets", x)),
        year_from is not None and F.col("year").try_cast("int") >= year_from,
    ]
    for test in tests:
        if isinstance(test, Column):
            rows = rows.where(test)
    return rows


def discover(
    rows: DataFrame, known: DataFrame | None = None, quality: str = "LOW", year_from: int = 2020, min_citations: int = 0,
    authors: list[str] | None = None
) -> DataFrame:
    """Rows of a score floor, year and citations, by one of at most five authors, without those in `known` (paper_id)."""
    if authors and len(authors) > MOST_AUTHORS:
        raise ValueError(f"at most {MOST_AUTHORS} authors")
    rows = rows.where((F.col("year").try_cast("int") >= year_from) & (F.col("citations") >= min_citations))
    if authors:
        rows = rows.where(contains_any(F.lower("author"), tuple(a.lower() for a in authors)))
    rows = rows.where(F.col("score") >= QUALITY_FLOORS[quality])  # last, for a score may be costly
    return rows if known is None else rows.join(known.select("paper_id").distinct(), "paper_id", "left_anti")


def corrected(rows: DataFrame, corrections: DataFrame, key: str, field: str) -> DataFrame:
    """rows with `field` replaced where corrections (key, new) name one, and whether it was; the largest of several wins."""
    new = corrections.groupBy(key).agg(F.max("new").alias("_new"))
    out = rows.join(new, key, "left")
    return out.withColumn("was_corrected", F.col("_new").isNotNull()).withColumn(field, F.coalesce("_new", field)).drop("_new")


def most_cited(references: DataFrame, paper: str, journal: str) -> DataFrame:
    """(paper, journal, n): the journal that a paper cites most, the smallest name of equals; counts combine early."""
    n = references.where(F.col(journal).isNotNull()).groupBy(paper, journal).agg(F.count("*").alias("n"))
    return n.groupBy(paper).agg(F.min_by(journal, F.struct(-F.col("n"), F.col(journal))).alias(journal), F.max("n").alias("n"))


def rates(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: n, and per test the percentage of rows that pass it (0 without rows)."""
    share = lambda t: F.round(100.0 * F.count_if(t) / F.greatest(F.count("*"), F.lit(1)), 6)
    return rows.agg(F.count("*").alias("n"), *(share(t).alias(f"pct_{k}") for k, t in tests.items()))


def reach(rate: float) -> int:
    """How many of a key's last values weigh anything: what lies further back weighs less than a double's precision."""
    if not 0 < rate <= 1:
        raise ValueError("a rate is above 0 and at most 1")
    return 1 if rate == 1 else math.ceil(math.log(1e-17) / math.log1p(-rate)) + 1


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, rate: float = 0.3) -> DataFrame:
    """key, ema: each key's exponential moving average, from its first value on.

    Only the last reach(rate) values of a key weigh anything, so ranks are limited before the shuffle and a hot key is no hot task.
    """
    back = F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(o) for o in order))) - 1
    last = rows.where(F.col(value).isNotNull()).select(key, value, back.alias("back")).where(F.col("back") < reach(rate))
    weight = F.pow(F.lit(1 - rate), F.col("back"))
    return last.groupBy(key).agg((F.sum(rate * weight * F.col(value)) + (1 - rate) * F.max_by(F.col(value) * weight, "back")).alias("ema"))


def entity_coverage(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted (kind, entity) with the number of papers that hold it; 0 is a gap. found: (paper_id, kind, entity)."""
    held = found.join(wanted, ["kind", "entity"], "left_semi").groupBy("kind", "entity").agg(F.count_distinct("paper_id").alias("papers"))
    return wanted.distinct().join(held, ["kind", "entity"], "left").na.fill(0, ["papers"])


def reproducible(rows: DataFrame, requires: str = "both", least: float = 60) -> DataFrame:
    """rows (with has_code, has_data, score) whose code, data or both are there, at a score of at least `least`."""
    needs = {"code": F.col("has_code"), "data": F.col("has_data"), "both": F.col("has_code") & F.col("has_data")}
    return rows.where(needs[requires] & (F.col("score") >= least))


def large_studies(rows: DataFrame, least: int = 1000, study_type: str | None = None) -> DataFrame:
    """rows (with sample_sizes, study_type) with a sample of at least `least`, of one type or all."""
    out = rows.where(F.array_max("sample_sizes") >= least)
    return out.where(F.lower("study_type") == study_type.lower()) if study_type else out
