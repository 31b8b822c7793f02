"""Transparent quality scores and vector ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import AS_OF_YEAR, contains_any, first_case, lowered, present

# Fixed values of the score.
WEIGHTS = {
    "study_type": 20, "sample_size": 15, "statistical_rigor": 15, "venue_quality": 15, "recency": 10, "citations": 10, "completeness": 10,
    "reproducibility": 5
}
STUDY_POINTS = (
    ("systematic review", 10), ("meta-analysis", 10), ("randomized controlled trial", 9), ("rct", 9), ("cohort study", 7), ("cohort", 7),
    ("case-control", 6), ("cross-sectional", 5), ("case series", 3), ("case report", 2), ("opinion", 1), ("editorial", 1)
)
TOP_VENUES = (
    "nature", "science", "cell", "lancet", "nejm", "new england journal of medicine", "jama", "bmj", "pnas", "nature medicine",
    "nature biotechnology", "nature genetics", "nature neuroscience", "nature methods"
)
PUBLISHERS = ("ieee", "acm", "springer", "elsevier", "wiley")
TESTS = ("anova", "t-test", "chi-square", "regression", "mann-whitney", "wilcoxon", "kruskal-wallis")
GRADES = ((85, "A+"), (80, "A"), (75, "A-"), (70, "B+"), (65, "B"), (60, "B-"), (55, "C+"), (50, "C"), (45, "C-"), (40, "D"))
STRENGTHS = {
    "study_type": ("High-quality study design", "Weak study design"), "sample_size": ("Large sample size", "Small sample size"),
    "statistical_rigor": ("Strong statistical analysis", "Limited statistical analysis"),
    "venue_quality": ("Published in top-tier venue", "Unknown or low-tier venue"), "recency": ("Recent publication", "Older publication"),
    "citations": ("Highly cited", "Few citations"), "completeness": ("Complete extraction", "Incomplete extraction"),
    "reproducibility": ("Good reproducibility", "Limited reproducibility")
}


def _bands(c: Column, bands: tuple[tuple[float, float], ...], other: float, up: bool = True) -> Column:
    return first_case([((c >= b) if up else (c <= b), F.lit(float(v))) for b, v in bands], F.lit(float(other)))


def components(p: DataFrame, as_of: int = AS_OF_YEAR) -> DataFrame:
    """Adds the eight components. p: title, abstract, venue, year, citations, methods, results, introduction, discussion,
    num_references, doi, and entity arrays study_types, sample_sizes, p_values, intervals, effects, software, code, and n_entities."""
    c = F.col
    # Texts that many words are looked for in are lowered once, in a projection of their own.
    told = F.concat(F.coalesce("methods", F.lit("")), F.coalesce("results", F.lit("")))
    linked = F.concat(F.coalesce("abstract", F.lit("")), F.coalesce("methods", F.lit("")))
    p = p.withColumns({"_told": lowered(told), "_linked": lowered(linked), "_head": lowered(F.concat_ws(" ", "abstract", "title"))})
    has = lambda x: present(c(x))
    some = lambda x: F.size(c(x)) > 0
    text = c("_head")
    listed = F.array_max(F.transform("study_types", lambda s: F.greatest(*(F.when(F.lower(s).contains(k), v).otherwise(0) for k, v in STUDY_POINTS))))
    study = F.when(some("study_types"), listed).otherwise(first_case([(text.contains(k), v) for k, v in STUDY_POINTS], 0)) / 10 * 20
    sample = (
        F.when(some("sample_sizes"), _bands(F.array_max("sample_sizes"), ((10000, 1.0), (1000, 0.8), (500, 0.6), (100, 0.4), (50, 0.2)), 0.1) * 15).otherwise(0.0)
    )
    stats = (
        F.when(some("p_values"), 5).otherwise(0) + F.when(some("intervals"), 5).otherwise(0) + F.when(some("effects"), 3).otherwise(0)
        + F.when(contains_any(c("_told"), TESTS), 2).otherwise(0)
    ) / 15 * 15
    venue = F.lower("venue")
    venues = first_case([(~has("venue"), 0.0), (contains_any(venue, TOP_VENUES), 15.0), (contains_any(venue, PUBLISHERS), 9.0), (venue != "unknown", 4.5)], 0.0)
    year = c("year").try_cast("int")
    age = F.lit(as_of) - year
    recency = F.when(year.isNull(), 0.0).otherwise(_bands(age, ((2, 1.0), (5, 0.8), (10, 0.5), (15, 0.3)), 0.1, False) * 10)
    rate = F.coalesce(F.try_divide(c("citations").cast("double"), age + 1), c("citations").cast("double"))
    cited = _bands(rate, ((50, 1.0), (20, 0.8), (10, 0.6), (5, 0.4), (1, 0.2)), 0.1) * 10
    whole = (
        sum((F.when(has(x), 1).otherwise(0) for x in ("title", "abstract", "introduction", "methods", "results", "discussion", "doi")), F.lit(0))
        + F.when(c("num_references") > 0, 1).otherwise(0) + first_case([(c("n_entities") > 20, 2), (c("n_entities") > 10, 1)], 0)
    )
    links = contains_any(c("_linked"), ("github", "repository", "code available"))
    again = F.least(
        F.lit(5.0),
        F.when(some("code"), 2.5).otherwise(0.0) + F.when(c("data_available"), 2.5).otherwise(0.0) + F.when(some("software"), 1.0).otherwise(0.0)
        + F.when(links, 1.0).otherwise(0.0)
    )
    values = (study, sample, stats, venues, recency, cited, whole / 10 * 10, again)
    return p.withColumns({k: F.round(v.cast("double"), 6) for k, v in zip(WEIGHTS, values, strict=True)}).drop("_told", "_linked", "_head")


def total(scored: DataFrame) -> DataFrame:
    score = F.round(sum((F.col(k) for k in WEIGHTS), F.lit(0.0)), 6)
    return scored.withColumn("score", score).withColumn("grade", first_case([(score >= b, g) for b, g in GRADES], "F"))


def strengths(high: bool) -> Column:
    """Names of components of at least 0.8 of their weight, or of under 0.3."""
    test = (lambda k, w: F.col(k) >= 0.8 * w) if high else (lambda k, w: F.col(k) < 0.3 * w)
    return F.array_compact(F.array(*(F.when(test(k, w), STRENGTHS[k][0 if high else 1]) for k, w in WEIGHTS.items())))


def top_similar(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """The k vectors of highest cosine to the query, which is the first row by vec_id: (vec_id, similarity).

    The query stays a row of a plan (at most one, so it may be broadcast) and is joined in; a batch is one matrix product
    and hands on its own k best, so the final sort sees k rows a batch. Null vectors and ones of another length are left
    out, zero vectors have no similarity, and without a query there are no rows.
    """
    asked = query.orderBy("vec_id").limit(1).select(F.col("embedding").alias("_q"))
    both = vectors.where("embedding IS NOT NULL").join(F.broadcast(asked), F.size("embedding") == F.size("_q")).select("vec_id", "embedding", "_q")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            if not b.num_rows:
                continue
            q = np.array(b.column(2)[0].as_py(), float)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            with np.errstate(invalid="ignore", divide="ignore"):
                cosine = v @ q / (np.sqrt((v * v).sum(1)) * np.sqrt(q @ q))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            first = np.lexsort((ids, -np.round(cosine, 6)))[:k]
            yield pa.record_batch([b.column(0).take(pa.array(first)), pa.array(cosine[first])], ["vec_id", "similarity"])

    found = both.mapInArrow(best, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, similarity double").where(~F.isnan("similarity"))
    return found.select("vec_id", F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def search_rank() -> Column:
    """Of columns similarity, entity, quality and recency: 0.4 similarity, 0.3 entities, 0.2 quality, 0.1 recency."""
    return F.round(0.4 * F.col("similarity") + 0.3 * F.col("entity") + 0.2 * F.col("quality") + 0.1 * F.col("recency"), 6)


# Fixed values of the legacy score: 100 points over eight parts.
LEGACY_STUDY = {"systematic_review": 35, "meta_analysis": 35, "rct": 25, "cohort": 15, "case_control": 10, "cross_sectional": 5, "case_report": 0, "study": 5}
LEGACY_SHARES = {
    "study_type": 20, "recency": 10, "sample_size": 5, "full_text": 5, "citation_impact": 25, "venue_prestige": 15, "author_authority": 10,
    "cross_validation": 10
}
LEGACY_SAMPLE = ((1000, 5), (500, 4), (250, 3), (100, 2), (50, 1))
LEGACY_CITATIONS = ((1000, 25), (500, 20), (100, 15), (50, 10), (20, 7), (5, 4), (1, 2))
LEGACY_AUTHORS = ((50, 10), (30, 8), (15, 6), (5, 4), (1, 2))
LEGACY_VENUES = (("Q1", 15), ("Q2", 12), ("Q3", 8), ("Q4", 4))
LEGACY_YEARS = ((2022, 10), (2020, 5))


def legacy_parts(p: DataFrame) -> DataFrame:
    """Adds the legacy score's parts and its total. p: study_type, year, sample_size, has_full_text, citations, venue_rank,
    h_index, and booleans has_doi, has_pmid, has_types, has_fields (the sources that agree)."""
    c = F.col
    study = first_case([(c("study_type") == k, F.lit(float(v))) for k, v in LEGACY_STUDY.items()], F.lit(0.0)) / 35 * LEGACY_SHARES["study_type"]
    sample = F.when(c("study_type") == "rct", _bands(c("sample_size"), LEGACY_SAMPLE, 0)).otherwise(0.0)
    agree = sum((F.when(c(x), 2.5).otherwise(0.0) for x in ("has_doi", "has_pmid", "has_types", "has_fields")), F.lit(0.0))
    values = {
        "study_type_points": F.round(study, 6), "recency_points": _bands(c("year").try_cast("int"), LEGACY_YEARS, 0), "sample_size_points": sample,
        "full_text_points": F.when(c("has_full_text"), 5.0).otherwise(0.0), "citation_points": _bands(c("citations"), LEGACY_CITATIONS, 0),
        "venue_points": first_case([(c("venue_rank") == k, F.lit(float(v))) for k, v in LEGACY_VENUES], F.lit(2.0)),
        "author_points": _bands(c("h_index"), LEGACY_AUTHORS, 0), "agreement_points": agree,
    }
    out = p.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in values.items()})
    return out.withColumn("legacy_score", F.round(sum((c(k) for k in values), F.lit(0.0)), 6))


# Fixed values of the six-factor score.
IMPACT = ((100, 15, "high"), (50, 12, "moderate"), (10, 8, "some"))
LETTERS = ((85, "A+ (Excellent)"), (70, "A (Good)"), (60, "B (Above Average)"), (45, "C (Average)"))


def explained(
    citations: Column, sample: Column, study_type: Column, has_p: Column, has_data: Column, has_code: Column, is_open: Column, h_index: Column,
    completeness: Column, year: Column
) -> Column:
    """struct of score and explanation: impact, methodology, reproducibility, authors, completeness and recency, 100 at most."""
    impact = first_case([(citations > n, v) for n, v, _ in IMPACT], 0)
    word = first_case([(citations > n, w) for n, _, w in IMPACT], "limited")
    points = lambda test, n: F.when(test, n).otherwise(0)
    method = points(sample > 1000, 10) + points(F.lower(study_type).contains("rct"), 9) + points(has_p, 3)
    again = points(has_data, 8) + points(has_code, 7) + points(is_open, 5)
    score = impact + method + again + first_case([(h_index > 50, 10), (h_index > 20, 7)], 0) + F.floor(completeness * 10).cast("int") + points(year >= 2023, 5)
    score = F.least(score, F.lit(100))
    line = F.format_string(
        "\u2022 Impact: %d/15 (%s%%) - %d citations (%s impact)", impact, F.round(100.0 * impact / 15, 0).cast("int").cast("string"),
        citations.cast("int"), word
    )
    grade = first_case([(score >= b, g) for b, g in LETTERS], "D (Below Average)")
    told = F.concat_ws("\n", F.format_string("Quality Score: %d/100\n", score), F.lit("Breakdown:"), line, F.concat(F.lit("\nOverall Grade: "), grade))
    return F.struct(score.cast("int").alias("score"), told.alias("explanation"))


def four_factors(
    s2: Column, crossref: Column, basic: Column, venue_level: Column, good_venue: Column, h_index: Column, has_authors: Column,
    lengths: tuple[Column, Column, Column], ids: dict[str, Column], year: Column
) -> Column:
    """struct of total, citations, their source, and the points of venue, authors, completeness and metadata.

    Citations come from the first source that has any (not 0); a venue's level counts before its name.
    """
    some = lambda x: F.nullif(x, F.lit(0))
    cited = F.coalesce(some(s2), some(crossref), basic, F.lit(0))
    source = first_case([(F.coalesce(s2, F.lit(0)) != 0, "s2_data"), (F.coalesce(crossref, F.lit(0)) != 0, "crossref")], "basic")
    venue = first_case([(venue_level.isNotNull(), F.least(F.lit(20.0), venue_level * 5.0)), (good_venue, F.lit(15.0))], F.lit(5.0))
    author = first_case([(h_index.isNotNull(), F.least(F.lit(10.0), h_index / 5.0)), (has_authors, F.lit(3.0))], F.lit(0.0))
    whole = sum((F.when(n > least, 10.0).otherwise(0.0) for n, least in zip(lengths, (100, 500, 500), strict=True)), F.lit(0.0))
    rich = (
        sum((F.when(x, 5.0 if k == "doi" else 3.0).otherwise(0.0) for k, x in ids.items()), F.lit(0.0))
        + first_case([(year > 2020, 3.0), (year > 2015, 1.0)], 0.0)
    )
    total_ = F.least(F.lit(100.0), F.least(F.lit(20.0), cited / 10.0) + venue + author + whole + rich)
    return F.struct(
        F.round(total_, 6).alias("total"), cited.cast("long").alias("citations"), source.alias("source"), venue.alias("venue_points"),
        F.round(author, 6).alias("author_points"), whole.alias("completeness_points"), rich.alias("metadata_points")
    )


# Words for a population, and the shares of a light. Areas of research and their words.
POPULATIONS = {
    "pediatric": ("children", "pediatric", "adolescent", "youth", "minors"), "elderly": ("elderly", "geriatric", "older adults", "seniors", "aging"),
    "women": ("women", "female", "maternal", "pregnancy", "reproductive"),
    "developing_countries": ("developing countries", "low-income", "global health", "LMIC"),
}
LIGHTS = ((80, "green"), (50, "yellow"))
AREAS = (
    ("imaging", ("image", "imaging", "radiolog")), ("trials", ("trial", "randomi")), ("models", ("model", "learning", "network")),
    ("health", ("health", "patient", "clinical"))
)


def light(percent: Column) -> Column:
    """green, yellow or red for a coverage."""
    return first_case([(percent >= n, w) for n, w in LIGHTS], "red")


def expanded(query: str) -> list[str]:
    """A query, and for each population that it names the words that stand for it, each once."""
    low = query.lower()
    more = [w for name, words in POPULATIONS.items() if name in low or any(w.lower() in low for w in words) for w in words]
    return list(dict.fromkeys([query, *more]))


def area(text: Column) -> Column:
    return first_case([(contains_any(F.lower(text), words), name) for name, words in AREAS], "other")
