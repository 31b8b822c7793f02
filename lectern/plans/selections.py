"""Queries for selections and payloads, and the SQL that says the same; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import entities as E
from lectern.functions import text as T
from lectern.operators import selection as X
from lectern.plans.adapter import PAPERS_SQL, SECTIONS_SQL, papers, sections
from lectern.plans.catalogue import ALL, NUM, ORACLES, QUERIES, SCORED, SHARED, _scored, add, anyof, c, case, lit, on_papers, scalar, table
from lectern.sources import payloads

__all__ = ["ORACLES", "QUERIES"]

# --- structure and cascades -----------------------------------------------------------------------------------------
_head, _title = "lower(substr(content, 1, 2000))", "lower(title)"
_told = " + ".join(f"CAST(contains({_head}, '{w}') AS INT)" for w in X.METHOD_WORDS)
FLAGS_SQL = f"""flags AS (SELECT paper_id, bool_or({anyof('lower(header)', X.METHOD_NAMES)} OR (length(content) > 100 AND {_told} >= 2)) AS m,
bool_or({anyof('lower(header)', X.RESULT_NAMES)} OR (length(content) > 100 AND regexp_matches({_head}, '{X.RESULT_PATTERN}'))) AS r,
    sum(length(content)) AS section_chars FROM sections GROUP BY paper_id),
marked AS (SELECT p.paper_id, title, coalesce(m, false) AS m, coalesce(r, false) AS r, coalesce(length(abstract), 0) + coalesce(section_chars, 0) AS n
    FROM papers p LEFT JOIN flags USING (paper_id))"""
_study = anyof(_title, X.STUDY_TITLES)
_classes = [
    ("n < 500", "rejected", "no_content"), (anyof(_title, X.NOT_PAPERS), "rejected", "likely_not_paper"),
    ("m AND r", "IMRaD", "has_methods_and_results"), (f"m AND {_study}", "IMRaD", "has_methods_with_study_design"),
    (f"r AND {_study}", "IMRaD", "has_results_with_study_design"), (f"m AND contains({_title}, 'review')", "IMRaD", "systematic_review_with_methods"),
    (f"contains({_title}, 'review')", "non-IMRaD", "review_article"),
    (anyof(_title, X.OPINIONS), "non-IMRaD", "commentary"), (f"{anyof(_title, X.THEORIES)} AND NOT m AND NOT r", "non-IMRaD", "theoretical_paper"),
    ("n > 5000 AND (m OR r)", "IMRaD", "partial_imrad_structure"), ("n > 5000", "non-IMRaD", "substantial_non_imrad"),
]
add(
    "imrad_class",
    lambda s, d: X.structure_class(papers(s, d), sections(s, d)).select("paper_id", "structure", "reason"),
    f"WITH {PAPERS_SQL}, {SECTIONS_SQL}, {FLAGS_SQL} SELECT paper_id, {case([(t, lit(a)) for t, a, _ in _classes], lit('rejected'))} AS structure, "
    f"{case([(t, lit(w)) for t, _, w in _classes], lit('insufficient_content'))} AS reason FROM marked",
)
_rules = {
    "no_title": "title = ''", "no_doi": "trim(doi) = ''", "supplement": "contains(doi, 'DCSupplemental')", "dataset": "contains(doi, 'figshare')",
    "no_content": "chars < 500", "no_abstract": "coalesce(length(abstract), 0) < 50", "no_year": "coalesce(year, 'Unknown') = 'Unknown'"
}
on_papers(
    "filter_cascade", lambda p: X.cascade(p, [(k, F.expr(t)) for k, t in _rules.items()]),
    f"SELECT {case([(t, lit(k)) for k, t in _rules.items()], lit('kept'))} AS stage, count(*) AS removed FROM papers GROUP BY 1"
)
_size = "(doc_id * 7919 % 9000000)"
scalar("document_class", lambda: X.document_class(c("doi"), F.expr(_size), c("title"), c("abstract"), c("chars")), case([
    ("contains(doi, 'DCSupplemental')", "'supplement'"), ("contains(doi, 'figshare') OR contains(doi, 'zenodo')", "'dataset'"),
    (f"{_size} > 5000000", "'book'"), (anyof(_title, ("editorial", "erratum", "correction")), "'editorial'"),
    ("coalesce(abstract, '') = '' AND chars < 1000", "'fragment'"),
], "'article'"))
on_papers(
    "retry_flags",
    lambda p: p.select(
        "paper_id", X.retry_with_models(c("abstract"), c("n_sections"), c("doc_id") % 45).alias("with_models"),
        X.needs_retry(c("abstract"), c("n_sections")).alias("needs_retry")
    ),
    "SELECT paper_id, (n_sections < 4 OR coalesce(abstract, '') = '') AND doc_id % 45 < 30 AS with_models, n_sections < 4 OR "
    "coalesce(length(abstract), 0) < 100 AS needs_retry FROM papers",
)

# --- entity and discovery filters -----------------------------------------------------------------------------------
def _with_entities(p: DataFrame) -> DataFrame:
    """Papers with the entities that their texts hold."""
    kind = F.array_compact(F.array(E.study_type(c("body"))))
    return p.select(
        "paper_id", "year", kind.alias("study_types"), E.sample_sizes(c("body")).alias("sample_sizes"), E.p_values(c("body")).alias("p_values"),
        E.software(c("body")).alias("software"), E.named(c("body"), E.DATASETS).alias("datasets")
    )


_python = "regexp_extract_all(body, '(?i)Python\\s*([0-9.]+)?', 1)[1]"
_r = "regexp_extract_all(body, '(?i)\\bR\\s+(?:version\\s*)?([0-9.]+)', 1)[1]"
on_papers(
    "entity_search",
    lambda p: X.entity_search(_with_entities(p), None, 100, 0.05, ["R 4.1"], ["MIMIC-III"], 2000)
        .unionByName(X.entity_search(_with_entities(p), "cohort", 50, None, ["Python 3.9"])).select("paper_id"),
    f"""SELECT paper_id FROM papers WHERE list_max({NUM}) >= 100 AND list_min(list_transform({ALL(E.P_VALUE)}, x -> CAST(x AS DOUBLE))) <= 0.05 AND
    {_r} = '4.1' AND contains(lower(body), 'mimic-iii') AND try_cast(year AS INT) >= 2000
    UNION ALL SELECT paper_id FROM papers WHERE {case([(anyof('lower(body)', words), lit(k)) for k, words in E.STUDY_TYPES])} = 'cohort' AND
    list_max({NUM}) >= 50 AND {_python} = '3.9'""",
)
on_papers(
    "discovery_filter",
    lambda p: X.discover(
        # By doc_id, for a paper_id is cut at 8 digits.
        _scored(p.withColumn("cited", c("citations"))).withColumns({"citations": c("cited"), "cut": c("paper_id"), "paper_id": c("doc_id")}),
        p.where("doc_id % 10 = 1").select(c("doc_id").alias("paper_id")), "LOW", 2000, 20, ["miller", "Plato"]
    ).select(c("cut").alias("paper_id"), "score"),
    f", {SCORED} SELECT paper_id, CAST(score AS DOUBLE) AS score FROM total WHERE score >= 40 AND try_cast(year AS INT) >= 2000 AND citations >= 20 "
    f"AND (contains(lower(author), 'miller') OR contains(lower(author), 'plato')) AND doc_id % 10 <> 1",
)

# --- corrections and merges -----------------------------------------------------------------------------------------
on_papers(
    "doi_corrections",
    lambda p: X.corrected(
        p.select("paper_id", "doi"), p.where("doc_id % 5 = 0").select("paper_id", T.doi_shared(c("doi")).alias("new")).where("new IS NOT NULL"),
        "paper_id", "doi"
    ),
    f"SELECT paper_id, CASE WHEN doc_id % 5 = 0 THEN coalesce({SHARED}, doi) ELSE doi END AS doi, doc_id % 5 = 0 AND ({SHARED}) IS NOT NULL AS "
    f"was_corrected FROM papers",
)
on_papers(
    "untitled_cleanup",
    lambda p: p.groupBy(F.when(T.present(c("title")), "kept").otherwise("no_title").alias("outcome")).agg(F.count("*").alias("n"), F.min("paper_id").alias("first")),
    "SELECT CASE WHEN trim(title) <> '' THEN 'kept' ELSE 'no_title' END AS outcome, count(*) AS n, min(paper_id) AS first FROM papers GROUP BY 1"
)
_rates = {"doi": "doi <> ''", "abstract": "coalesce(abstract, '') <> ''", "arxiv": "arxiv <> ''", "cited": "citations > 0"}
on_papers(
    "enrichment_rates", lambda p: X.rates(p, {k: F.expr(t) for k, t in _rates.items()}),
    "SELECT count(*) AS n, " + ", ".join(f"round(100.0 * count_if({t}) / greatest(count(*), 1), 6) AS pct_{k}" for k, t in _rates.items())
    + " FROM papers"
)
add(
    "journal_inference",
    lambda s, d: X.most_cited(table(s, d, "lineitem").select("l_orderkey", (c("l_suppkey") % 20).alias("journal")), "l_orderkey", "journal"),
    "SELECT l_orderkey, journal, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, journal) AS r FROM (SELECT "
    "l_orderkey, l_suppkey % 20 AS journal, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r = 1",
)


# --- payloads -------------------------------------------------------------------------------------------------------
def _struct(**parts: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def _works(s: SparkSession, d: str) -> DataFrame:
    author = F.array(_struct(given=F.lit("Ann"), family=c("author")), _struct(given=F.lit("Bo"), family=F.lit("Li")))
    day = F.array(F.array((c("doc_id") % 30 + 1990).cast("int"), (c("doc_id") % 12 + 1).cast("int"), (c("doc_id") % 28 + 1).cast("int")))
    work = F.struct(
        c("doi").alias("DOI"), F.array("title", F.lit("other")).alias("title"), F.array("venue").alias("container-title"),
        F.concat(F.lit("<jats:p>About <b>"), c("venue"), F.lit("</b></jats:p>")).alias("abstract"),
        _struct(**{"date-parts": day}).alias("issued"), author.alias("author"), c("citations").cast("int").alias("is-referenced-by-count"),
        F.transform(F.sequence(F.lit(1), c("num_references") + 1), lambda i: _struct(DOI=F.concat(F.lit("10.1/"), i.cast("string")))).alias("reference"),
    )
    return papers(s, d).select("paper_id", F.to_json(work).alias("payload"))


add(
    "payload_work",
    lambda s, d: payloads.flat_work(_works(s, d)).select(
        "paper_id", "doi", "title", "journal", "abstract", "issued", F.array_join("authors", ";").alias("authors"), "citations",
        F.size("references").alias("n_references"), "has_orcid"
    ),
    f"""WITH {PAPERS_SQL} SELECT paper_id, doi, title, venue AS journal, CASE WHEN venue = '' THEN 'About' ELSE 'About ' || venue END AS abstract,
    CAST(doc_id % 30 + 1990 AS STRING) || '-' || lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')
    AS issued,
    'Ann ' || author || ';Bo Li' AS authors, CAST(citations AS INT) AS citations, CAST(num_references + 1 AS INT) AS n_references, false AS has_orcid
    FROM papers""",
)


def _graph_works(s: SparkSession, d: str) -> DataFrame:
    place = lambda x: _struct(display_name=x)
    work = _struct(
        doi=F.concat(F.lit("https://doi.org/"), F.lower("doi")), title=c("title"), publication_year=c("year").try_cast("int"),
        cited_by_count=c("citations").cast("int"),
        topics=F.transform(
            F.sequence(F.lit(1), F.lit(5)),
            lambda i: _struct(display_name=F.concat(F.lit("t"), (i + c("doc_id") % 4).cast("string")), score=F.lit(0.5))
        ),
        authorships=F.array(*(_struct(author=place(c("author")), institutions=F.array(place(c("venue")), place(F.lit(x)))) for x in ("Inst A", "Inst B"))),
        counts_by_year=F.array(
            _struct(year=F.lit(2020), cited_by_count=(c("doc_id") % 7).cast("int")),
            _struct(year=F.lit(2021), cited_by_count=(c("doc_id") % 11).cast("int"))
        ),
        open_access=_struct(is_oa=c("doc_id") % 2 == 0),
    )
    return papers(s, d).select("paper_id", F.to_json(work).alias("payload"))


add(
    "payload_graph_work",
    lambda s, d: payloads.flat_graph_work(_graph_works(s, d)).select(
        "paper_id", "title", F.array_join("topics", ",").alias("topics"), F.array_join("institutions", ",").alias("institutions"),
        F.element_at("citations_by_year", 2021).alias("cited_2021"), "is_oa"
    ),
    f"WITH {PAPERS_SQL} SELECT paper_id, title, 't' || CAST(doc_id % 4 + 1 AS STRING) || ',t' || CAST(doc_id % 4 + 2 AS STRING) || ',t' || "
    f"CAST(doc_id % 4 + 3 AS STRING) AS topics, venue || ',Inst A,Inst B' AS institutions, CAST(doc_id % 11 AS INT) AS cited_2021, doc_id % 2 = 0 "
    f"AS is_oa FROM papers",
)
_person = lambda kind, first, last, name: F.struct(F.lit(kind).alias("creatorType"), first.alias("firstName"), last.alias("lastName"), name.alias("name"))
on_papers(
    "creator_names",
    lambda p: p.select(
        "paper_id",
        F.array_join(
            payloads.creator_names(
                F.array(
                    _person("author", F.lit("Ann"), c("author"), F.lit(None).cast("string")),
                    _person("editor", F.lit("Ed"), F.lit("Itor"), F.lit(None).cast("string")),
                    _person("contributor", F.lit(None).cast("string"), F.lit(None).cast("string"), F.nullif("venue", F.lit("")))
                )
            ),
            ";"
        ).alias("names")
    ),
    "SELECT paper_id, 'Ann ' || author || CASE WHEN venue <> '' THEN ';' || venue ELSE '' END AS names FROM papers",
)
