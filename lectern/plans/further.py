"""Queries for further payloads, mentions, gaps and timings, and the SQL that says the same; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import entities as E
from lectern.operators import sections as S
from lectern.operators import selection as X
from lectern.plans.adapter import PAPERS_SQL, papers
from lectern.plans.catalogue import ALL, NUM, SCORED, _said, _scored, add, anyof, c, case, lit, on_papers, scalar, table
from lectern.plans.selections import ORACLES, QUERIES, _struct
from lectern.sources import payloads

__all__ = ["ORACLES", "QUERIES"]


# --- payloads -------------------------------------------------------------------------------------------------------
def _graph_papers(s: SparkSession, d: str) -> DataFrame:
    person = lambda name, h: _struct(name=name, hIndex=h.cast("int"))
    told = F.transform(F.sequence(F.lit(1), c("num_references") + 8), lambda i: _struct(title=F.concat(F.lit("w"), i.cast("string"))))
    work = _struct(
        paperId=c("paper_id"), externalIds=_struct(DOI=c("doi"), PubMed=F.when(c("doc_id") % 3 == 0, c("doc_id").cast("string"))), title=c("title"),
        year=c("year").try_cast("int"), venue=c("venue"),
        citationCount=F.when(c("doc_id") % 4 > 0, c("citations").cast("int")),
        authors=F.array(person(c("author"), c("doc_id") % 5), person(F.lit("Bo"), c("doc_id") % 2), person(F.lit(""), F.lit(99))), citations=told,
        references=F.when(c("doc_id") % 2 == 0, told),
    )
    return papers(s, d).select("paper_id", F.to_json(work).alias("payload"))


add(
    "payload_paper",
    lambda s, d: payloads.flat_paper(_graph_papers(s, d)).select(
        "paper_id", "doi", "pubmed_id", "year", "citation_count", F.array_join(c("authors")["name"], ";").alias("authors"), "max_author_h_index",
        F.array_join("citation_titles", ",").alias("citation_titles"), F.size(F.coalesce("reference_titles", F.array())).alias("n_references")
    ),
    f"""WITH {PAPERS_SQL} SELECT paper_id, nullif(doi, '') AS doi, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS STRING) END AS pubmed_id,
    CAST(try_cast(year AS INT) AS STRING) AS year, CAST(CASE WHEN doc_id % 4 > 0 THEN citations ELSE 0 END AS INT) AS citation_count, author || ';Bo'
    AS authors,
    CAST(nullif(greatest(doc_id % 5, doc_id % 2), 0) AS INT) AS max_author_h_index, 'w1,w2,w3,w4,w5,w6,w7,w8' || CASE WHEN num_references > 0 THEN
    ',w9' ELSE '' END || CASE WHEN num_references > 1 THEN ',w10' ELSE '' END AS citation_titles,
    CAST(CASE WHEN doc_id % 2 = 0 THEN least(num_references + 8, 10) ELSE 0 END AS INT) AS n_references FROM papers""",
)


def _repository_works(s: SparkSession, d: str) -> DataFrame:
    work = F.concat(
        F.lit('{"id": '), c("doc_id").cast("string"), F.lit(', "downloadUrl": "https://x.org/'), c("paper_id"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '' ELSE '.html' END"), F.lit('", "language": '),
        F.expr("""CASE doc_id % 2 WHEN 0 THEN '{"code": "en", "name": "English"}' ELSE '"fr"' END"""),
        F.lit(', "authors": [{"name": "Ann"}, {"name": null}, {"name": "Bo"}], "journal": {"title": "J", "identifiers": ["1234-5678", "x"]}'),
        F.expr("""CASE WHEN doc_id % 5 = 0 THEN ', "fullText": "t"' ELSE '' END"""), F.lit("}"),
    )
    return papers(s, d).select("paper_id", work.alias("payload"))


add(
    "payload_repository_work",
    lambda s, d: payloads.flat_repository_work(_repository_works(s, d)).select("paper_id", "core_id", "has_fulltext", "has_pdf", "language", F.array_join("authors", ";").alias("authors"), "issn"),
    f"WITH {PAPERS_SQL} SELECT paper_id, CAST(doc_id AS STRING) AS core_id, doc_id % 5 = 0 AS has_fulltext, doc_id % 3 = 0 AS has_pdf, CASE doc_id "
    f"% 2 WHEN 0 THEN 'English' ELSE 'fr' END AS language, 'Ann;Bo' AS authors, '1234-5678' AS issn FROM papers",
)


def _entries(s: SparkSession, d: str) -> DataFrame:
    entry = F.expr("""'<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><id>http://arxiv.org/abs/2101.' ||
    paper_id || CASE doc_id % 3 WHEN 0 THEN '' ELSE 'v' || CAST(doc_id % 3 AS STRING) END || '</id><title> On x </title><summary>s</summary>'
        || '<author><name>Ann Li</name><arxiv:affiliation>A</arxiv:affiliation></author><author><name>Bo</name></author><published>2020-01-02T00:00:00Z</published><updated>202'
    || CAST(doc_id % 2 AS STRING) || '-01-02T00:00:00Z</updated>'
        || '<arxiv:primary_category term="cs.LG"/><category term="cs.AI"/><category term="cs.LG"/>' || CASE WHEN doc_id % 4 = 0 THEN
    '<category term="stat.ML"/><arxiv:doi>10.1/x</arxiv:doi>' ELSE '' END || '</entry>'""")
    return papers(s, d).select("paper_id", entry.alias("payload"))


add(
    "payload_entry",
    lambda s, d: payloads.flat_entry(_entries(s, d)).select(
        "paper_id", "title", "arxiv_id", "version", "pdf_url", F.array_join(c("authors")["name"], ";").alias("authors"), "first_submitted",
        "last_updated", F.array_join("categories", ",").alias("categories"), "published_doi"
    ),
    f"""WITH {PAPERS_SQL} SELECT paper_id, 'On x' AS title, '2101.' || paper_id AS arxiv_id, CAST(nullif(doc_id % 3, 0) AS INT) AS version,
    'https://arxiv.org/pdf/2101.' || paper_id || '.pdf' AS pdf_url, 'Ann Li;Bo' AS authors, '2020-01-02' AS first_submitted,
    CASE WHEN doc_id % 2 = 1 THEN '2021-01-02' END AS last_updated, 'cs.LG,cs.AI' || CASE WHEN doc_id % 4 = 0 THEN ',stat.ML' ELSE '' END AS
    categories, CASE WHEN doc_id % 4 = 0 THEN '10.1/x' END AS published_doi FROM papers""",
)
_named = "CASE doc_id % 4 WHEN 0 THEN array(named_struct('name', author), named_struct('name', '')) END"
scalar(
    "author_names",
    lambda: F.array_join(
        payloads.author_names(F.expr(_named), F.expr("CASE WHEN doc_id % 4 = 1 THEN array(author, 'Bo') WHEN doc_id % 4 = 2 THEN array() END"), F.array(F.lit("Last"))),
        ";"
    ),
    "CASE doc_id % 4 WHEN 0 THEN author WHEN 1 THEN author || ';Bo' ELSE 'Last' END",
)
scalar(
    "header_parts",
    lambda: F.array_join(
        S.header_parts(F.expr("CASE doc_id % 4 WHEN 0 THEN 'Results and Discussion' WHEN 1 THEN 'Method' WHEN 2 THEN 'Finding and Conclusion' ELSE venue END")),
        ";"
    ),
    "CASE doc_id % 4 WHEN 0 THEN 'results;discussion' WHEN 1 THEN 'methods' WHEN 2 THEN 'results;conclusions' ELSE replace(lower(venue), ' and ', ';') END",
)

# --- mentions -------------------------------------------------------------------------------------------------------
_MORE = (
    "' Run using SciPy v1.2 and the Foo package, data from GSE' || CAST(doc_id AS STRING) || ', grant: AB-' || CAST(doc_id % 90 AS STRING) || ', "
    "funded by the ERC. See https://x.org/a?b=' || CAST(doc_id % 9 AS STRING) || ' .'"
)


def _matches(patterns: tuple[str, ...], any_case: bool, once: bool) -> str:
    every = "flatten([" + ", ".join(f"regexp_extract_all(told, '{'(?i)' * any_case}{p}', 1)" for p in patterns) + "])"
    return f"coalesce(array_to_string({f'list_sort(list_distinct({every}))' if once else every}, ';'), '')"


on_papers(
    "entities_mentions",
    lambda p: p.select("paper_id", F.expr(f"body || {_MORE}").alias("told")).select("paper_id", *E.mentions(c("told")))
        .select("paper_id", *(F.array_join(n, ";").alias(n) for n, *_ in E.MENTIONS)),
    f", told AS (SELECT paper_id, body || {_MORE} AS told FROM papers) SELECT paper_id, "
    + ", ".join(f"{_matches(p, any_case, once)} AS {n}" for n, p, any_case, once in E.MENTIONS) + " FROM told",
)

# --- gaps and timings -----------------------------------------------------------------------------------------------
_WANTED = (("software", "Python 3.9"), ("software", "Julia"), ("dataset", "MIMIC-III"), ("dataset", "TCGA"))


def _coverage(p: DataFrame) -> DataFrame:
    tagged = lambda kind, names: F.transform(names, lambda e: _struct(kind=F.lit(kind), entity=e))
    kinds = F.concat(tagged("software", E.software(c("body"))), tagged("dataset", E.named(c("body"), E.DATASETS)))
    return X.entity_coverage(p.select("paper_id", F.inline(kinds)), p.sparkSession.createDataFrame(_WANTED, "kind string, entity string"))


on_papers(
    "gap_entity",
    _coverage,
    ", wanted(kind, entity, pattern) AS (VALUES "
    + ", ".join(f"({lit(k)}, {lit(e)}, {lit('(?i)' + e.replace('.', '[.]') + ('($|[^0-9.])' if k == 'software' else ''))})" for k, e in _WANTED)
    + ") SELECT kind, entity, count(DISTINCT CASE WHEN regexp_matches(CASE WHEN kind = 'software' THEN regexp_extract(body, '(?i)Python\\s*[0-9.]*') "
    "ELSE body END, pattern) THEN paper_id END) AS papers FROM wanted, papers GROUP BY 1, 2",
)
on_papers(
    "gap_reproducibility",
    lambda p: X.reproducible(_scored(p).withColumns({"has_code": F.size("code") > 0, "has_data": c("data_available")}), "both", 35).select("paper_id", "score"),
    f", {SCORED} SELECT paper_id, CAST(score AS DOUBLE) AS score FROM total WHERE len({ALL(E.CODE_URL, 0)}) > 0 AND {_said} AND "
    f"contains(lower(body), 'available') AND NOT contains(lower(body), 'request') AND score >= 35",
)
on_papers(
    "gap_sample_size",
    lambda p: X.large_studies(p.select("paper_id", E.sample_sizes(c("body")).alias("sample_sizes"), E.study_type(c("body")).alias("study_type")), 500, "COHORT").select("paper_id"),
    f"SELECT paper_id FROM papers WHERE list_max({NUM}) >= 500 AND {case([(anyof('lower(body)', words), lit(k)) for k, words in E.STUDY_TYPES])} = 'cohort'",
)
add(
    "timing_ema",
    lambda s, d: X.moving_average(table(s, d, "events"), "event_type", ["ts", "event_id"], "value").select("event_type", F.round("ema", 6).alias("ema")),
    f"""SELECT event_type, round(sum(0.3 * pow(0.7, back) * value) + 0.7 * max_by(pow(0.7, back) * value, back), 6) AS ema
    FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS back FROM events WHERE value IS
    NOT NULL) WHERE back < {X.reach(0.3)} GROUP BY 1""",
)
_stage = case([("doc_id % 3 = 0", lit("a")), ("doc_id % 3 = 1", lit("b"))], lit("c"))
on_papers(
    "set_operations",
    lambda p: (lambda a, b: a.union(b).distinct().withColumn("op", F.lit("union")).unionByName(a.intersect(b).withColumn("op", F.lit("intersect"))).unionByName(a.subtract(b).withColumn("op", F.lit("except"))).groupBy("op", "stage").agg(F.count("*").alias("n")))(
        p.where("doc_id % 2 = 0").selectExpr("venue", f"{_stage} AS stage", "num_references"),
        p.where("doc_id % 5 < 3").selectExpr("venue", f"{_stage} AS stage", "num_references")
    ),
    f", a AS (SELECT venue, {_stage} AS stage, num_references FROM papers WHERE doc_id % 2 = 0), b AS (SELECT venue, {_stage} AS stage, "
    f"num_references FROM papers WHERE doc_id % 5 < 3) SELECT op, stage, count(*) AS n FROM (SELECT *, 'union' AS op FROM (FROM a UNION FROM b) "
    f"UNION ALL SELECT *, 'intersect' FROM (FROM a INTERSECT FROM b) UNION ALL SELECT *, 'except' FROM (FROM a EXCEPT FROM b)) GROUP BY 1, 2",
)
