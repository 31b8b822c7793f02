"""Queries for parser variants, whole payloads, control operators, further scores and streams, and the SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import entities as E
from lectern.functions import text as T
from lectern.operators import control as K
from lectern.operators import linkage as L
from lectern.operators import reports as R
from lectern.operators import scoring as Q
from lectern.operators import sections as S
from lectern.plans.adapter import ITEMS_SQL, PAPERS_SQL, SECTIONS_SQL, items, papers, sections
from lectern.plans.catalogue import ALL, OPTIMIZED, TYPE, WITH_MAP, _hd, _stages, _tok, _yr, add, anyof, c, case, flags, lit, on_papers, rx, scalar, st, table, whole
from lectern.plans.further import ORACLES, QUERIES
from lectern.plans.selections import _struct
from lectern.sources import payloads, records, tei_variants
from lectern.streaming import incremental

__all__ = ["ORACLES", "QUERIES"]

joined = lambda x, sep=";": F.array_join(x, sep)
own_text = lambda e: f"nullif({st(e)}, '')"

# --- TEI: the plain documents' SQL -----------------------------------------------------------------------------------
# What the documents are made of is known, so what a parser must find in them can be said without one.
ORACLES["tei_parse"] = (
    f"WITH {PAPERS_SQL} SELECT paper_id, coalesce({own_text('title')}, 'Cited') AS title, {own_text('doi')} AS doi, {_yr('year')} AS year, CAST(1 "
    f"AS INT) AS num_references, "
    "CAST(1 AS INT) AS n_authors, CAST(NULL AS VARCHAR) AS parse_error FROM papers"
)
ORACLES["tei_sections"] = f"WITH {PAPERS_SQL} SELECT paper_id, 'Methods' AS title, {own_text('body')} AS text FROM papers"
ORACLES["tei_references"] = f"WITH {PAPERS_SQL} SELECT paper_id, 'Cited' AS title, CAST(1999 AS INT) AS year FROM papers"

# --- TEI variants ----------------------------------------------------------------------------------------------------
_ESC = "replace(replace(coalesce({}, ''), '&', '&amp;'), '<', '&lt;')"
_DOCUMENT = f"""'<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>' || {_ESC.format('title')} ||
    '<hi> x</hi></title></titleStmt><publicationStmt><date when="' || coalesce(year, '') || '"/></publicationStmt>'
 || '<sourceDesc><biblStruct><analytic><author><persName><forename>Ann</forename><surname>' || {_ESC.format('author')} ||
    '</surname></persName><email>a' || CAST(doc_id % 50 AS STRING) || '@x.org</email><idno type="ORCID">0000-' || CAST(doc_id % 9 AS STRING) ||
    '</idno>'
 || '<affiliation><orgName>Uni ' || CAST(doc_id % 5 AS STRING) || '</orgName><address><country>' || CASE doc_id % 2 WHEN 0 THEN 'France' ELSE 'Spain'
    END || '</country></address></affiliation></author></analytic>'
 || '<monogr><title level="j">' || {_ESC.format('venue')} || '</title>' || CASE doc_id % 2 WHEN 0 THEN '<imprint><date when="' || CAST(1800 + doc_id % 230 AS STRING) || '-05"/></imprint>' ELSE '' END ||
    '</monogr><idno type="MD5">M' || CAST(doc_id AS STRING) ||
    '</idno><idno type="DOI">' || {_ESC.format('doi')} || '</idno></biblStruct></sourceDesc></fileDesc>'
 || '<profileDesc><textClass><keywords><term>k' || CAST(doc_id % 4 AS STRING) || '</term><term>z</term></keywords></textClass><abstract><p>' || CASE
    doc_id % 3 WHEN 0 THEN 'Too short.' ELSE {_ESC.format("coalesce(abstract, 'none')")} END || '</p></abstract></profileDesc></teiHeader>'
 || '<text><body><div><head>An abstract</head><p coords="1,' || CAST(doc_id % 7 AS STRING) ||
    '" xml:id="p1">one <ref type="bibr">[1]</ref> two <ref type="bibr">[2]</ref></p></div><div><head>Methods <hi>y</hi></head><p>' ||
    {_ESC.format('body')} || '</p><formula>E=' || CAST(doc_id % 3 AS STRING) || '</formula></div>'
 || '<figure type="figure" xml:id="f1"><label>1</label><figDesc>Figure of ' || CAST(doc_id % 6 AS STRING) ||
    '</figDesc></figure><figure type="table" xml:id="t1"><figDesc>Table</figDesc><table><row><cell>c' || CAST(doc_id % 8 AS STRING) ||
    '</cell></row></table></figure></body>'
 || '<back><div type="acknowledgement"><p>Made under grant AB-' || CAST(doc_id % 70 AS STRING) || ', thanks.</p></div><funder><orgName>Fund ' ||
    CAST(doc_id % 3 AS STRING) || '</orgName></funder>'
 || '<listBibl><biblStruct><analytic><title>Cited</title><author><persName><surname>Old</surname></persName></author></analytic><monogr><title>J Old</title><imprint><date when="1999">1999</date></imprint></monogr></biblStruct></listBibl></back></text></TEI>'"""


def _variants(s: SparkSession, d: str) -> DataFrame:
    return tei_variants.read_variants(papers(s, d, True).select("paper_id", F.expr(_DOCUMENT).alias("xml")))


def on_variants(name: str, run, sql: str) -> None:
    add(name, lambda s, d: run(_variants(s, d)), f"WITH {PAPERS_SQL} {sql}")


_country = "CASE doc_id % 2 WHEN 0 THEN 'France' ELSE 'Spain' END"
_id = lambda k: f"CAST(doc_id % {k} AS STRING)"
on_variants(
    "tei_direct",
    lambda v: v.select(
        "paper_id", "direct.title", "direct.num_references", F.size("direct.sections").alias("n_sections"), c("direct.ids")["doi"].alias("doi"),
        c("direct.ids")["md5"].alias("md5"),
        joined(c("direct.authors")["name"]).alias("authors"), joined(c("direct.sections")["title"]).alias("titles"),
        F.get(c("direct.sections")["text"], F.lit(1)).alias("second"),
    ),
    f"SELECT paper_id, {own_text('title')} AS title, CAST(2 AS INT) AS num_references, CAST(3 AS INT) AS n_sections, nullif(doi, '') AS doi, 'M' || "
    f"CAST(doc_id AS STRING) AS md5, 'Ann ' || author AS authors, 'An abstract;Methods' AS titles, {own_text('body')} AS second FROM papers",
)
on_variants(
    "tei_entities",
    lambda v: tei_variants.entity_groups(v).select(
        "paper_id", *(joined(k).alias(k) for k in ("persons", "organizations", "locations", "equations", "emails", "orcids", "funding")),
        *(F.size(k).alias(f"n_{k}") for k in ("citations", "figures", "tables")),
        F.get(c("figures")["caption"], F.lit(0)).alias("caption"), F.get(c("tables")["content"], F.lit(0)).alias("cells"),
        F.get(c("citations")["raw_text"], F.lit(0)).alias("raw_text"),
    ),
    f"""SELECT paper_id, CASE WHEN 'Ann ' || author < 'Old' THEN 'Ann ' || author || ';Old' ELSE 'Old;Ann ' || author END AS persons, 'Fund ' ||
    {_id(3)} || ';Uni ' || {_id(5)} AS organizations, {_country} AS locations, 'E=' || {_id(3)} AS equations,
    'a' || {_id(50)} || '@x.org' AS emails, '0000-' || {_id(9)} AS orcids, 'AB-' || {_id(70)} AS funding, CAST(1 AS INT) AS n_citations, CAST(1 AS
    INT) AS n_figures, CAST(1 AS INT) AS n_tables,
    'Figure of ' || {_id(6)} AS caption, 'c' || {_id(8)} AS cells, 'Cited Old J Old 1999' AS raw_text FROM papers""",
)
on_variants(
    "tei_coordinates", lambda v: v.select("paper_id", F.explode("coordinates").alias("id", "coords")),
    f"SELECT paper_id, 'p1' AS id, '1,' || {_id(7)} AS coords FROM papers"
)
on_variants(
    "tei_metadata",
    lambda v: v.select(
        "paper_id", "metadata.title", "metadata.doi", "metadata.publication_date", "metadata.journal",
        joined(c("metadata.keywords")).alias("keywords"), joined(c("metadata.authors")["affiliation"]).alias("affiliations"),
        joined(c("summary.authors")).alias("all_authors"), "summary.references_count"
    ),
    f"SELECT paper_id, {own_text('title')} AS title, {own_text('doi')} AS doi, coalesce(year, '') AS publication_date, nullif(venue, '') AS "
    f"journal, 'k' || {_id(4)} || ';z' AS keywords, 'Uni ' || {_id(5)} AS affiliations, 'Ann ' || author || ';Old' AS all_authors, CAST(2 AS INT) "
    f"AS references_count FROM papers",
)
on_variants(
    "tei_structure",
    lambda v: v.select(
        "paper_id", "structure.figures_count", joined(c("structure.figure_captions")).alias("captions"), "structure.tables_count",
        "structure.equations_count", "structure.references_count", joined(c("structure.sections")).alias("sections"),
        joined("funders").alias("funders")
    ),
    f"SELECT paper_id, CAST(2 AS INT) AS figures_count, 'Figure of ' || {_id(6)} || ';Table' AS captions, CAST(1 AS INT) AS tables_count, CAST(1 AS "
    f"INT) AS equations_count, CAST(1 AS INT) AS references_count, 'An abstract;Methods' AS sections, 'Fund ' || {_id(3)} AS funders FROM papers",
)
on_variants(
    "tei_abstract", lambda v: v.select("paper_id", F.length("guarded_abstract").alias("n"), F.substring("guarded_abstract", 1, 12).alias("head")),
    f"SELECT paper_id, CAST(length(a) AS INT) AS n, substr(a, 1, 12) AS head FROM (SELECT paper_id, CASE WHEN doc_id % 3 > 0 AND "
    f"length({st('abstract')}) > 100 THEN {st('abstract')} ELSE 'An abstract one  [1]  two  [2]' END AS a FROM papers)"
)
on_variants(
    "tei_year", lambda v: v.select("paper_id", "tei_year"),
    "SELECT paper_id, CAST(CASE doc_id % 2 WHEN 0 THEN 1800 + doc_id % 230 ELSE 1999 END AS INT) AS tei_year FROM papers"
)
on_papers(
    "year_repair_tei",
    lambda p: p.select("paper_id", "year").join(_repaired(p), "paper_id", "left").select(
        "paper_id", F.coalesce(c("year").try_cast("int"), c("tei_year")).alias("year"),
        F.when(c("year").try_cast("int").isNotNull(), "own").when(c("tei_year").isNotNull(), "tei").alias("year_source")
    ),
    f"SELECT paper_id, coalesce(try_cast(year AS INT), d) AS year, CASE WHEN try_cast(year AS INT) IS NOT NULL THEN 'own' WHEN d IS NOT NULL THEN "
    f"'tei' END AS year_source FROM (SELECT *, coalesce({_yr(r'''regexp_extract(date, '^([0-9]{4})', 1)''')}, "
    f"{_yr(r'''regexp_extract(date, '\b(19[0-9]{2}|20[0-9]{2})\b', 1)''')}) AS d FROM papers)",
)


def _repaired(p: DataFrame) -> DataFrame:
    """Years of small documents that carry the paper's date twice, as attribute and as text."""
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><note><date when="'), "date", F.lit('">'), "date", F.lit("</date></note></TEI>"))
    return tei_variants.read_variants(p.select("paper_id", xml.alias("xml"))).select("paper_id", "tei_year")


# --- scalars and entities --------------------------------------------------------------------------------------------
scalar("strip_tags", lambda: T.strip_tags(F.concat(F.lit("<b>"), "title", F.lit("</b><i/>"))), "title")
scalar("title_display", lambda: T.shortened(c("title"), 40), "CASE WHEN length(title) > 40 THEN substr(title, 1, 40) || '...' ELSE title END")
scalar("year_issued", lambda: T.year_issued(c("date")), "nullif(regexp_extract(date, '([0-9]{4})', 1), '')")
scalar(
    "sentence_count", lambda: F.size(T.sentences(c("body"))),
    rf"CAST(len(string_split({rx('body', r'([.!?])\s+', chr(92) + '1' + chr(1))}, chr(1))) AS INT)"
)
scalar(
    "long_words", lambda: F.size(T.long_words(c("body"))),
    r"CAST(len(list_filter(regexp_extract_all(lower(body), '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), x -> length(x) >= 4)) AS INT)"
)
scalar(
    "time_words", lambda: T.duration(c("doc_id") * 42),
    "CASE WHEN doc_id * 42 < 60 THEN CAST(doc_id * 42 AS STRING) || ' seconds' WHEN doc_id * 42 < 3600 THEN printf('%.1f', doc_id * 42 / 60.0) || "
    "' minutes' ELSE printf('%.1f', round(doc_id * 42 / 3600.0 + 0.0000001, 1)) || ' hours' END"
)
_post = lambda p, kind: f"list_sort(list_distinct(list_filter(list_transform({ALL(p, 1, '')}, x -> try_cast(x AS {kind})), x -> x IS NOT NULL)))"
on_papers(
    "entities_post",
    lambda p: p.select("paper_id", E.post_entities(c("body")).alias("e")).select(
        "paper_id", joined(c("e.sample_sizes").cast("array<string>")).alias("sample_sizes"), F.size("e.p_values").alias("n_p"),
        F.array_max("e.p_values").alias("p_most"), joined(c("e.software")).alias("software")
    ),
    f"SELECT paper_id, array_to_string({_post(E.POST_SIZES, 'BIGINT')}, ';') AS sample_sizes, CAST(len({_post(E.POST_P, 'DOUBLE')}) AS INT) AS n_p, "
    f"list_max({_post(E.POST_P, 'DOUBLE')}) AS p_most, "
    f"array_to_string(list_sort({flags([(n, f'contains(lower(body), {lit(n.lower())})') for n in E.POST_SOFTWARE])}), ';') AS software FROM papers",
)
on_papers(
    "entities_table", lambda p: p.select("paper_id", *E.table_matches(c("body"))),
    "SELECT paper_id, " + ", ".join(f"len({ALL(v, 0, '')}) AS n_{k}" for k, v in E.PATTERN_TABLE.items()) + " FROM papers"
)
on_papers(
    "entities_registration", lambda p: p.select("paper_id", (F.size(E.distinct_of(c("body"), E.TRIAL, False)) > 0).alias("is_registered")),
    f"SELECT paper_id, len({ALL(E.TRIAL, 0, '')}) > 0 AS is_registered FROM papers"
)

# --- sources ---------------------------------------------------------------------------------------------------------
_name = "paper_id || CASE doc_id % 6 WHEN 0 THEN '_report' WHEN 1 THEN '_checkpoint' WHEN 2 THEN '.summary' WHEN 3 THEN '_excluded' ELSE '' END || '.json'"
on_papers(
    "side_files",
    lambda p: p.select("paper_id", *(records.side_file(F.expr(_name), r).alias(r) for r in records.SIDE_RULES)),
    "SELECT paper_id, "
    + ", ".join(
        "(" + " OR ".join(f"contains(n, '{w}')" for w in words) + (" OR starts_with(n, '.')" if r == "reports" else "") + f") AS {r}" for r,
        words in records.SIDE_RULES.items()
    )
    + f" FROM (SELECT *, {_name} AS n FROM papers)",
)
_kind = "CASE doc_id % 5 WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'attachment' WHEN 2 THEN 'thesis' WHEN 3 THEN 'note' ELSE 'preprint' END"
on_papers(
    "kept_items",
    lambda p: records.kept_items(p.select("paper_id", F.expr(_kind).alias("item_type"))).groupBy("item_type").agg(F.count("*").alias("n")),
    f"SELECT {_kind} AS item_type, count(*) AS n FROM papers WHERE doc_id % 5 IN (0, 2, 4) GROUP BY 1"
)
on_papers(
    "graph_fields", lambda p: records.pruned(p.select("paper_id", c("paper_id").alias("id"), "doi", "title", c("venue").alias("biblio"), "chars")),
    "SELECT paper_id AS id, doi, title, venue AS biblio FROM papers"
)
add(
    "item_identifiers",
    lambda s, d: records.identifiers(items(s, d).withColumn("doi", F.when(c("item_id") % 3 == 0, "").otherwise(c("doi")))),
    f"WITH {PAPERS_SQL}, {ITEMS_SQL} SELECT * FROM (SELECT coalesce(nullif(CASE WHEN item_id % 3 = 0 THEN '' ELSE trim(doi) END, ''), "
    f"nullif(trim(title), '')) AS key, CASE WHEN item_id % 3 <> 0 AND trim(doi) <> '' THEN 'doi' ELSE 'title' END AS kind, item_id FROM items) "
    f"WHERE key IS NOT NULL",
)
add(
    "paper_info",
    lambda s, d: records.paper_info(papers(s, d), sections(s, d)),
    f"WITH {PAPERS_SQL}, {SECTIONS_SQL} SELECT paper_id, substr(title, 1, 100) AS title, CAST(length(title) AS INT) AS title_length, "
    f"CAST(coalesce(length(abstract), 0) AS INT) AS abstract_length, coalesce(n, 0) AS n_sections, CAST(coalesce(chars_, 0) AS BIGINT) AS "
    f"text_chars FROM papers LEFT JOIN (SELECT paper_id, count(*) AS n, sum(length(content)) AS chars_ FROM sections GROUP BY paper_id) USING "
    f"(paper_id)",
)
_type = (
    "CASE json_type(v) WHEN 'VARCHAR' THEN CASE WHEN try_cast(v ->> '$' AS DOUBLE) IS NOT NULL THEN 'number' WHEN v ->> '$' IN ('true', 'false') "
    "THEN 'boolean' ELSE 'string' END WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' "
    "ELSE 'number' END"
)
add(
    "json_kinds", lambda s, d: records.json_paths(table(s, d, "events"), "props"),
    f"SELECT key, {_type} AS kind, count(*) AS n FROM (SELECT key, json_extract(props, '$.' || key) AS v FROM (SELECT props, "
    f"unnest(json_keys(props)) AS key FROM events)) GROUP BY ALL"
)
on_papers(
    "retry_route", lambda p: p.select(K.route(c("chars") / 100.0).alias("r")).groupBy("r.endpoint", "r.seconds").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN chars / 100.0 > 50 THEN 'header' ELSE 'full' END AS endpoint, CAST(CASE WHEN chars / 100.0 > 50 THEN 300 ELSE 600 END AS "
    "INT) AS seconds, count(*) AS n FROM papers GROUP BY ALL"
)
add(
    "extraction_profiles",
    lambda s, d: K.profiles(s).groupBy("profile")
        .agg(F.count("*").alias("parameters"), F.max(F.when(c("parameter") == "timeout", c("value").cast("int"))).alias("timeout")),
    "SELECT * FROM (VALUES ('maximum', CAST(15 AS BIGINT), CAST(300 AS INT)), ('balanced', 8, 60), ('minimal', 3, 30)) t(profile, parameters, "
    "timeout)"
)


# --- payloads --------------------------------------------------------------------------------------------------------
def _whole_works(s: SparkSession, d: str) -> DataFrame:
    stamp = _struct(**{"date-time": F.lit("2020-01-02T03:04:05Z"), "date-parts": F.array(F.array(F.lit(2020), F.lit(1), F.lit(2)))})
    parts = _struct(**{"date-parts": F.array(F.array((c("doc_id") % 30 + 1990).cast("int"), (c("doc_id") % 12 + 1).cast("int")))})
    person = _struct(given=F.lit("Ann"), family=c("author"), ORCID=F.when(c("doc_id") % 3 == 0, F.lit("0000-1")), affiliation=F.array(_struct(name=c("venue"))))
    some = lambda k, x: F.when(c("doc_id") % k == 0, x)
    work = F.struct(
        c("doi").alias("DOI"), F.array("title", F.lit("other")).alias("title"), F.array("venue").alias("container-title"),
        F.lit("P").alias("publisher"), stamp.alias("created"), parts.alias("issued"), F.array(person).alias("author"),
        F.lit("<jats:p>A <i>b</i></jats:p>").alias("abstract"), F.array(F.lit("1-2"), F.lit("3-4")).alias("ISSN"),
        c("citations").cast("int").alias("is-referenced-by-count"),
        some(2, F.array(_struct(**{"clinical-trial-number": F.lit("NCT1"), "registry": F.lit("r")}))).alias("clinical-trial-number"),
        some(5, F.array(_struct(name=F.lit("NIH"), DOI=F.lit("10.1/f"), award=F.array(F.lit("A1"))))).alias("funder"),
        F.array(_struct(URL=F.lit("http://l"), start=_struct(**{"date-time": F.lit("2021")}))).alias("license"),
        some(4, _struct(**{"is-preprint-of": F.array(_struct(id=F.lit("x"))), "cites": F.array().cast("array<string>")})).alias("relation"),
        F.transform(F.sequence(F.lit(1), (c("doc_id") % 130 + 1).cast("int")), lambda i: _struct(key=i)).alias("reference"),
        some(7, _struct(domain=F.lit("d"))).alias("content-domain"),
    )
    return papers(s, d).select("paper_id", F.to_json(work).alias("payload"))


add(
    "payload_work_whole",
    lambda s, d: payloads.whole_work(_whole_works(s, d)).select(
        "paper_id", "doi", "title", "container_title", "publisher", "created_date", "issued_date",
        F.get(c("authors"), F.lit(0))["name"].alias("author"), F.get(c("authors"), F.lit(0))["orcid"].alias("orcid"), "abstract",
        joined("issn").alias("issn"), "citations",
        F.get(c("clinical_trials"), F.lit(0))["number"].alias("trial"), F.get(c("funders"), F.lit(0))["name"].alias("funder"),
        F.get(c("licenses"), F.lit(0))["url"].alias("license"), joined(F.map_keys("relations")).alias("relations"), "reference_count",
        F.size("references_sample").alias("sampled"), "has_content_domain", "has_assertion",
    ),
    f"""WITH {PAPERS_SQL} SELECT paper_id, nullif(doi, '') AS doi, nullif(title, '') AS title, nullif(venue, '') AS container_title, 'P' AS publisher,
    '2020-01-02T03:04:05Z' AS created_date, CAST(doc_id % 30 + 1990 AS STRING) || '-' || CAST(doc_id % 12 + 1 AS STRING) AS issued_date, 'Ann ' ||
    author AS author,
    CASE WHEN doc_id % 3 = 0 THEN '0000-1' END AS orcid, 'A b' AS abstract, '1-2;3-4' AS issn, CAST(citations AS INT) AS citations, CASE WHEN doc_id %
    2 = 0 THEN 'NCT1' END AS trial, CASE WHEN doc_id % 5 = 0 THEN 'NIH' END AS funder, 'http://l' AS license, CASE WHEN doc_id % 4 = 0 THEN
    'is-preprint-of' END AS relations,
    CAST(doc_id % 130 + 1 AS INT) AS reference_count, CAST(least(doc_id % 130 + 1, 100) AS INT) AS sampled, doc_id % 7 = 0 AS has_content_domain,
    false AS has_assertion FROM papers""",
)


def _whole_graph(s: SparkSession, d: str) -> DataFrame:
    named = lambda x: _struct(display_name=x)
    topic = lambda i: _struct(id=F.concat(F.lit("T"), i.cast("string")), display_name=F.concat(F.lit("t"), i.cast("string")), score=F.lit(0.5), domain=named(F.lit("D")))
    work = _struct(
        id=F.concat(F.lit("https://openalex.org/W"), c("doc_id").cast("string")), doi=F.concat(F.lit("https://doi.org/"), "doi"),
        publication_year=c("year").try_cast("int"), is_retracted=F.when(c("doc_id") % 2 == 0, c("doc_id") % 4 == 0),
        topics=F.transform(F.sequence(F.lit(1), (c("doc_id") % 6 + 1).cast("int")), topic),
        sustainable_development_goals=F.array(_struct(id=F.lit("3"), display_name=F.lit("Health"), score=F.lit(0.7))),
        cited_by_count=c("citations").cast("int"),
        authorships=F.array(_struct(author=_struct(display_name=c("author")), institutions=F.array(named(F.lit("B")), named(F.lit("A")), named(c("venue"))))),
        open_access=_struct(oa_status=F.lit("gold")),
        keywords=F.array(_struct(display_name=F.lit("kw"), score=F.lit(0.1)), _struct(display_name=F.lit(""), score=F.lit(0.2))),
        mesh=F.array(_struct(descriptor_name=F.lit("Humans"), is_major_topic=F.lit(True))),
        primary_location=F.when(c("doc_id") % 3 == 0, _struct(source=_struct(display_name=c("venue"), issn_l=F.lit("1-2")))),
        biblio=_struct(volume=c("doc_id").cast("string"), first_page=F.lit("1")),
    )
    return papers(s, d).select("paper_id", F.to_json(work).alias("payload"))


add(
    "payload_graph_whole",
    lambda s, d: payloads.whole_graph_work(_whole_graph(s, d)).select(
        "paper_id", "graph_id", "year", "is_retracted", "is_paratext", joined(c("topics")["name"], ",").alias("topics"),
        F.get(c("topics"), F.lit(0))["domain"].alias("domain"), F.get(c("sdgs"), F.lit(0))["name"].alias("goal"), "citation_count", "reference_count",
        joined("institutions", ",").alias("institutions"), "open_access.is_oa", "open_access.status", F.size("keywords").alias("n_keywords"),
        F.get(c("mesh_terms"), F.lit(0))["descriptor"].alias("mesh"), c("venue.name").alias("venue"), "volume", "first_page", "last_page",
    ),
    f"""WITH {PAPERS_SQL} SELECT paper_id, 'W' || CAST(doc_id AS STRING) AS graph_id, try_cast(year AS INT) AS year, doc_id % 4 = 0 AS is_retracted,
    false AS is_paratext, 't1' || CASE WHEN doc_id % 6 > 0 THEN ',t2' ELSE '' END || CASE WHEN doc_id % 6 > 1 THEN ',t3' ELSE '' END AS topics, 'D' AS
    domain,
    'Health' AS goal, CAST(citations AS INT) AS citation_count, CAST(0 AS INT) AS reference_count, 'A,B' || CASE WHEN venue <> '' THEN ',' || venue
    ELSE '' END AS institutions, false AS is_oa, 'gold' AS status, CAST(1 AS INT) AS n_keywords, 'Humans' AS mesh,
    CASE WHEN doc_id % 3 = 0 THEN venue END AS venue, CAST(doc_id AS STRING) AS volume, '1' AS first_page, CAST(NULL AS STRING) AS last_page FROM
    papers""",
)
_access = (
    "'{\"is_oa\": ' || CASE doc_id % 3 WHEN 0 THEN 'true' ELSE 'false' END || ', \"oa_status\": \"' || CASE doc_id % 3 WHEN 0 THEN 'gold' ELSE '' "
    "END || '\"' || CASE WHEN doc_id % 2 = 0 THEN ', \"best_oa_location\": {\"url_for_pdf\": \"http://x/' || paper_id || '\", \"license\": "
    "\"cc-by\"}' ELSE '' END || '}'"
)
on_papers(
    "payload_access", lambda p: payloads.flat_access(p.select("paper_id", F.expr(_access).alias("payload"))),
    "SELECT paper_id, doc_id % 3 = 0 AS is_oa, CASE WHEN doc_id % 3 = 0 THEN 'gold' END AS oa_status, CASE WHEN doc_id % 2 = 0 THEN 'http://x/' || "
    "paper_id END AS pdf_url, CAST(NULL AS STRING) AS repository, CASE WHEN doc_id % 2 = 0 THEN 'cc-by' END AS license FROM papers"
)
_medical = (
    "'{\"pmid\": \"' || CASE doc_id % 4 WHEN 0 THEN '' ELSE paper_id END || '\", \"mesh_terms\": [{\"descriptor\": \"Humans\"}, {\"descriptor\": "
    "\"' || venue || '\"}], \"grants\": [' || CASE WHEN doc_id % 5 = 0 THEN '\"g\"' ELSE '' END || ']}'"
)
on_papers(
    "payload_medical",
    lambda p: payloads.flat_medical(p.select("paper_id", F.expr(_medical).alias("payload"))).select("paper_id", "pmid", joined("mesh_terms").alias("mesh_terms"), "has_grants", F.size(F.coalesce("chemicals", F.array())).alias("n_chemicals")),
    "SELECT paper_id, CASE WHEN doc_id % 4 > 0 THEN paper_id END AS pmid, 'Humans;' || venue AS mesh_terms, doc_id % 5 = 0 AS has_grants, CAST(0 "
    "AS INT) AS n_chemicals FROM papers",
)

# --- linkage and merges ----------------------------------------------------------------------------------------------
on_papers(
    "batches",
    lambda p: K.batches(p.select("doc_id", "paper_id"), "doc_id", 64).groupBy("batch")
        .agg(F.count("*").alias("n"), F.min("paper_id").alias("first"), F.max("place").alias("last_place")),
    "SELECT batch, count(*) AS n, min(paper_id) AS first, CAST(max(i % 64) AS INT) AS last_place FROM (SELECT paper_id, row_number() OVER (ORDER "
    "BY doc_id) - 1 AS i, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM papers) GROUP BY batch"
)


def _positional(p: DataFrame) -> DataFrame:
    asked = K.batches(p.select("doc_id", "paper_id", "venue"), "doc_id", 50)
    told = F.when(c("doc_id") % 4 > 0, F.concat(F.lit("W"), "paper_id"))
    answers = asked.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", told.alias("a")))), lambda x: x["a"]).alias("answers"))  # 50 a batch
    return K.by_position(asked, answers).select("paper_id", "answer", "found")


on_papers("link_positional", _positional, "SELECT paper_id, CASE WHEN doc_id % 4 > 0 THEN 'W' || paper_id END AS answer, doc_id % 4 > 0 AS found FROM papers")
_arx = rx(f"replace(replace({st('arxiv')}, 'arXiv:', ''), 'arxiv:', '')", "v[0-9]+$")
on_papers(
    "link_arxiv_id",
    lambda p: L.link_equal(
        p.withColumn("aid", T.arxiv_id(c("arxiv"))).select("paper_id", "aid"),
        p.where("doc_id % 3 <> 1").withColumn("aid", T.arxiv_id(c("arxiv"))).select("aid", "doc_id"), "aid", "doc_id", "entry_"
    ).select("paper_id", "entry_doc_id"),
    f"SELECT paper_id, m AS entry_doc_id FROM (SELECT paper_id, CASE WHEN regexp_matches({_arx}, '^[0-9]{{4}}\\.[0-9]{{4,5}}$') OR "
    f"regexp_matches({_arx}, '^[a-z-]+/[0-9]{{7}}$') THEN {_arx} END AS aid FROM papers) LEFT JOIN (SELECT {_arx} AS aid, max(doc_id) AS m FROM "
    f"papers WHERE doc_id % 3 <> 1 GROUP BY 1) USING (aid)",
)
_complete = {
    "title": "title <> ''", "doi": "doi <> ''", "year": "coalesce(year, '') <> ''", "authors": "author <> ''",
    "abstract": "coalesce(abstract, '') <> ''"
}
on_papers(
    "already_complete",
    lambda p: p.groupBy(L.already_complete({k: F.expr(v) for k, v in _complete.items()}).alias("complete")).agg(F.count("*").alias("n")),
    f"SELECT {' AND '.join(_complete.values())} AS complete, count(*) AS n FROM papers GROUP BY 1"
)
on_papers(
    "refresh_metrics",
    lambda p: L.refresh(
        p.select(
            "paper_id", "venue", c("citations").alias("citation_count"), F.when(c("doc_id") % 2 == 0, c("citations") + 5).alias("s_count"),
            F.when(c("doc_id") % 2 == 0, F.lit("S")).alias("s_venue"), F.when(c("doc_id") % 2 == 0, c("doc_id") % 9).alias("s_influential")
        ),
        {"venue": "s_venue"}, {"citation_count": "s_count", "influential_citation_count": "s_influential"}, c("s_venue").isNotNull(),
    ).select("paper_id", "venue", "citation_count", "influential_citation_count", "n_filled", "status"),
    "SELECT paper_id, CASE WHEN venue = '' AND doc_id % 2 = 0 THEN 'S' ELSE venue END AS venue, CASE WHEN doc_id % 2 = 0 THEN citations + 5 ELSE "
    "citations END AS citation_count, CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 END AS influential_citation_count, CAST(venue = '' AND doc_id % 2 = "
    "0 AS INT) AS n_filled, CASE WHEN doc_id % 2 = 0 THEN 'found' ELSE 'not_found' END AS status FROM papers",
)
on_papers(
    "provenance_stamps",
    lambda p: L.stamped(p, "registry", F.lit("2025-01-01T00:00:00Z"), F.array_compact(F.array(F.when(c("venue") == "", "venue"), F.when(c("doi") == "", "doi")))).select("paper_id", "provenance.source", "provenance.at", joined(c("provenance.fields")).alias("fields"), "provenance.n_fields"),
    "SELECT paper_id, 'registry' AS source, '2025-01-01T00:00:00Z' AS at, concat_ws(';', CASE WHEN venue = '' THEN 'venue' END, CASE WHEN doi = '' "
    "THEN 'doi' END) AS fields, CAST(CAST(venue = '' AS INT) + CAST(doi = '' AS INT) AS INT) AS n_fields FROM papers",
)
on_papers(
    "payload_prefixed",
    lambda p: L.prefixed(p.select("paper_id", F.when(c("doc_id") % 2 == 0, _struct(id=c("doc_id"), venue=c("venue"))).alias("w")), "w", "src_"),
    "SELECT paper_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS src_id, CASE WHEN doc_id % 2 = 0 THEN venue END AS src_venue FROM papers"
)
_j = f"(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE))"
on_papers(
    "dedup_titles",
    lambda p: L.distinct_titles(p.select("doc_id", "doi", "title"), 0.9).select("doc_id"),
    f""", t AS (SELECT lower(title) AS t, min(doc_id) AS id, {_tok('any_value(title)')} AS w FROM papers WHERE title <> '' GROUP BY lower(title)),
    near AS (SELECT a.t, min(b.id) AS other FROM t a JOIN t b ON a.t <> b.t AND {_j} > 0.9 GROUP BY a.t)
    SELECT p.doc_id FROM papers p LEFT JOIN t ON t.t = lower(p.title) LEFT JOIN near ON near.t = lower(p.title) LEFT JOIN (SELECT doi, min(doc_id) AS
    d FROM papers WHERE doi <> '' GROUP BY doi) o ON o.doi = p.doi
    WHERE coalesce(least(t.id, other), p.doc_id) >= p.doc_id AND coalesce(o.d, p.doc_id) >= p.doc_id""",
)
on_papers(
    "untitled_ledger",
    lambda p: p.where(~T.present(T.strip(c("title")))).select(
        "paper_id", "doi", "year", F.substring(F.coalesce("abstract", F.lit("")), 1, 200).alias("preview"), "num_references",
        F.lit("missing_title").alias("reason")
    ),
    f"SELECT paper_id, doi, year, substr(coalesce(abstract, ''), 1, 200) AS preview, num_references, 'missing_title' AS reason FROM papers WHERE "
    f"{st('title')} = ''",
)

# --- scores ----------------------------------------------------------------------------------------------------------
_study = "CASE doc_id % 4 WHEN 0 THEN 'rct' WHEN 1 THEN 'cohort' WHEN 2 THEN 'meta_analysis' ELSE 'other' END"
on_papers(
    "quality_legacy",
    lambda p: Q.legacy_parts(p.withColumns({
        "study_type": F.expr(_study), "sample_size": c("doc_id") % 1200, "has_full_text": c("doc_id") % 2 == 0,
        "venue_rank": F.expr("CASE doc_id % 5 WHEN 0 THEN 'Q1' WHEN 1 THEN 'Q3' ELSE 'none' END"), "h_index": c("doc_id") % 60,
        "has_doi": c("doi") != "", "has_pmid": c("doc_id") % 3 == 0, "has_types": F.lit(True), "has_fields": F.lit(False),
    })).select("paper_id", "study_type_points", "venue_points", "legacy_score"),
    f"""SELECT paper_id, CAST(a AS DOUBLE) AS study_type_points, CAST(v AS DOUBLE) AS venue_points, CAST(round(a + CASE WHEN try_cast(year AS INT) >=
    2022 THEN 10 WHEN try_cast(year AS INT) >= 2020 THEN 5 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN
    {case([(f'doc_id % 1200 >= {n}', str(k)) for n, k in Q.LEGACY_SAMPLE], '0')} ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END
    + {case([(f'citations >= {n}', str(k)) for n, k in Q.LEGACY_CITATIONS], '0')} + v +
    {case([(f'doc_id % 60 >= {n}', str(k)) for n, k in Q.LEGACY_AUTHORS], '0')} + CASE WHEN doi <> '' THEN 2.5 ELSE 0 END + CASE WHEN doc_id % 3 = 0
    THEN 2.5 ELSE 0 END + 2.5, 6) AS DOUBLE) AS legacy_score
    FROM (SELECT *, CAST(round(CASE doc_id % 4 WHEN 0 THEN 25 WHEN 1 THEN 15 WHEN 2 THEN 35 ELSE 0 END / CAST(35 AS DOUBLE) * 20, 6) AS DOUBLE) AS a,
    CASE doc_id % 5 WHEN 0 THEN 15 WHEN 1 THEN 8 ELSE 2 END AS v FROM papers)""",
)
on_papers(
    "quality_explained",
    lambda p: p.select(
        "paper_id",
        Q.explained(
            c("citations"), c("doc_id") % 2000, F.expr(_study), c("doc_id") % 2 == 0, c("doc_id") % 3 == 0, c("doc_id") % 5 == 0,
            c("doc_id") % 7 == 0, c("doc_id") % 60, (c("doc_id") % 11) / 10.0, F.coalesce(c("year").try_cast("int"), F.lit(0))
        ).alias("e")
    ).select("paper_id", "e.score", "e.explanation"),
    """SELECT paper_id, score, 'Quality Score: ' || CAST(score AS STRING) || '/100' || chr(10) || chr(10) || 'Breakdown:' || chr(10) || '• Impact: '
    || CAST(i AS STRING) || '/15 (' || CAST(CAST(round(100.0 * i / 15, 0) AS INT) AS STRING) || '%) - ' || CAST(citations AS STRING) || ' citations ('
    || CASE WHEN citations > 100 THEN 'high' WHEN citations > 50 THEN 'moderate' WHEN citations > 10 THEN 'some' ELSE 'limited' END || ' impact)' ||
    chr(10) || chr(10) || 'Overall Grade: ' || CASE WHEN score >= 85 THEN 'A+ (Excellent)' WHEN score >= 70 THEN 'A (Good)' WHEN score >= 60 THEN
    'B (Above Average)' WHEN score >= 45 THEN 'C (Average)' ELSE 'D (Below Average)' END AS explanation
    FROM (SELECT *, CAST(least(100, i + CASE WHEN doc_id % 2000 > 1000 THEN 10 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN 9 ELSE 0 END + CASE WHEN
    doc_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 0 END + CASE WHEN doc_id % 7
    = 0 THEN 5 ELSE 0 END
    + CASE WHEN doc_id % 60 > 50 THEN 10 WHEN doc_id % 60 > 20 THEN 7 ELSE 0 END + doc_id % 11 + CASE WHEN coalesce(try_cast(year AS INT), 0) >= 2023
    THEN 5 ELSE 0 END) AS INT) AS score FROM (SELECT *, CASE WHEN citations > 100 THEN 15 WHEN citations > 50 THEN 12 WHEN citations > 10 THEN 8 ELSE
    0 END AS i FROM papers))""",
)
on_papers(
    "quality_sources",
    lambda p: p.select("paper_id", Q.four_factors(
        F.when(c("doc_id") % 3 == 0, c("citations")), F.when(c("doc_id") % 3 == 1, c("citations") + 1), c("doc_id") % 10,
        F.when(c("doc_id") % 4 == 0, c("doc_id") % 6), c("venue") == "Nature Medicine", F.when(c("doc_id") % 5 > 0, c("doc_id") % 70),
        c("author") != "",
        (F.coalesce(F.length("abstract"), F.lit(0)), c("chars"), c("n_sections") * 100),
        {"doi": c("doi") != "", "pmid": c("doc_id") % 2 == 0, "arxiv": c("arxiv") != ""}, F.coalesce(c("year").try_cast("int"), F.lit(0)),
    ).alias("q")).select("paper_id", "q.*"),
    """SELECT paper_id, CAST(round(least(100, least(20, cited / CAST(10 AS DOUBLE)) + venue_points + author_points + completeness_points +
    metadata_points), 6) AS DOUBLE) AS total, CAST(cited AS BIGINT) AS citations, CASE WHEN doc_id % 3 = 0 AND citations_ <> 0 THEN 's2_data' WHEN
    doc_id % 3 = 1 THEN 'crossref' ELSE 'basic' END AS source, venue_points, author_points, completeness_points, metadata_points
    FROM (SELECT *, citations AS citations_, CASE WHEN doc_id % 3 = 0 AND citations <> 0 THEN citations WHEN doc_id % 3 = 1 THEN citations + 1 ELSE
    doc_id % 10 END AS cited, CAST(CASE WHEN doc_id % 4 = 0 THEN least(20, doc_id % 6 * 5) WHEN venue = 'Nature Medicine' THEN 15 ELSE 5 END AS
    DOUBLE) AS venue_points,
    CAST(CASE WHEN doc_id % 5 > 0 THEN round(least(10, doc_id % 70 / CAST(5 AS DOUBLE)), 6) ELSE 3 END AS DOUBLE) AS author_points, CAST(CASE WHEN
    coalesce(length(abstract), 0) > 100 THEN 10 ELSE 0 END + CASE WHEN chars > 500 THEN 10 ELSE 0 END + CASE WHEN n_sections * 100 > 500 THEN 10 ELSE
    0 END AS DOUBLE) AS completeness_points,
    CAST(CASE WHEN doi <> '' THEN 5 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN arxiv <> '' THEN 3 ELSE 0 END + CASE WHEN
    try_cast(year AS INT) > 2020 THEN 3 WHEN try_cast(year AS INT) > 2015 THEN 1 ELSE 0 END AS DOUBLE) AS metadata_points FROM papers)""",
)
on_papers(
    "research_areas", lambda p: p.groupBy(Q.area(c("body")).alias("area")).agg(F.count("*").alias("n")),
    f"SELECT {case([(anyof('lower(body)', w), lit(k)) for k, w in Q.AREAS], lit('other'))} AS area, count(*) AS n FROM papers GROUP BY 1"
)

# --- reports and control ---------------------------------------------------------------------------------------------
#: Six critical and eighteen enrichment fields, and what stands for them in these papers.
FIELDS_24 = {
    "title": "title <> ''", "doi": "doi <> ''", "year": "coalesce(year, '') <> ''", "authors": "author <> ''",
    "abstract": "coalesce(abstract, '') <> ''", "sections": "n_sections > 0", "journal": "venue <> ''", "publisher": "doc_id % 3 = 0",
    "keywords": "doc_id % 4 > 0",
    "references": "num_references > 0", "cited_by_count": "citations > 0", "issn": "doc_id % 5 > 1", "volume": "doc_id % 6 > 0",
    "issue": "doc_id % 7 > 0", "pages": "doc_id % 8 > 0", "funders": "doc_id % 9 = 0", "licenses": "doc_id % 10 = 0", "oa_status": "doc_id % 11 > 4",
    "topics": "doc_id % 12 > 3",
    "mesh_terms": "doc_id % 13 = 0", "arxiv_id": "arxiv <> ''", "pmid": "doc_id % 14 > 6", "semantic_scholar_id": "doc_id % 15 > 0",
    "openalex_id": "doc_id % 16 > 0",
}
N_CRITICAL = 6
on_papers(
    "coverage_whole",
    lambda p: R.coverage(p, {k: F.expr(v) for k, v in FIELDS_24.items()}).withColumn("light", Q.light(c("percent")))
        .withColumn("critical", c("field").isin(*list(FIELDS_24)[:N_CRITICAL])),
    "SELECT field, present, percent, CASE WHEN percent >= 80 THEN 'green' WHEN percent >= 50 THEN 'yellow' ELSE 'red' END AS light, critical FROM ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS field, count_if({v}) AS present, round(100.0 * count_if({v}) / count(*), 6) AS percent, {str(i < N_CRITICAL).lower()} AS "
        f"critical FROM papers"
        for i,
        (k, v) in enumerate(FIELDS_24.items())
    )
    + ")",
)
_lost = " + ".join(f"CAST(NOT ({v}) AS INT)" for v in list(FIELDS_24.values())[:N_CRITICAL])
on_papers(
    "missing_thresholds",
    lambda p: p.select(F.expr(_lost).alias("m")).agg(F.count_if(c("m") >= 1).alias("any"), F.count_if(c("m") >= 2).alias("two_or_more"), F.count_if(c("m") >= 3).alias("three_or_more")),
    f'SELECT count_if(m >= 1) AS "any", count_if(m >= 2) AS two_or_more, count_if(m >= 3) AS three_or_more FROM (SELECT {_lost} AS m FROM papers)'
)
add(
    "exclusion_ledger", lambda s, d: K.ledger(s),
    "SELECT * FROM (VALUES ('input', CAST(2221 AS BIGINT), CAST(0 AS BIGINT)), ('extraction', 2210, 11), ('quality', 2170, 40), ('articles', 2151, "
    "19), ('titles', 2150, 1)) t(step, papers, excluded)"
)
on_papers(
    "latest_stage",
    lambda p: K.latest_stage(
        _stages(p).select(c("stage").cast("string").alias("stage"), F.when(c("stage") == 4, 0).otherwise(c("papers")).alias("papers")),
        ["4", "3", "2", "1"]
    ),
    "SELECT '3' AS stage"
)
_cat = "CASE WHEN title = '' THEN 'untitled' WHEN venue = '' THEN 'no venue' ELSE 'kept' END"
on_papers(
    "readable_report",
    lambda p: K.report(
        "Papers", p.groupBy(F.expr(_cat).alias("category")).agg(F.count("*").alias("n")), "category", "n",
        L.rank_first(p.select(F.expr(_cat).alias("category"), c("paper_id").alias("text")), ["category"], [c("text")], 2)
    ),
    f"""SELECT CAST(row_number() OVER (ORDER BY part, key, i) AS INT) AS pos, line FROM (
    SELECT 0 AS part, '' AS key, 0 AS i, '# Papers (' || CAST(count(*) AS STRING) || ' papers)' AS line FROM papers UNION ALL
    SELECT 1, category, 0, '- **' || category || '**: ' || CAST(n AS STRING) || ' (' || printf('%.1f', round(100.0 * n / sum(n) OVER (), 1)) || '%)'
    FROM (SELECT {_cat} AS category, count(*) AS n FROM papers GROUP BY 1) UNION ALL
    SELECT 2, category, r, category || ': ' || paper_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY paper_id) AS r FROM (SELECT
    {_cat} AS category, paper_id FROM papers)) WHERE r <= 2)""",
)


def _commanded(p: DataFrame) -> DataFrame:
    rows = p.select("paper_id", (c("doc_id") % 97).alias("score"), "venue", "doc_id")
    return K.run_commands({"a": rows.where("doc_id % 2 = 0"), "b": rows.where("doc_id % 3 = 0")}, ["get a", "merge b  # new ones only", "", "filter venue <> ''", "top 30"])


on_papers(
    "batch_commands", _commanded,
    "SELECT paper_id, doc_id % 97 AS score, venue, doc_id FROM papers WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND venue <> '' ORDER BY score "
    "DESC, paper_id LIMIT 30"
)
add(
    "smart_get",
    lambda s, d: S.smart_get(S.sections_optimized(sections(s, d)), "How was the study conducted?", 15).select("paper_id", "type", "hits"),
    f"WITH {SECTIONS_SQL} SELECT paper_id, type, CAST(hits AS INT) AS hits FROM (SELECT *, CAST(contains(lower(text), 'conducted') AS INT) + "
    f"CAST(contains(lower(text), 'study') AS INT) AS hits FROM ({OPTIMIZED}) WHERE type = 'methods') WHERE hits > 0 ORDER BY hits DESC, paper_id, "
    f"type LIMIT 15",
)
add(
    "get_sections",
    lambda s, d: S.get_sections(S.sections_optimized(sections(s, d)), ["Results", "conclusion"]).groupBy("type").agg(F.count("*").alias("n")),
    f"WITH {SECTIONS_SQL} SELECT type, count(*) AS n FROM ({OPTIMIZED}) WHERE type IN ('results', 'conclusion') GROUP BY type"
)


def _metrics(s: SparkSession, d: str) -> DataFrame:
    maps = S.as_map(S.sections_optimized(sections(s, d)))
    return papers(s, d).join(maps, "paper_id").select("paper_id", S.quality_metrics(c("abstract"), c("sections"), c("num_references")).alias("m")).select(
        "paper_id", "m.has_abstract", "m.abstract_length", "m.section_count", "m.has_methods", "m.has_results", "m.total_content_length",
        "m.needs_retry"
    )


add(
    "quality_metrics",
    _metrics,
    f"WITH {PAPERS_SQL}, {SECTIONS_SQL}, o AS ({OPTIMIZED}), m AS (SELECT paper_id, CAST(count(*) AS INT) AS section_count, bool_or(type = "
    f"'methods') AS has_methods, bool_or(type = 'results') AS has_results, CAST(sum(length(text)) AS INT) AS total_content_length FROM o GROUP BY "
    f"paper_id) "
    "SELECT paper_id, n > 100 AS has_abstract, n AS abstract_length, section_count, has_methods, has_results, total_content_length, section_count "
    "< 4 OR n < 100 AS needs_retry FROM (SELECT m.*, CAST(coalesce(length(abstract), 0) AS INT) AS n FROM m JOIN papers USING (paper_id))",
)
add(
    "post_processed",
    lambda s, d: S.post_process(papers(s, d).select("paper_id", "title", "abstract"), sections(s, d)).select(
        "paper_id", F.length("abstract").alias("abstract_length"), F.size("sections").alias("n_sections"),
        F.col("hidden").isNotNull().alias("has_hidden"), "metrics.needs_retry", F.round("score", 6).alias("score")
    )
)

# --- streams ---------------------------------------------------------------------------------------------------------
add(
    "stream_windows",
    lambda s, d: incremental.finished_windows(table(s, d, "events"), f"{d}/events.parquet", "1 hour", "10 minutes"),
    "SELECT CAST(w AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT date_trunc('hour', ts) AS w, "
    "event_type, value FROM events) WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL",
)
add(
    "changed_papers",
    lambda s, d: incremental.changed(
        _hashed(papers(s, d)),
        _hashed(papers(s, d).where("doc_id % 4 > 0").withColumn("venue", F.when(c("doc_id") % 3 == 0, "other").otherwise(c("venue"))))
    ).select("paper_id"),
    f"WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE doc_id % 4 = 0 OR doc_id % 3 = 0",
)
add(
    "pending_papers",
    lambda s, d: incremental.pending(
        papers(s, d).select("paper_id"), papers(s, d).select("paper_id", F.lit("enrich").alias("stage"), (c("doc_id") % 3).alias("version")),
        "enrich", 2
    ),
    f"WITH {PAPERS_SQL} SELECT paper_id FROM papers WHERE doc_id % 3 < 2",
)


def _hashed(p: DataFrame) -> DataFrame:
    return p.select("paper_id", records.content_hash(p, ["title", "venue"]).alias("hash"))


# --- exports and bounds ----------------------------------------------------------------------------------------------
_field = lambda k, e: f"CASE WHEN coalesce({e}, '') <> '' THEN '  {k} = {{' || {e} || '}}' END"
ORACLES["export_citations"] = (
    f"WITH {PAPERS_SQL} SELECT paper_id, md5('@article{{' || paper_id || ',' || chr(10) || concat_ws(',' || chr(10), "
    + ", ".join(_field(k, e) for k, e in (("title", "title"), ("author", "author"), ("year", "year"), ("journal", "venue"), ("doi", "doi")))
    + ") || chr(10) || '}') AS bib, concat_ws('. ', author, '*' || title || '*', venue, coalesce(year, '')) AS md FROM papers"
)
add(
    "approx_distinct_bound",
    lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag")
        .agg((F.abs(F.approx_count_distinct("l_partkey", 0.02) - F.count_distinct("l_partkey")) <= 0.06 * F.count_distinct("l_partkey")).alias("within")),
    "SELECT l_returnflag, true AS within FROM lineitem GROUP BY 1",
)


# --- sections by tiers ---------------------------------------------------------------------------------------------------
# Every third paper's headers get a slip of the pen, which only the third tier forgives.
_SLIP = "CASE WHEN CAST(paper_id AS BIGINT) % 3 = 0 THEN replace(replace(header, 'Results', 'Rasults'), 'Introduction', 'Introduktion') ELSE header END"
_alike = lambda k: f"1 - levenshtein(norm, '{k}') / greatest(length(norm), {len(k)})::DOUBLE >= {S.FUZZY}"
add(
    "sections_tiered",
    lambda s, d: S.sections_tiered(sections(s, d).where("pos % 5 > 0").withColumn("header", F.expr(_SLIP))).groupBy("type", "tier")
        .agg(F.count("*").alias("n")),
    f"""WITH {SECTIONS_SQL}, slipped AS (SELECT paper_id, {_SLIP} AS header FROM sections WHERE pos % 5 > 0), once AS (SELECT *, {st('lower(header)')}
    AS low, {_hd} AS norm FROM slipped),
    one AS (SELECT paper_id, {case([(f"low = {lit(k)}", lit(k)) for k in S.CANONICAL])} AS t1, {TYPE('low')} AS t2,
    {case([(_alike(k), lit(k)) for k in S.CANONICAL])} AS t3 FROM once),
    found AS (SELECT paper_id, count(DISTINCT t1) AS n1, count(DISTINCT coalesce(t1, t2)) AS n2 FROM one GROUP BY paper_id),
    typed AS (SELECT t1, CASE WHEN n1 < {S.FIRST_EXIT} THEN t2 END AS t2, CASE WHEN n1 < {S.FIRST_EXIT} AND n2 < {S.SECOND_EXIT} THEN t3 END AS t3
    FROM one JOIN found USING (paper_id))
    SELECT coalesce(t1, t2, t3) AS type, CAST(CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 ELSE 3 END AS INT) AS tier, count(*) AS n
    FROM typed WHERE coalesce(t1, t2, t3) IS NOT NULL GROUP BY ALL""",
)


# --- abstract recovery -------------------------------------------------------------------------------------------------
def _recovered() -> str:
    """The recovery chain on the five aggregated sections: methods, introduction, a section named like the title, sentences."""
    count = lambda e, words: "(" + " + ".join(f"CAST(contains({e}, {lit(w)}) AS INT)" for w in words) + ")"
    split = lambda e: f"string_split({rx(e, '([.!?])' + chr(92) + 's+', chr(92) + '1' + chr(1))}, chr(1))"
    pick = lambda e, words: f"list_filter({split(e)}[1:3], x -> {anyof('lower(x)', words)})[1]"
    named = [
        (
            f"len(list_filter(words, x -> contains({lit(k)}, x))) >= 2 AND {anyof(f'lower(substr({k}, 1, 2000))', S.TITLE_PHRASES)}",
            st(f"substr({k}, 1, 1500)")
        )
        for k in ("conclusion", "discussion", "introduction", "methods", "results")
    ]
    made = (
        f"list_filter([{pick('methods', ('participants', 'assigned', 'conducted', 'we'))}, "
        f"{pick('results', ('significant', 'found', 'demonstrated', 'showed'))}, {split('conclusion')}[1]], x -> x IS NOT NULL)"
    )
    return f"""{WITH_MAP}, parts AS (SELECT m.*, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]{{4,}}') AS words,
    CASE WHEN contains(methods, chr(10) || chr(10)) THEN split_part(methods, chr(10) || chr(10), 1) ELSE substr(methods, 1, 1500) END AS head FROM m
    JOIN papers USING (paper_id)), told AS (SELECT *, {made} AS made FROM parts)
    SELECT paper_id, coalesce(CASE WHEN {count('lower(head)', S.METHOD_WORDS)} >= 2 THEN {st('head')} END,
    CASE WHEN length(introduction) >= 500 AND {count('lower(substr(introduction, 1, 2000))', S.INTRO_WORDS)} >= 3 THEN
    {st("substr(array_to_string(string_split(introduction, chr(10) || chr(10))[1:3], chr(10) || chr(10)), 1, 1500)")} END,
    {case(named)}, CASE WHEN len(made) >= 2 THEN '[Abstract synthesized from paper sections] ' || array_to_string(made, ' ') END) AS abstract FROM
    told"""


ORACLES["abstract_recovery"] = whole(re.sub(r"\b([a-z]) -> ", r"lambda \1: ", _recovered()))
