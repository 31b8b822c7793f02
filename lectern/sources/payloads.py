"""Payloads of reference services as JSON strings, flattened to columns with declared schemas and built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATE = "struct<`date-parts`: array<array<int>>>"
# What is read of each payload. Undeclared fields are not parsed.
WORK = (
    "DOI string, type string, publisher string, title array<string>, `container-title` array<string>, abstract string, volume string, issue "
    "string, page string, "
    f"issued {_DATE}, `published-online` {_DATE}, author array<struct<given: string, family: string, ORCID: string>>, ISSN array<string>, subject "
    f"array<string>, "
    "`is-referenced-by-count` int, funder array<struct<name: string, DOI: string>>, license array<struct<URL: string>>, reference array<struct<DOI: string>>"
)
GRAPH_WORK = (
    "id string, doi string, title string, publication_year int, type string, is_retracted boolean, cited_by_count int, topics "
    "array<struct<display_name: string, score: double>>, "
    "authorships array<struct<author: struct<display_name: string>, institutions array<struct<display_name: string>>>>, counts_by_year "
    "array<struct<year: int, cited_by_count: int>>, open_access struct<is_oa: boolean, oa_status: string>"
).replace("institutions array", "institutions: array")
MOST_REFERENCES, MOST_TOPICS = 100, 3


def date_of(parts: Column) -> Column:
    """[[y, m, d]] as y, y-mm or y-mm-dd."""
    return F.array_join(F.transform(F.get(parts, 0), lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))), "-")


def without_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def flat_work(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with the basic fields of a registry's work; lists of one value become that value."""
    w = F.from_json(F.col(payload), WORK)
    first = lambda x: F.get(x, 0)
    names = F.transform(w["author"], lambda a: F.concat_ws(" ", a["given"], a["family"]))
    return rows.withColumns({
        "doi": w["DOI"], "type": w["type"], "title": first(w["title"]), "journal": first(w["container-title"]),
        "abstract": without_tags(w["abstract"]), "issued": date_of(w["issued"]["date-parts"]), "authors": names,
        "issn": first(w["ISSN"]), "citations": w["is-referenced-by-count"], "funders": F.array_distinct(w["funder"]["name"]),
        "license": first(w["license"])["URL"],
        "references": F.slice(F.array_compact(w["reference"]["DOI"]), 1, MOST_REFERENCES), "has_abstract": w["abstract"].isNotNull(),
        "has_orcid": F.coalesce(F.exists(w["author"], lambda a: a["ORCID"].isNotNull()), F.lit(False)),
    }).drop(payload)


def flat_graph_work(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with a citation graph's work: top topics, distinct institutions, citations by year as a map."""
    w = F.from_json(F.col(payload), GRAPH_WORK)
    return rows.withColumns({
        "doi": F.regexp_replace(w["doi"], "^https?://doi.org/", ""), "title": w["title"], "year": w["publication_year"],
        "topics": F.transform(F.slice(w["topics"], 1, MOST_TOPICS), lambda t: t["display_name"]),
        "institutions": F.array_distinct(F.flatten(F.transform(w["authorships"], lambda a: a["institutions"]["display_name"]))),
        "authors": w["authorships"]["author"]["display_name"],
        "citations": w["cited_by_count"],
        "citations_by_year": F.map_from_entries(F.transform(w["counts_by_year"], lambda x: F.struct(x["year"], x["cited_by_count"]))),
        "is_oa": w["open_access"]["is_oa"],
    }).drop(payload)


def creator_names(creators: Column) -> Column:
    """Names of a reference manager's authors and contributors: first and last name, or the single name."""
    people = F.filter(creators, lambda p: p["creatorType"].isin("author", "contributor"))
    named = F.transform(people, lambda p: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", p["firstName"], p["lastName"])), F.lit("")), p["name"]))
    return F.filter(named, lambda x: F.coalesce(x, F.lit("")) != "")


# What is read of a scholar graph's paper, a repository aggregator's work and a preprint feed's entry.
PAPER = (
    "paperId string, externalIds struct<DOI: string, PubMed: string, ArXiv: string>, title string, abstract string, year string, publicationDate "
    "string, venue string, journal struct<name: string, volume: string, pages: string>, "
    "publicationVenue struct<id: string, type: string, alternate_names: array<string>, issn: string>, citationCount int, referenceCount int, "
    "influentialCitationCount int, isOpenAccess boolean, openAccessPdf struct<url: string>, "
    "fieldsOfStudy array<string>, s2FieldsOfStudy array<struct<category: string, source: string>>, publicationTypes array<string>, "
    "authors array<struct<authorId: string, name: string, hIndex: int, citationCount: int, paperCount: int>>, tldr struct<text: string, model: "
    "string>, citations array<struct<title: string>>, references array<struct<title: string>>"
)
REPOSITORY_WORK = (
    "id string, title string, doi string, yearPublished int, abstract string, fullText string, downloadUrl string, dataProvider struct<id: string, "
    "name: string, url: string>, authors array<struct<name: string>>, publisher string, "
    "journal struct<title: string, identifiers: array<string>>, language string, documentType string, oai string, links array<struct<url: string, "
    "type: string>>, downloadCount int, viewCount int"
)
ENTRY = (
    "id string, title string, summary string, author array<struct<name: string, affiliation: string>>, published string, updated string, "
    "primary_category struct<_term: string>, category array<struct<_term: string>>, doi string, journal_ref string, comment string"
)
MOST_TITLES = 10


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def flat_paper(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with a scholar graph's paper: ids, metrics (0 where missing), named authors, highest h-index above 0, first titles."""
    w = F.from_json(F.col(payload), PAPER)
    zero = lambda x: F.coalesce(x, F.lit(0))
    titles = lambda x: F.transform(F.slice(x, 1, MOST_TITLES), lambda t: F.coalesce(t["title"], F.lit("")))
    people = F.filter(w["authors"], lambda a: F.coalesce(a["name"], F.lit("")) != "")
    return rows.withColumns({
        "graph_id": F.coalesce(w["paperId"], F.lit("")), "doi": _some(w["externalIds"]["DOI"]), "pubmed_id": w["externalIds"]["PubMed"],
        "arxiv_id": w["externalIds"]["ArXiv"],
        "title": _some(w["title"]), "abstract": _some(w["abstract"]), "year": F.nullif(_some(w["year"]), F.lit("0")),
        "publication_date": _some(w["publicationDate"]), "venue": _some(w["venue"]),
        "journal": _some(w["journal"]["name"]), "volume": _some(w["journal"]["volume"]), "pages": _some(w["journal"]["pages"]),
        "venue_detail": w["publicationVenue"],
        "citation_count": zero(w["citationCount"]), "reference_count": zero(w["referenceCount"]),
        "influential_citation_count": zero(w["influentialCitationCount"]),
        "is_open_access": F.coalesce(w["isOpenAccess"], F.lit(False)), "open_access_pdf_url": w["openAccessPdf"]["url"],
        "fields_of_study": w["fieldsOfStudy"], "field_sources": w["s2FieldsOfStudy"], "publication_types": w["publicationTypes"],
        "authors": people, "max_author_h_index": F.array_max(F.filter(people["hIndex"], lambda h: h != 0)), "tldr": w["tldr"]["text"],
        "tldr_model": w["tldr"]["model"],
        "citation_titles": titles(w["citations"]), "reference_titles": titles(w["references"]),
    }).drop(payload)


def flat_repository_work(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with a repository aggregator's work; language is a name or an object that has one."""
    w = F.from_json(F.col(payload), REPOSITORY_WORK)
    url = _some(w["downloadUrl"])
    return rows.withColumns({
        "core_id": w["id"], "title": w["title"], "doi": w["doi"], "year": w["yearPublished"], "abstract": w["abstract"],
        "has_fulltext": w["fullText"].isNotNull(), "download_url": url, "has_pdf": url.endswith(".pdf"),
        "repository": w["dataProvider"], "authors": F.filter(w["authors"]["name"], lambda n: F.coalesce(n, F.lit("")) != ""),
        "publisher": _some(w["publisher"]), "journal": w["journal"]["title"], "issn": F.get(w["journal"]["identifiers"], 0),
        "language": F.when(w["language"].startswith("{"), F.get_json_object(w["language"], "$.name")).otherwise(_some(w["language"])),
        "document_type": _some(w["documentType"]), "oai_identifier": _some(w["oai"]),
        "links": F.filter(w["links"], lambda x: F.coalesce(x["url"], F.lit("")) != ""), "download_count": F.nullif(w["downloadCount"], F.lit(0)),
        "view_count": F.nullif(w["viewCount"], F.lit(0)),
    }).drop(payload)


def _entry(w: dict[str, Column] | Column) -> dict[str, Column]:
    full = _some(F.regexp_extract(w["id"], r"arxiv\.org/abs/(.+)$", 1))
    bare = F.regexp_replace(full, r"v\d+$", "")
    primary = _some(w["primary_category"]["_term"])
    others = F.coalesce(w["category"]["_term"], F.array().cast("array<string>"))
    return {
        "title": F.trim(F.coalesce(w["title"], F.lit(""))), "abstract": F.trim(F.coalesce(w["summary"], F.lit(""))), "arxiv_id": bare,
        "version": F.regexp_extract(full, r"v(\d+)$", 1).try_cast("int"),
        "arxiv_url": F.concat(F.lit("https://arxiv.org/abs/"), bare), "pdf_url": F.concat(F.lit("https://arxiv.org/pdf/"), bare, F.lit(".pdf")),
        "authors": F.filter(w["author"], lambda a: F.coalesce(a["name"], F.lit("")) != ""), "first_submitted": _some(F.substring(w["published"], 1, 10)),
        "last_updated": F.when(~w["updated"].eqNullSafe(w["published"]), _some(F.substring(w["updated"], 1, 10))), "primary_category": primary,
        "categories": F.filter(F.array_distinct(F.concat(F.array(primary), others)), lambda x: F.coalesce(x, F.lit("")) != ""),
        "published_doi": _some(w["doi"]), "journal_ref": _some(w["journal_ref"]), "comment": _some(w["comment"]),
    }


def flat_entry(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with a preprint feed's entry (XML): id without version, links, distinct categories with the primary one first."""
    return rows.withColumns(_entry(F.from_xml(F.col(payload), ENTRY, {"ignoreNamespace": "true"}))).drop(payload)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The entries of Atom feeds, split by Spark's reader."""
    rows = spark.read.format("xml").options(rowTag="entry", ignoreNamespace="true").schema(ENTRY).load(path)
    return rows.select(*(v.alias(k) for k, v in _entry({x: F.col(x) for x in rows.columns}).items()))


def author_names(named: Column, *plain: Column) -> Column:
    """Names of the first list that holds any: structs with a name, then lists of names."""
    some = lambda x: F.when(F.size(x) > 0, x)
    return F.coalesce(
        F.when(F.size(named) > 0, F.filter(named["name"], lambda n: F.coalesce(n, F.lit("")) != "")), *map(some, plain),
        F.array().cast("array<string>")
    )


# The rest of what is read of a registry's work and of a citation graph's.
_STAMP = "struct<`date-time`: string, `date-parts`: array<array<int>>>"
DATES = ("created", "deposited", "indexed", "issued", "published-print", "published-online", "accepted", "approved")
BASICS = (
    "DOI", "URL", "type", "title", "subtitle", "short-title", "container-title", "container-title-short", "publisher", "publisher-location", "volume",
    "issue", "page", "article-number"
)
_LISTED = ("title", "subtitle", "short-title", "container-title", "container-title-short")
FLAGS = ("peer-review", "content-domain", "assertion")
WHOLE_WORK = (
    ", ".join(f"`{k}` {'array<string>' if k in _LISTED else 'string'}" for k in BASICS) + ", " + ", ".join(f"`{k}` {_STAMP}" for k in DATES)
    + ", author array<struct<given: string, family: string, ORCID: string, affiliation: array<struct<name: string>>>>, abstract string, ISSN "
    "array<string>, ISBN array<string>, archive array<string>"
    + ", `is-referenced-by-count` int, `references-count` int, score double, subject array<string>, keyword array<string>"
    + ", `clinical-trial-number` array<struct<`clinical-trial-number`: string, registry: string>>, funder array<struct<name: string, DOI: string, "
    "award: array<string>>>"
    + ", license array<struct<URL: string, start: struct<`date-time`: string>, `content-version`: string>>, relation map<string, array<string>>, "
    "reference array<string>, "
    + ", ".join(f"`{k}` string" for k in FLAGS)
)


def whole_work(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with every field of a registry's work: lists of one value become it, dates their stamp or joined parts, empty values null."""
    w = F.from_json(F.col(payload), WHOLE_WORK)
    named = lambda k: k.lower().replace("-", "_")
    day = lambda d: F.coalesce(d["date-time"], F.nullif(F.array_join(F.get(d["date-parts"], 0), "-"), F.lit("")))
    listed = lambda x: F.when(F.size(x) > 0, x)
    person = lambda a: F.struct(
        F.trim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit("")))).alias("name"), a["given"].alias("given"),
        a["family"].alias("family"),
        a["ORCID"].alias("orcid"), listed(F.filter(a["affiliation"]["name"], lambda x: x.isNotNull())).alias("affiliations"),
    )
    return rows.withColumns(
        {named(k): _some(F.get(w[k], 0) if k in _LISTED else w[k]) for k in BASICS}
        | {named(k) + "_date": day(w[k]) for k in DATES}
        | {
            "authors": F.transform(w["author"], person), "abstract": F.regexp_replace(w["abstract"], "<[^<]+?>", ""),
            **{k.lower(): listed(w[k]) for k in ("ISSN", "ISBN", "archive")},
            "citations": w["is-referenced-by-count"], "references_count": w["references-count"], "match_score": w["score"], "subjects": w["subject"],
            "keywords": w["keyword"],
            "clinical_trials": F.transform(w["clinical-trial-number"], lambda t: F.struct(t["clinical-trial-number"].alias("number"), t["registry"].alias("registry"))),
            "funders": F.transform(w["funder"], lambda f: F.struct(f["name"].alias("name"), f["DOI"].alias("doi"), f["award"].alias("awards"))),
            "licenses": F.transform(
                w["license"],
                lambda x: F.struct(x["URL"].alias("url"), x["start"]["date-time"].alias("start"), x["content-version"].alias("content_version"))
            ),
            "relations": F.map_filter(w["relation"], lambda k, v: F.size(v) > 0), "reference_count": F.when(F.size(w["reference"]) > 0, F.size(w["reference"])),
            "references_sample": F.slice(listed(w["reference"]), 1, MOST_REFERENCES), **{"has_" + named(k): w[k].isNotNull() for k in FLAGS},
        }
    ).drop(payload)


_NAMED = "struct<id: string, display_name: string, score: double>"
_PLACE = "struct<display_name: string>"
WHOLE_GRAPH_WORK = (
    "id string, doi string, title string, publication_year int, type string, is_retracted boolean, is_paratext boolean, "
    f"topics array<struct<id: string, display_name: string, score: double, domain: {_PLACE}, field: {_PLACE}, subfield: {_PLACE}>>, "
    f"sustainable_development_goals array<{_NAMED}>, "
    "cited_by_count int, referenced_works_count int, counts_by_year array<struct<year: int, cited_by_count: int>>, cited_by_percentile_year "
    "struct<min: int, max: int>, "
    f"authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, institutions: array<{_PLACE}>>>, open_access "
    f"struct<is_oa: boolean, oa_status: string, oa_url: string>, "
    "keywords array<struct<display_name: string, score: double>>, mesh array<struct<descriptor_name: string, qualifier_name: string, "
    "is_major_topic: boolean>>, "
    "primary_location struct<source: struct<id: string, display_name: string, type: string, issn_l: string, is_oa: boolean>>, biblio "
    "struct<volume: string, issue: string, first_page: string, last_page: string>"
)


def whole_graph_work(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with every field that is read of a citation graph's work; institutions sorted, each once."""
    w = F.from_json(F.col(payload), WHOLE_GRAPH_WORK)
    own = lambda x, **names: F.struct(*(x[v].alias(k) for k, v in names.items()))
    topic = lambda t: F.struct(
        t["id"].alias("id"), t["display_name"].alias("name"), t["score"].alias("score"),
        *(t[k]["display_name"].alias(k) for k in ("domain", "field", "subfield"))
    )
    source = w["primary_location"]["source"]
    return rows.withColumns({
        "graph_id": F.replace(F.coalesce(w["id"], F.lit("")), F.lit("https://openalex.org/"), F.lit("")),
        "doi": F.replace(F.coalesce(w["doi"], F.lit("")), F.lit("https://doi.org/"), F.lit("")),
        "title": w["title"], "year": w["publication_year"], "type": w["type"], "is_retracted": F.coalesce(w["is_retracted"], F.lit(False)),
        "is_paratext": F.coalesce(w["is_paratext"], F.lit(False)),
        "topics": F.transform(F.slice(w["topics"], 1, MOST_TOPICS), topic),
        "sdgs": F.transform(w["sustainable_development_goals"], lambda g: own(g, id="id", name="display_name", score="score")),
        "citation_count": F.coalesce(w["cited_by_count"], F.lit(0)), "reference_count": F.coalesce(w["referenced_works_count"], F.lit(0)),
        "citations_by_year": F.map_from_entries(
            F.transform(
                F.filter(w["counts_by_year"], lambda x: F.coalesce(x["year"], F.lit(0)) != 0),
                lambda x: F.struct(x["year"].cast("string"), x["cited_by_count"])
            )
        ),
        "citation_percentile": w["cited_by_percentile_year"],
        "authors": F.transform(w["authorships"]["author"], lambda a: own(a, id="id", name="display_name", orcid="orcid")),
        "institutions": F.array_sort(
            F.array_distinct(
                F.filter(
                    F.flatten(F.transform(w["authorships"], lambda a: F.coalesce(a["institutions"]["display_name"], F.array().cast("array<string>")))),
                    lambda x: F.coalesce(x, F.lit("")) != ""
                )
            )
        ),
        "open_access": F.when(
            w["open_access"].isNotNull(),
            F.struct(
                F.coalesce(w["open_access"]["is_oa"], F.lit(False)).alias("is_oa"), w["open_access"]["oa_status"].alias("status"),
                w["open_access"]["oa_url"].alias("url")
            )
        ),
        "keywords": F.transform(F.filter(w["keywords"], lambda k: F.coalesce(k["display_name"], F.lit("")) != ""), lambda k: own(k, name="display_name", score="score")),
        "mesh_terms": F.transform(w["mesh"], lambda m: own(m, descriptor="descriptor_name", qualifier="qualifier_name", is_major="is_major_topic")),
        "venue": F.when(source.isNotNull(), own(source, id="id", name="display_name", type="type", issn="issn_l", is_oa="is_oa")),
        **{k: w["biblio"][k] for k in ("volume", "issue", "first_page", "last_page")},
    }).drop(payload)


# What readers know of an open-access record and of a medical index's record.
ACCESS = "is_oa boolean, oa_status string, best_oa_location struct<url_for_pdf: string, repository: string, license: string>"
MEDICAL = (
    "pmid string, mesh_terms array<struct<descriptor: string>>, chemicals array<struct<name: string>>, publication_types array<string>, grants "
    "array<string>"
)


def flat_access(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with an open-access record: status, and the best location's file, repository and license."""
    w = F.from_json(F.col(payload), ACCESS)
    best = w["best_oa_location"]
    return rows.withColumns(
        {
            "is_oa": F.coalesce(w["is_oa"], F.lit(False)), "oa_status": _some(w["oa_status"]), "pdf_url": _some(best["url_for_pdf"]),
            "repository": _some(best["repository"]), "license": _some(best["license"])
        }
    ).drop(payload)


def flat_medical(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with a medical index's record: descriptors, chemicals, publication types, and whether grants are named."""
    w = F.from_json(F.col(payload), MEDICAL)
    return rows.withColumns(
        {
            "pmid": _some(w["pmid"]), "mesh_terms": w["mesh_terms"]["descriptor"], "chemicals": w["chemicals"]["name"],
            "publication_types": w["publication_types"], "has_grants": F.coalesce(F.size(w["grants"]) > 0, F.lit(False))
        }
    ).drop(payload)
