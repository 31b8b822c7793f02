"""What other readings of a TEI document give: direct sections, entity groups, coordinates, metadata, structure, a repaired year.

All of them come from one Arrow pass, since mixed content has an order that Spark's XPath functions lose; texts and lists
go on as columns, and what patterns find in running text is left to the entity functions, which stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import entities as E

SCHEMA = """
paper_id string, parse_error string, full_text string, legacy_text string,
direct struct<title:string,abstract:string,authors:array<struct<name:string,email:string,orcid:string>>,ids:map<string,string>,num_references:int,
  sections:array<struct<title:string,text:string>>>,
persons array<string>, organizations array<string>, locations array<string>, equations array<string>, emails array<string>, orcids array<string>,
acknowledgement string, body_sections array<struct<title:string,text:string>>, coordinates map<string,string>,
citations array<struct<title:string,authors:array<string>,year:string,doi:string,journal:string,raw_text:string>>,
figures array<struct<label:string,caption:string,id:string>>, tables array<struct<label:string,caption:string,content:string,id:string>>,
guarded_abstract string, summary struct<authors:array<string>,doi:string,references_count:int>,
metadata struct<title:string,authors:array<struct<name:string,email:string,orcid:string,affiliation:string>>,doi:string,publication_date:string,journal:string,keywords:array<string>>,
structure struct<figures_count:int,figure_captions:array<string>,tables_count:int,equations_count:int,references_count:int,sections:array<string>>,
funders array<string>, tei_year int
"""
_T, _ID = "{http://www.tei-c.org/ns/1.0}", "{http://www.w3.org/XML/1998/namespace}id"
#: An abstract must be longer than this to count; most captions and addresses that a structure lists.
ABSTRACT_GUARD, MOST_CAPTIONS, MOST_URLS = 100, 10, 20


def read(xml: bytes, as_of: int = 2025) -> dict:
    """One document's record, with the names of SCHEMA; a broken document has parse_error alone."""
    import re
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        return {"parse_error": str(e)}

    def at(node, path: str):
        """Nodes of a path of names; // reaches any depth, [k=v] asks for an attribute."""
        return node.findall(re.sub(r"(^|/)(?=[A-Za-z])", r"\1" + _T, path))

    def flat(node) -> str:
        return " ".join(node.itertext()).strip()

    def first(node, path: str, own: bool = False) -> str | None:
        """The first node's whole text, or with own its text before any child; None if empty."""
        found = at(node, path)
        return ((found[0].text or "").strip() if own else flat(found[0])) or None if found else None

    def walked(node) -> str:
        """Each element's text and then its tail, in the order in which elements open; the node's own tail too."""
        return " ".join(x for e in node.iter() for x in (e.text, e.tail) if x).strip()

    def once(nodes) -> list[str]:
        return sorted({t for t in map(flat, nodes) if t})

    def sections(divs, own: bool) -> list[dict]:
        """Titles and the paragraphs directly below; own: titles are what stands before any child of a head."""
        each = [{"title": first(d, "head", own), "text": "\n\n".join(t for t in map(flat, at(d, "p")) if t) or None} for d in divs]
        return [s for s in each if any(s.values())]

    def names(author) -> str | None:
        return " ".join(x.text.strip() for p in at(author, ".//persName") for x in p if x.text and x.text.strip()) or None

    def orcid(node) -> str | None:
        return first(node, ".//idno[@type='ORCID']", True)

    def year(text: str | None, pattern: str) -> int | None:
        m = re.match(pattern, text or "") if pattern[0] != "." else re.search(pattern[1:], text or "")
        return int(m[1]) if m else None

    def repaired_year() -> int | None:
        for path in (".//biblStruct//monogr/imprint/date[@when]", ".//publicationStmt/date[@when]"):
            found = at(root, path)
            if found and (y := year(found[0].get("when"), r"(\d{4})")):
                return y
        dates = at(root, ".//date")
        each = [year(d.get("when"), r"(\d{4})") for d in dates] + [year(d.text, r".\b(19\d{2}|20\d{2})\b") for d in dates]
        return next((y for y in each if y and 1900 <= y <= as_of + 1), None)

    direct_authors = []
    for a in at(root, ".//fileDesc//author"):
        fore, sur = (at(a, f".//{x}") for x in ("forename", "surname"))
        who = {"name": f"{fore[0].text} {sur[0].text}" if fore and sur else None, "email": first(a, ".//email", True), "orcid": orcid(a)}
        if any(who.values()):
            direct_authors.append(who)
    abstract = at(root, ".//abstract")
    guarded = walked(abstract[0]) if abstract else ""
    if len(guarded) <= ABSTRACT_GUARD:
        guarded = next((walked(d) for d in at(root, ".//div") if "abstract" in (first(d, "head", True) or "").lower()), "")
    known = [
        {
            "name": names(a), "email": first(a, ".//email", True), "orcid": orcid(a),
            "affiliation": next((first(x, ".//orgName", True) for x in at(a, ".//affiliation")[:1]), None)
        }
        for a in at(root, ".//fileDesc//author")
    ]
    figures = at(root, ".//figure")
    dated = at(root, ".//publicationStmt/date")
    return {
        "full_text": " ".join(root.itertext()),
        "legacy_text": walked(root),
        "direct": {
            "title": first(root, ".//titleStmt/title", True), "abstract": first(root, ".//abstract"), "authors": direct_authors,
            "ids": {x.get("type").lower(): x.text for x in at(root, ".//sourceDesc//idno") if x.get("type") and x.text},
            "num_references": len(at(root, ".//text//ref[@type='bibr']")), "sections": sections(at(root, ".//text//div"), True),
        },
        "persons": once(at(root, ".//persName")), "organizations": once(at(root, ".//orgName")),
        "locations": once([*at(root, ".//placeName"), *at(root, ".//country")]), "equations": [t for t in map(flat, at(root, ".//formula")) if t],
        "emails": sorted({x.text.strip() for x in at(root, ".//email") if x.text and x.text.strip()}),
        "orcids": sorted({x.text.strip() for x in at(root, ".//idno[@type='ORCID']") if x.text and x.text.strip()}),
        "acknowledgement": first(root, ".//div[@type='acknowledgement']"),
        "body_sections": [s for b in at(root, ".//body")[:1] for s in sections(at(b, ".//div"), False)],
        "coordinates": {x.get(_ID): x.get("coords") for x in root.iter() if x.get("coords") and x.get(_ID)},
        "citations": [
            {
                "title": first(b, ".//title"), "authors": [t for t in map(flat, at(b, ".//author")) if t], "year": first(b, ".//date"),
                "doi": first(b, ".//idno[@type='DOI']"), "journal": first(b, ".//monogr/title"), "raw_text": flat(b) or None,
            }
            for b in at(root, ".//listBibl//biblStruct")
        ],
        "figures": [{"label": first(f, ".//label"), "caption": first(f, ".//figDesc"), "id": f.get(_ID)} for f in figures if f.get("type") == "figure"],
        "tables": [
            {"label": first(f, ".//label"), "caption": first(f, ".//figDesc"), "content": first(f, ".//table"), "id": f.get(_ID)} for f in figures
            if f.get("type") == "table"
        ],
        "guarded_abstract": guarded,
        "summary": {
            "authors": [n for n in map(names, at(root, ".//author")) if n], "doi": first(root, ".//idno[@type='DOI']", True),
            "references_count": len(at(root, ".//ref[@type='bibr']"))
        },
        "metadata": {
            "title": first(root, ".//titleStmt/title", True), "authors": [a for a in known if any(a.values())],
            "doi": first(root, ".//idno[@type='DOI']", True),
            "publication_date": (dated[0].get("when") or "") if dated else None, "journal": first(root, ".//monogr/title[@level='j']", True),
            "keywords": [x.text.strip() for x in at(root, ".//keywords/term") if x.text and x.text.strip()],
        },
        "structure": {
            "figures_count": len(figures), "figure_captions": [t for t in (first(f, ".//figDesc", True) for f in figures) if t][:MOST_CAPTIONS],
            "tables_count": len(at(root, ".//table")),
            "equations_count": len(at(root, ".//formula")), "references_count": len(at(root, ".//listBibl/biblStruct")),
            "sections": [t for t in (first(d, "head", True) for d in at(root, ".//body/div")) if t],
        },
        "funders": [t for t in (first(f, ".//orgName", True) for f in at(root, ".//funder")) if t],
        "tei_year": repaired_year(),
    }


def read_variants(docs: DataFrame, as_of: int = 2025) -> DataFrame:
    """docs: (paper_id, xml string or binary) -> SCHEMA. A broken document is a row with parse_error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = x.encode() if isinstance(x, str) else x or b""
                rows.append(dict.fromkeys(schema.names) | read(x, as_of) | {"paper_id": i})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select("paper_id", "xml").mapInArrow(run, SCHEMA)


#: Groups of a document's entities that are lists, as columns of `entity_groups`.
GROUPS = (
    "persons", "organizations", "locations", "citations", "figures", "tables", "equations", "software", "datasets", "funding", "clinical_trials",
    "urls", "emails", "orcids"
)


def entity_groups(read_: DataFrame) -> DataFrame:
    """paper_id, the list groups, the statistics, and total_entities: the lengths of the lists, and 1 for the statistics."""
    said = dict(zip((name for name, *_ in E.MENTIONS), E.mentions(F.col("full_text")), strict=True))
    funding = dict(zip((name for name, *_ in E.MENTIONS), E.mentions(F.coalesce("acknowledgement", F.lit(""))), strict=True))["funding"]
    ends = F.regexp_extract_all("full_text", F.lit(E.INTERVAL_ENDS), F.lit(0))
    statistics = F.struct(said["p_values"].alias("p_values"), ends.alias("confidence_intervals"), said["sample_sizes"].alias("sample_sizes"))
    rows = read_.where("parse_error IS NULL").withColumns(
        {
            "software": said["software"], "datasets": said["datasets"], "funding": funding, "clinical_trials": said["trials"], "urls": said["urls"],
            "statistics": statistics
        }
    )
    return rows.withColumn("total_entities", sum((F.size(g) for g in GROUPS), F.lit(1))).select("paper_id", *GROUPS, "statistics", "total_entities")


def structure_urls(full_text: Column) -> Column:
    """The first addresses of a document's text in sorted order, each once."""
    return F.slice(F.array_sort(F.array_distinct(E.found(full_text, E.URL_MENTION, 1, False))), 1, MOST_URLS)


def projections(parsed: DataFrame, read_: DataFrame) -> dict[str, DataFrame]:
    """The outputs of one reading, each a table of its own: complete, entities, metadata, sections, coordinates, structure, statistics."""
    good = read_.where("parse_error IS NULL")
    groups = entity_groups(read_)
    return {
        "complete": parsed, "entities": groups.drop("statistics", "total_entities"), "metadata": good.select("paper_id", "metadata.*"),
        "sections": good.select("paper_id", F.posexplode("body_sections").alias("pos", "s")).select("paper_id", "pos", "s.*"),
        "coordinates": good.select("paper_id", F.explode("coordinates").alias("id", "coords")),
        "structure": good.select("paper_id", "structure.*", structure_urls(F.col("full_text")).alias("urls")),
        "statistics": groups.select("paper_id", "statistics.*", "total_entities"),
    }
