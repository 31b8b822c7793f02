"""TEI documents: an Arrow parser, since mixed content has an order that Spark's XPath functions lose."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "paper_id string, title string, abstract string, year int, date string, journal string, doi string, arxiv string, pmid string, keywords array<string>, "
    "authors array<struct<name:string,forename:string,surname:string,affiliation:string,email:string,orcid:string>>, sections "
    "array<struct<title:string,text:string>>, "
    "references array<struct<title:string,authors:array<string>,year:int,doi:string>>, num_references int, n_figures int, n_tables int, n_formulas "
    "int, parse_error string"
)
_T = "{http://www.tei-c.org/ns/1.0}"


def parse(xml: bytes, as_of: int = 2025, nested: bool = True) -> dict:
    """One document's record. nested: a section's text also holds that of the sections in it."""
    import re
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        return {"parse_error": str(e)}

    def all_(node, *names):
        nodes = [node]
        for n in names:
            deep, n = n.startswith("*"), n.lstrip("*")
            nodes = [x for y in nodes for x in (y.iter(_T + n) if deep else y.findall(_T + n)) if x is not y]
        return nodes

    def text(node) -> str:
        return " ".join(node.itertext()).strip()

    def own(nodes) -> str | None:
        return next((x.text.strip() for x in nodes if x.text and x.text.strip()), None)

    def year(s: str | None) -> int | None:
        for m in (re.match(r"\d{4}", s or ""), re.search(r"\b(?:19\d{2}|20\d{2})\b", s or "")):
            if m and 1900 <= int(m[0]) <= as_of + 1:
                return int(m[0])
        return None

    def idno(node, kind: str) -> str | None:
        return next((x.text.strip() for x in node.iter(_T + "idno") if x.get("type") == kind and x.text and x.text.strip()), None)

    def people(node):
        for a in node:
            fore, sur = " ".join(x.text.strip() for x in a.iter(_T + "forename") if x.text), own(a.iter(_T + "surname"))
            where = [text(x) for x in a.iter(_T + "affiliation")]
            p = {
                "name": (f"{fore} {sur}".strip() if sur else None), "forename": fore or None, "surname": sur,
                "affiliation": where[0] if where else None, "email": own(a.iter(_T + "email")), "orcid": idno(a, "ORCID")
            }
            if any(p.values()):
                yield p

    head = all_(root, "teiHeader", "fileDesc")
    out = {"title": own(all_(root, "*titleStmt", "title")) or own(all_(root, "*analytic", "title"))}
    out["abstract"] = next((t for t in map(text, root.iter(_T + "abstract")) if t), None)
    places = (all_(root, "*imprint", "date"), all_(root, "*publicationStmt", "date"), all_(root, "*monogr", "*date"), list(root.iter(_T + "date")))
    dates = [x.get("when") for p in places for x in p[:1] if x.get("when")] + [x.text.strip() for p in places for x in p[:1] if x.text and x.text.strip()]
    out["date"], out["year"] = next(((d, y) for d in dates if (y := year(d))), (None, None))
    titles = [x for x in all_(root, "*monogr", "title") if x.get("level") == "j"]
    out["journal"] = own(titles) or own(all_(root, "*monogr", "title")) or own([x for x in root.iter(_T + "title") if x.get("level") == "j"])
    out |= {k.lower(): idno(root, k) for k in ("DOI", "arXiv", "PMID")}
    out["keywords"] = [t for t in (x.text.strip() for x in all_(root, "*keywords", "term") if x.text) if t]
    out["authors"] = [p for h in head[:1] for p in people(all_(h, "*sourceDesc", "*analytic", "author"))]
    sections = []
    for body in root.iter(_T + "body"):
        for div in body.iter(_T + "div"):
            p = div.iter(_T + "p") if nested else div.findall(_T + "p")
            s = {"title": own(div.findall(_T + "head")), "text": "\n\n".join(t for t in map(text, p) if t) or None}
            if any(s.values()):
                sections.append(s)
    out["sections"] = sections
    refs = []
    for b in all_(root, "*listBibl", "biblStruct"):
        when = next((x.get("when") for x in b.iter(_T + "date") if x.get("when")), None)
        r = {
            "title": own(b.iter(_T + "title")), "authors": [x["name"] for x in people(list(b.iter(_T + "author"))) if x["name"]], "year": year(when),
            "doi": idno(b, "DOI")
        }
        if any(r.values()):
            refs.append(r)
    out["references"], out["num_references"] = refs, len(refs)
    return out | {k: sum(1 for _ in root.iter(_T + t)) for k, t in (("n_figures", "figure"), ("n_tables", "table"), ("n_formulas", "formula"))}


def parse_tei(docs: DataFrame, as_of: int = 2025, nested: bool = True) -> DataFrame:
    """docs: (paper_id, xml string or binary). A broken document is a row with parse_error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = x.encode() if isinstance(x, str) else x or b""
                rows.append(dict.fromkeys(schema.names) | parse(x, as_of, nested) | {"paper_id": i})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select("paper_id", "xml").mapInArrow(run, SCHEMA)


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, xml) of the *.xml files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("paper_id"), F.col("content").alias("xml"))
