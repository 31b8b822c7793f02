"""Paper-like views over the driver's documents, by integer arithmetic on doc_id that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the made-up fields.
HEADERS = (
    "Introduction", "METHODS", "Results", "Data availability", "Discussion", "analysis results", "3.2 Results", "Conclusion", "2. Methods",
    "Future work", "Misc", "III. RESULTS"
)
_D = "CAST(doc_id AS STRING)"
FIELDS = {
    "doc_id": "doc_id",
    "paper_id": f"lpad({_D}, 8, '0')",
    "title": "CASE WHEN doc_id % 13 = 0 THEN '' ELSE CASE doc_id % 11 WHEN 1 THEN 'Editorial: ' WHEN 2 THEN 'Dataset: ' WHEN 3 THEN 'Correction to: ' WHEN "
    "4 THEN 'Data from: ' ELSE '' END || substr(split_part(text, chr(10), 1), 1, 60) END",
    "doi": f"""CASE doc_id % 8 WHEN 0 THEN 'https://doi.org/10.1234/Ab.' || {_D} WHEN 1 THEN ' 10.1234/ab' || {_D} || '.' WHEN 2 THEN '10.13039/f' ||
    {_D} WHEN 3 THEN '' WHEN 4 THEN '10.5555/UP' || CAST(doc_id % 50 AS STRING) || 'REVIEWS'
        WHEN 5 THEN '10.1000/x' || {_D} || '/-/DCSupplemental' WHEN 6 THEN '10.6084/m9.figshare.' || {_D} || ').' ELSE '10.1016/j.' || CAST(doc_id %
    40 AS STRING) || '.pdf' END""",
    "abstract": "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN substr(text, 1, 30) ELSE text END",
    "year": "CASE WHEN doc_id % 9 = 0 THEN 'Unknown' WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN '1780' ELSE CAST(1990 + doc_id % 36 AS "
    "STRING) END",
    "date": "CASE doc_id % 4 WHEN 0 THEN CAST(1990 + doc_id % 36 AS STRING) || '-05-01' WHEN 1 THEN 'May ' || CAST(1985 + doc_id % 50 AS STRING) WHEN 2 "
    "THEN 'None' ELSE '1234, in 1999' END",
    "venue": "CASE doc_id % 5 WHEN 0 THEN 'Nature Medicine' WHEN 1 THEN 'IEEE Access' WHEN 2 THEN 'unknown' WHEN 3 THEN '' ELSE 'Journal of Things' END",
    "num_references": "doc_id % 6",
    "citations": "doc_id % 400",
    "arxiv": f"CASE doc_id % 5 WHEN 0 THEN 'arXiv:' || lpad({_D}, 4, '1') || '.' || lpad({_D}, 5, '2') || 'v2' WHEN 1 THEN 'math-ph/0301' || "
    f"lpad(CAST(doc_id % 1000 AS STRING), 3, '0') WHEN 2 THEN 'bad id' ELSE '' END",
    "author": f"CASE doc_id % 3 WHEN 0 THEN 'Miller, Ann ' || CAST(doc_id % 40 AS STRING) WHEN 1 THEN 'Jo van Dyk' || CAST(doc_id % 40 AS STRING) ELSE "
    f"'Plato' END",
    "chars": "CASE WHEN doc_id % 19 = 0 THEN 0 ELSE length(text) END",
    "n_sections": "CASE WHEN doc_id % 19 = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) END",
    "body": """text || ' We enrolled ' || CAST(doc_id % 500 AS STRING) || ' patients (n = ' || CAST(doc_id % 1200 AS STRING) || ', p < 0.0' ||
    CAST(doc_id % 9 + 1 AS STRING) || '; 95% CI) with OR = 1.' || CAST(doc_id % 7 AS STRING) || ' and HR: 0.' || CAST(doc_id % 5 AS STRING) || '. '
        || CASE doc_id % 6 WHEN 0 THEN
    'SPSS version 26.0 and R 4.1 on MIMIC-III in diabetes; Data availability: available on GitHub github.com/a-b/c1.' WHEN 1 THEN
    'A randomized controlled trial NCT01234567 of metformin and Imatinib, a 2 year follow-up from May 2019 to June 2021. Ethics approval; CONSORT.'
        WHEN 2 THEN 'A cohort study in Python 3.9, 12 months follow-up; data sharing on request, zenodo.' WHEN 3 THEN
    'Systematic review of hypertension and Stroke; PRISMA; conflict of interest none; appendix.' WHEN 4 THEN
    'Stata v 16 with 2010-123456-12 and lopinavir; case-control.' ELSE 'Nothing else, Excel.' END""",
}


#: Bytes up to which a table is dealt over all cores before costly work on each row.
SMALL = 1 << 30


def spread(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """rows dealt over all cores if the table is small: it may be one file of one row group, which is one task's work."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= most else rows


def papers(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = spread(docs) if dealt else docs
    return docs.selectExpr(*(f"{e} AS {k}" for k, e in FIELDS.items()))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference source: every second paper, its DOI spelled otherwise, some DOIs twice."""
    p = papers(spark, sf_dir).where("doc_id % 2 = 0")
    return p.selectExpr(
        "doc_id AS item_id", "CASE WHEN doc_id % 6 = 0 THEN '' ELSE upper(doi) END AS doi",
        "translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS title", "CAST(2000 + doc_id % 20 AS STRING) AS year",
        "'Journal ' || CAST(doc_id % 7 AS STRING) AS venue", "author", "substr(abstract, 1, 100) AS abstract"
    )


ITEMS_SQL = (
    "items AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE upper(doi) END AS doi, translate(title, "
    "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS title, CAST(2000 + doc_id % 20 AS STRING) AS year, 'Journal ' || CAST(doc_id % "
    "7 AS STRING) AS venue, author, substr(abstract, 1, 100) AS abstract FROM papers WHERE doc_id % 2 = 0)"
)
PAPERS_SQL = "papers AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in FIELDS.items()) + " FROM documents)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, pos, header, content): the lines of a text behind its first, with headers dealt out."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content")).where("pos > 0")
    head = F.element_at(F.array(*map(F.lit, HEADERS)), ((F.col("doc_id") + F.col("pos")) % len(HEADERS) + 1).cast("int"))
    stat = (
        F.when((F.col("doc_id") + F.col("pos")) % 5 == 0, F.concat(F.lit("We conducted this study. n = 12 and p < 0.05. "), "content")).otherwise(F.col("content"))
    )
    return rows.select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("paper_id"), "pos", head.alias("header"), stat.alias("content"))


SECTIONS_SQL = f"""raw_sections AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS
    pos FROM documents),
sections AS (SELECT lpad(CAST(doc_id AS STRING), 8, '0') AS paper_id, pos, ({list(HEADERS)!r})[CAST((doc_id + pos) % {len(HEADERS)} + 1 AS INT)] AS
    header,
CASE WHEN (doc_id + pos) % 5 = 0 THEN 'We conducted this study. n = 12 and p < 0.05. ' || content ELSE content END AS content FROM raw_sections WHERE
    pos > 0)"""
