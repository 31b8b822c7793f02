"""Scans and sinks: paper records, side files, shards, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import shard

# Parts of names that mark side files.
SIDE_FILES = ("report", "summary", "log", "excluded", "checkpoint")


#: The three rules that leave side files out, as parts of names; a hidden file goes by the first.
SIDE_RULES = {"reports": ("report",), "checkpoints": ("checkpoint", "report"), "analysis": ("report", "summary", "log", "excluded")}
#: Item types of a reference manager that are papers, and the fields asked of a citation graph.
ITEM_TYPES = ("journalArticle", "conferencePaper", "preprint", "book", "bookSection", "thesis", "report")
GRAPH_FIELDS = (
    "id", "doi", "title", "publication_year", "topics", "sustainable_development_goals", "cited_by_count", "counts_by_year", "authorships",
    "primary_location", "type",
    "open_access", "keywords", "concepts", "mesh", "referenced_works_count", "related_works", "cited_by_percentile_year", "biblio", "is_retracted",
    "is_paratext",
)


def side_file(name: Column, rule: str) -> Column:
    """Whether a rule of SIDE_RULES leaves a file out."""
    out = F.exists(F.array(*map(F.lit, SIDE_RULES[rule])), lambda w: name.contains(w))
    return out | name.startswith(".") if rule == "reports" else out


def kept_items(items: DataFrame) -> DataFrame:
    """Items of a reference manager that are papers."""
    return items.where(F.col("item_type").isin(*ITEM_TYPES))


def pruned(works: DataFrame) -> DataFrame:
    """A citation graph's works with the fields that are read and no others."""
    return works.select(*(c for c in works.columns if c in GRAPH_FIELDS))


def identifiers(items: DataFrame) -> DataFrame:
    """(key, kind, item_id): an item's DOI, else its title; items with neither go."""
    doi, title = F.nullif(F.trim("doi"), F.lit("")), F.nullif(F.trim("title"), F.lit(""))
    rows = items.select(F.coalesce(doi, title).alias("key"), F.when(doi.isNotNull(), "doi").otherwise("title").alias("kind"), "item_id")
    return rows.where("key IS NOT NULL")


def paper_info(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper_id, title, title_length, abstract_length, n_sections, text_chars): what a report shows of a paper."""
    size = sections.groupBy("paper_id").agg(F.count("*").alias("n_sections"), F.sum(F.length("content")).alias("text_chars"))
    rows = papers.select(
        "paper_id", F.substring("title", 1, 100).alias("title"), F.length("title").alias("title_length"),
        F.coalesce(F.length("abstract"), F.lit(0)).alias("abstract_length")
    )
    return rows.join(size, "paper_id", "left").na.fill(0, ["n_sections", "text_chars"])


def json_paths(rows: DataFrame, column: str) -> DataFrame:
    """(key, kind, n): how often each key of a JSON object has a number, text, truth value, null, list or object."""
    each = rows.select(F.col(column).alias("_j"), F.explode(F.expr(f"json_object_keys({column})")).alias("key"))
    raw = F.from_json("_j", "map<string,string>")[F.col("key")]
    kind = (
        F.when(raw.isNull(), "null").when(raw.startswith("{"), "object").when(raw.startswith("["), "array").when(raw.isin("true", "false"), "boolean")
            .when(raw.try_cast("double").isNotNull(), "number").otherwise("string")
    )
    return each.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"))


def is_side_file(name: Column) -> Column:
    return F.exists(F.array(*map(F.lit, SIDE_FILES)), lambda w: name.contains(w)) | name.startswith(".")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file; paper_id is the file's stem, broken files keep their text in _corrupt."""
    rows = (
        spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(path)
    )
    name = F.col("_metadata.file_name")
    return rows.where(~is_side_file(name)).withColumn("paper_id", F.regexp_extract(name, r"^(.*)\.json$", 1))


def write_shards(rows: DataFrame, path: str, n: int = 2) -> None:
    """Parquet in folders by the first characters of paper_id."""
    rows.withColumn("shard", shard(F.col("paper_id"), n)).write.mode("overwrite").partitionBy("shard").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def citation(key: Column, title: Column, authors: Column, year: Column, journal: Column, doi: Column) -> tuple[Column, Column, Column]:
    """(BibTeX, RIS, Markdown) of a paper."""
    who = F.array_join(authors, " and ")
    field = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    bib = F.concat(
        F.lit("@article{"), key, F.lit(",\n"),
        F.concat_ws(",\n", field("title", title), field("author", who), field("year", year), field("journal", journal), field("doi", doi)),
        F.lit("\n}")
    )
    ris = F.concat_ws(
        "\n", F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), title), F.array_join(F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a)), "\n"),
        F.concat(F.lit("PY  - "), year), F.concat(F.lit("DO  - "), doi), F.lit("ER  - ")
    )
    md = F.concat_ws(". ", who, F.concat(F.lit("*"), title, F.lit("*")), journal, year)
    return bib, ris, md


def content_hash(rows: DataFrame, columns: list[str]) -> Column:
    """Changes whenever one of the columns does."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
