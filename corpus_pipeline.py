"""The corpus pipeline: quality, near-duplicates, decontamination, mix, token files.

Each stage works on all rows that its predecessor kept, and all but the last hand on the columns of documents. Defined
results, stage by stage: null and empty texts are scored like others and stay if they are accepted; they are
near-duplicates of each other, so one of them stays; they hold no benchmark passage; they have size 0 and are not mixed
in, so none reaches the token files. Very long texts are worked on
whole. Rows that repeat doc_id and text are one document behind the second stage; rows that repeat a doc_id with other
texts, and rows without an id, are documents of their own. Ties (equal components, equal sizes) go by the smallest
doc_id, null last, or by a seeded hash. An empty table passes every stage as an empty one. Extra columns of documents are
handed on up to the last stage, whatever their names, but for names that begin with _lectern_.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontam, mixing, quality, simhash, token_output
from lectern.llm.common import shared_dir
from lectern.llm.queries import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; its prior and calibration are those of these documents."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document of the mix, read back from the token files that were written of it."""
    return token_output.token_output(docs, tokenizer_path())


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mix", mix), ("tokens", tokens)]

#: A trained classifier, SimHash, a knapsack and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
