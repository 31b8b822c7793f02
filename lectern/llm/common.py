"""What the corpus operators share: the shared folder, materialised tables, text columns, the learning split."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of our own only where that is unset and Spark runs locally."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _own:
        _own["root"] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return _own["root"]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table has; a null text is empty."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def in_split(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod `mod` is `rest`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def learnable(labels: DataFrame, label: str, mod: int, rest: int) -> DataFrame:
    """(doc_id, y) of the documents whose label may be learned from; of several labels the largest counts."""
    key = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_split(F.col("doc_id"), mod, rest))
    return key.groupBy("doc_id").agg(F.max(label).alias("y"))


def first_ids(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """The first `most` rows by a seeded hash of doc_id."""
    return ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("doc_id")).limit(most)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the few documents in ids (doc_id, y), which the caller bounds and which is broadcast.

    Rows that repeat a doc_id give one text, the smallest; they combine before the shuffle.
    """
    found = texts(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return found.select("doc_id", "text", "y")


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, most: int, seed: int = 17) -> DataFrame:
    """(doc_id, text, y) of up to `most` documents of each class that may be learned from, by a seeded hash of doc_id."""
    key = learnable(labels, label, mod, rest)
    return texts_of(docs, first_ids(key.where("y = 1"), most, seed).unionByName(first_ids(key.where("y = 0"), most, seed)))


def shares(labels: DataFrame, label: str, mod: int, rest: int) -> tuple[int, int]:
    """How many documents that may be learned from have label 1, and label 0."""
    n = {r[0]: r[1] for r in learnable(labels, label, mod, rest).groupBy("y").count().collect()}
    return n.get(1, 0), n.get(0, 0)


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, without a copy: what Python makes of a slice stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
