"""Incremental runs: what is new or changed, and landing folders as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.sources.shared import own_folder


def pending(rows: DataFrame, processed: DataFrame, stage: str, version: int) -> DataFrame:
    """Rows whose (paper_id, stage, version) is not in the processed table."""
    done = processed.where((F.col("stage") == stage) & (F.col("version") >= version)).select("paper_id").distinct()
    return rows.join(done, "paper_id", "left_anti")


def changed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows without an equal (paper_id, hash) among the known ones."""
    return rows.join(known.select("paper_id", "hash"), ["paper_id", "hash"], "left_anti")


def ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Appends the landing folder's new JSON records to a Parquet table, each once, then stops."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.json").json(landing)
    return (
        rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start()
    )


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type; late rows are dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def finished_windows(events: DataFrame, path: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of the windows that the watermark has closed, by a stream over a Parquet path.

    The stream reads what is there, appends closed windows to a table of its own and stops. Both that table and the
    stream's state lie in the folder of spark.checkpoint.dir, or in a temporary one where Spark runs locally without it.
    """
    spark = events.sparkSession
    root = own_folder(spark, "stream")
    # As a pattern, for a stream takes any other path to be a folder.
    rows = spark.readStream.schema(events.schema).parquet(f"{path[:-1]}[{path[-1]}]")
    closed = (
        windowed(rows.withColumn("ts", F.col("ts").cast("timestamp")), size, late).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
    )
    query = (
        closed.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append")
            .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{root}/out")
