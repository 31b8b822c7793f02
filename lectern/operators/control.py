"""What steers a run: batches, routes, stages and their completion, commands over frames, reports as lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of routing: megabytes beyond which only the header is read, and the seconds that each way may take.
LARGE_MB, HEADER_SECONDS, FULL_SECONDS = 50, 300, 600
#: Parameter profiles of the extraction service.
PROFILES = {
    "maximum": {
        "consolidateHeader": "2", "consolidateCitations": "2", "consolidateFunders": "1", "includeRawCitations": "1", "includeRawAffiliations": "1",
        "includeRawAuthors": "1", "includeRawCopyrights": "1", "processFigures": "1", "processTables": "1", "processEquations": "1", "segmentSentences": "1",
        "teiCoordinates": "all", "generateIDs": "1", "addElementId": "1", "timeout": "300",
    },
    "balanced": {
        "consolidateHeader": "1", "consolidateCitations": "1", "consolidateFunders": "0", "includeRawCitations": "0", "includeRawAffiliations": "0",
        "processFigures": "0", "processTables": "0", "timeout": "60",
    },
    "minimal": {"consolidateHeader": "0", "consolidateCitations": "0", "timeout": "30"},
}
#: Papers behind each step of the surveyed run, from its published ledger.
LEDGER = (("input", 2221), ("extraction", 2210), ("quality", 2170), ("articles", 2151), ("titles", 2150))


def route(megabytes: Column) -> Column:
    """struct of endpoint and seconds: large files give their header only."""
    large = megabytes > LARGE_MB
    return F.struct(F.when(large, "header").otherwise("full").alias("endpoint"), F.when(large, HEADER_SECONDS).otherwise(FULL_SECONDS).alias("seconds"))


def profiles(spark: SparkSession) -> DataFrame:
    """(profile, parameter, value)."""
    return spark.createDataFrame([(p, k, v) for p, each in PROFILES.items() for k, v in each.items()], "profile string, parameter string, value string")


def ledger(spark: SparkSession) -> DataFrame:
    """(step, papers, excluded): papers left behind each step, and how many it took away."""
    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(LEDGER)], "i int, step string, papers long")
    return rows.select(
        "step", "papers",
        F.coalesce(F.lag("papers").over(W.partitionBy(F.lit(1)).orderBy("i")) - F.col("papers"), F.lit(0)).cast("long").alias("excluded")
    )


def numbered(rows: DataFrame, key: str, width: int = 65536) -> DataFrame:
    """rows with position: 0, 1, 2, ... by an integer key of distinct values.

    Rows are counted and ranked by stretches of `width` keys, so that no task sees more than one stretch of them; one small
    row a stretch is summed up in one place.
    """
    base = rows.withColumn("_s", F.floor(F.col(key) / width))
    before = F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("_s")) - F.col("_n")
    starts = base.groupBy("_s").agg(F.count("*").alias("_n")).select("_s", before.alias("_b"))
    rank = F.row_number().over(W.partitionBy("_s").orderBy(key)) - 1
    return base.withColumn("_r", rank).join(starts, "_s").withColumn("position", (F.col("_b") + F.col("_r")).cast("long")).drop("_s", "_r", "_b")


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with batch and place: runs of `size` rows by key."""
    if size < 1:
        raise ValueError("a batch has a row at least")
    out = numbered(rows, key)
    return out.select(*rows.columns, F.floor(F.col("position") / size).alias("batch"), F.pmod("position", F.lit(size)).cast("int").alias("place"))


def by_position(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests (batch, place, ...) with their answers (batch, answers array, aligned by place); a null answer is a miss."""
    each = answers.select("batch", F.posexplode("answers").alias("place", "answer"))
    return asked.join(each, ["batch", "place"], "left").withColumn("found", F.col("answer").isNotNull())


def is_complete(spark: SparkSession, path: str, least: int = 1) -> bool:
    """Whether a stage's folder was committed and holds at least `least` rows, by its files' footers alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        return False
    return spark.read.parquet(path).limit(least).count() >= least


def latest(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths, in their order of preference, that is a stage with rows."""
    return next((p for p in paths if is_complete(spark, p)), None)


def latest_stage(counts: DataFrame, order: list[str]) -> DataFrame:
    """counts: (stage, papers). One row: the first stage of the order that has papers, null if none has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    return counts.where((F.col("papers") > 0) & (rank > 0)).agg(F.min_by("stage", rank).alias("stage"))


def to_run(stages: list[str], done: set[str], start_from: str | None = None, stop_after: str | None = None, force: bool = False) -> list[str]:
    """The stages that a run has to do: from one to another of them, without those done unless forced."""
    for name in (start_from, stop_after):
        if name is not None and name not in stages:
            raise ValueError(f"no stage {name}")
    first = stages.index(start_from) if start_from else 0
    last = stages.index(stop_after) + 1 if stop_after else len(stages)
    return [s for s in stages[first:last] if force or s not in done]


Stage = Callable[[DataFrame], DataFrame]


def run_stages(spark: SparkSession, source: DataFrame, stages: list[tuple[str, Stage]], root: str, least: int = 1, **choice: object) -> list[tuple[str, int, int]]:
    """Runs stages over Parquet folders below root: (stage, rows in, rows out) of those run.

    A stage that is complete already is not run again unless force is set; what it left is the next one's input.
    """
    done = {name for name, _ in stages if is_complete(spark, f"{root}/{name}", least)}
    todo, out, now = to_run([n for n, _ in stages], done, **choice), [], source
    for name, stage in stages:
        path = f"{root}/{name}"
        if name in todo:
            before = now.count()
            stage(now).write.mode("overwrite").parquet(path)
            out.append((name, before, spark.read.parquet(path).count()))
        if name in todo or name in done:
            now = spark.read.parquet(path)
    return out


def run_commands(frames: dict[str, DataFrame], commands: list[str], key: str = "paper_id", score: str = "score") -> DataFrame:
    """What a file of commands leaves, one a line; # begins a comment.

    get NAME, merge NAME (rows that are new by key), filter CONDITION (SQL), top N (by score, then key).
    """
    now: DataFrame | None = None
    for line in commands:
        line = line.split("#")[0].strip()
        if not line:
            continue
        verb, _, rest = line.partition(" ")
        if verb == "get":
            now = frames[rest.strip()]
        elif now is None:
            raise ValueError(f"{verb} before get")
        elif verb == "merge":
            other = frames[rest.strip()]
            now = now.unionByName(other.join(now.select(key), key, "left_anti").select(*now.columns))
        elif verb == "filter":
            now = now.where(rest)
        elif verb == "top":
            now = now.orderBy(F.desc(score), key).limit(int(rest))
        else:
            raise ValueError(f"unknown command {verb}")
    if now is None:
        raise ValueError("no command")
    return now


def report(title: str, counts: DataFrame, label: str, n: str, examples: DataFrame | None = None) -> DataFrame:
    """(pos, line): a readable report of counted categories with their shares, and up to ten examples of each.

    examples: (label, rank, text). Small by its nature: one row a category and ten an example list.
    """
    total = F.sum(n).over(W.partitionBy(F.lit(1)))
    share = F.format_string("- **%s**: %d (%s%%)", F.col(label), F.col(n), F.round(100.0 * F.col(n) / total, 1).cast("string"))
    lines = counts.select(F.lit(1).alias("part"), F.col(label).alias("key"), F.lit(0).alias("i"), share.alias("line"))
    head = counts.agg(F.sum(n).alias("_n")).select(
        F.lit(0).alias("part"), F.lit("").alias("key"), F.lit(0).alias("i"),
        F.format_string(f"# {title} (%d papers)", F.coalesce("_n", F.lit(0))).alias("line")
    )
    out = head.unionByName(lines)
    if examples is not None:
        out = out.unionByName(
            examples.where(F.col("rank") <= 10).select(
                F.lit(2).alias("part"), F.col(label).alias("key"), F.col("rank").cast("int").alias("i"),
                F.concat(F.col(label), F.lit(": "), F.col("text")).alias("line")
            )
        )
    return out.select(F.row_number().over(W.partitionBy(F.lit(1)).orderBy("part", "key", "i")).alias("pos"), "line")


def write_report(lines: DataFrame, path: str) -> None:
    """The lines in their order as one text file."""
    lines.orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(path)


def export_archive(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as a Parquet folder of an archive."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def import_archive(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
