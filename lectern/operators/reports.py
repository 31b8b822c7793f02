"""Coverage, diagnostics and top-k reports: one aggregation each, which combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coverage(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(field, present, percent): all fields in one pass, then a small unpivot."""
    one = rows.agg(F.count("*").alias("n"), *(F.count_if(t).alias(k) for k, t in tests.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("present")) for k in tests))).alias("x")
    return one.select("n", each).select("x.field", "x.present", F.round(F.try_divide(100.0 * F.col("x.present"), F.col("n")), 6).alias("percent"))


def missing(tests: dict[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(~t, F.lit(k)) for k, t in tests.items()))))


def top_k(rows: DataFrame, value: str, k: int, name: str = "n") -> DataFrame:
    """The k most common values; of equally common ones the first by value."""
    return rows.groupBy(value).agg(F.count("*").alias(name)).orderBy(F.desc(name), value).limit(k)


def stage_change(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    before = F.lag(value).over(W.partitionBy(*by).orderBy(order))
    return rows.withColumn("before", before).withColumn("change", F.col(value) - F.col("before"))


def loss(before: Column, after: Column) -> tuple[Column, Column]:
    """(percent lost, ok, warning over 5 or severe over 25)."""
    lost = F.round(F.try_divide(100.0 * (before - after), before), 6)
    return lost, F.when(lost > 25, "severe").when(lost > 5, "warning").otherwise("ok")


def retention(final: Column, first: Column) -> Column:
    return F.round(100.0 * final / F.greatest(first, F.lit(1)), 6)
