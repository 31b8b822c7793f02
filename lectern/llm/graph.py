"""Grouped pair search without all-pairs output, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written


def split_hot(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """Adds a, b and own: in a group (key, a, b), every row with own = a meets every row with own = b.

    A key of more than `bound` rows is dealt into chunks, and each pair of chunks is a group of its own, so no group
    holds more than about 2 * bound rows and no pair is lost. Other keys make one group, with a = b = own = 0.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > bound)
    hot = hot.select(key, F.ceil(F.col("_n") / bound).cast("int").alias("_c"))
    kept = [c for c in rows.columns]
    spread = rows.join(hot, key, "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
    spread = spread.withColumn("own", F.pmod(F.xxhash64(*[c for c in kept if c != key]), F.col("_c").cast("long")).cast("int"))
    spread = spread.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return spread.select(*kept, "own", F.least("own", "_o").alias("a"), F.greatest("own", "_o").alias("b"))


def in_groups(rows: DataFrame, key: str, search: Callable[[dict[str, np.ndarray], np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Calls search(columns, starts) on runs of whole groups (key, a, b), each of them in one task and together.

    starts holds where each group begins, and the number of rows at its end. Groups that end in a batch are handed over
    at once; only the last, unfinished one waits for the next batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            ids = [table[c].to_numpy() for c in (key, "a", "b")]
            new = np.ones(len(ids[0]), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ids])
            starts = np.flatnonzero(new)
            end = len(new) if last else starts[-1]
            if not end:
                return None, table
            part = table.slice(0, end)
            columns = {c: column(part[c]) for c in part.column_names}
            return search(columns, np.append(starts[starts < end], end)), table.slice(end)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
            if rest.num_rows < 20_000:
                continue
            out, rest = done(rest.combine_chunks(), False)
            if out is not None:
                yield out
        if rest is not None and rest.num_rows:
            yield done(rest.combine_chunks(), True)[0]

    dealt = rows.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b")
    return dealt.mapInArrow(run, schema)


def column(x: pa.ChunkedArray) -> np.ndarray:
    """A numpy column; fixed-length lists become a matrix."""
    x = x.combine_chunks()
    if isinstance(x, pa.ChunkedArray):
        x = x.chunk(0) if x.num_chunks else pa.array([], x.type)
    if pa.types.is_list(x.type):
        return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    return x.to_numpy(zero_copy_only=False)


#: Edges beyond which a node's are dealt over several places, at least, and most nodes that this may be.
HUB_EDGES, MOST_HUBS = 200_000, 100_000


def _with_least(rows: DataFrame, key: str, least: DataFrame, hub: int | None) -> DataFrame:
    """rows (u, v) joined by key with least (x, m, n), of which n counts the rows that an x has there.

    Rows of an x with more than `hub` of them are dealt over n / hub places, each with a copy of its m. Such nodes are at
    most rows / hub, so their list may be broadcast.
    """
    if hub is None:
        return rows.join(least, F.col(key) == F.col("x"))
    places = F.ceil(F.col("n") / hub).cast("int")
    hubs = F.broadcast(least.where(F.col("n") > hub).select(F.col("x").alias("_x"), places.alias("_p")))
    other = "v" if key == "u" else "u"
    dealt = rows.join(hubs, F.col(key) == F.col("_x"), "left")
    dealt = dealt.withColumn("_at", F.pmod(F.xxhash64(other), F.coalesce("_p", F.lit(1)).cast("long")).cast("int"))
    copied = least.withColumn("_to", F.explode(F.sequence(F.lit(0), places - 1)))
    return dealt.join(copied, (F.col(key) == F.col("x")) & (F.col("_at") == F.col("_to")))


def components(edges: DataFrame, most_rounds: int = 60, hub: int | None = None) -> DataFrame:
    """(node, label) for every node of the edges (u, v): label is the smallest node reachable.

    Large-star and small-star rounds over written tables: each round is a min per node, which combines before its shuffle,
    and a join back, in which hubs are dealt over several places (`hub` edges each; by default HUB_EDGES, or more where
    that would make more than MOST_HUBS hubs). Nothing is gathered in one place. Labels that still change after
    most_rounds raise an error.
    """
    now = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not mark[0] or mark == seen:
            break
        seen = mark
        size = hub or max(HUB_EDGES, 2 * mark[0] // MOST_HUBS)
        size = size if mark[0] > size else None  # no node can have so many
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), "u", least, size).select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # Small-star: every node's lower neighbours, and itself, hang from the lowest of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).select(F.col("v").alias("x"), "m", "n")
        hung = _with_least(large, "v", low, size)
        small = hung.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        now = written(small, "edges")
    else:
        raise RuntimeError(f"components did not converge in {most_rounds} rounds")
    stars = now.groupBy("v").agg(F.min("u").alias("label")).select(F.col("v").alias("node"), "label")
    return stars.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct().join(stars.select("node"), "node", "left_anti"))
