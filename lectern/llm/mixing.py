"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are words. Documents are counted by source and exact size, in `BUCKETS` seeded buckets each. Every source gets a
target; it is met by whole copies of the source and, for the remaining budget, by a bounded-knapsack dynamic programme
over the counts by size, in units of the sizes' common divisor. Where programme and budget are too large to hold
(`DP_BITS`, 128 MB), the same share of every size is taken first and the programme fits what that leaves; a source has
many thousand documents then, and the miss is less than its shortest spare one. The programme says how many documents
of each size to take; which ones is decided by the order of a seeded hash: bucket counts say how many come before a bucket, and
rows are ranked inside their bucket only, so a size that a third of all rows have is ranked in `BUCKETS` places.
A source's task sees one row per distinct size.

Defined results: null text has size 0; null is a source, the last in order; repeated rows are documents of their own,
told apart by their hash and otherwise interchangeable, so equal rows are ranked in any order. An empty table gives no
rows. Reruns agree. Documents of size 0, empty ones among them, are taken 0 words. Very long texts are counted whole, and
one that is larger than its source's remaining budget is left out. Ties of a seeded hash go by doc_id, null first. Other
columns are ignored by `mix_sources` and handed on by `mixed`; names that begin with _lectern_ are taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import written

BUCKETS, MOST_COPIES, SEED = 1024, 3, 29
#: Most bits that the dynamic programme may hold: its steps times its budget, in units of the sizes' common divisor.
DP_BITS = 1 << 30


def n_words(text: Column) -> Column:
    """Number of runs of anything but space and \\t\\n\\v\\f\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: pd.DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST_COPIES) -> pd.DataFrame:
    """source, source_size -> target, by sharing all sizes by weight and resharing what is above most * size."""
    s = (
        sizes.sort_values("source", key=lambda c: c.map(lambda x: (x is None or x != x, "" if x is None or x != x else x)), kind="stable").reset_index(drop=True)
    )
    w = np.array([weights[i % len(weights)] for i in range(len(s))], float)
    cap = most * s.source_size.to_numpy(float)
    left, out, free = float(s.source_size.sum()), np.zeros(len(s)), np.ones(len(s), bool)
    while free.any():
        share = left * w / w[free].sum()
        above = free & (share > cap)
        if not above.any():
            out[free] = share[free]
            break
        out[above] = cap[above]
        left -= cap[above].sum()
        free &= ~above
    return s.assign(target=out)


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length (at most its count) add up to the most that is not above the budget."""
    full = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        part = 1
        count = min(count, budget // length)
        while count > 0 and not reach >> budget & 1:
            part = min(part, count)
            steps.append((i, part, reach))
            reach |= reach << (length * part) & full
            count -= part
            part *= 2
        if reach >> budget & 1:
            break
    at, taken = reach.bit_length() - 1, [0] * len(lengths)
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            at -= lengths[i] * part
            taken[i] += part
    return taken


def quota(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(copies of every document, further documents of each length), whose words come nearest to the target from below,
    or within half a document of the shortest kind where that is nearer."""
    total = int((lengths * counts).sum())
    want = int(round(target))
    if not total:
        return 0, np.zeros(len(lengths), np.int64)
    copies = min(want // total, MOST_COPIES)
    rest = want - copies * total if copies < MOST_COPIES else 0
    unit = int(np.gcd.reduce(lengths[(lengths > 0) & (counts > 0)]))
    steps = lambda n: max(1, int(np.ceil(np.log2(n[lengths > 0] + 1)).sum()))
    take, left = np.zeros(len(lengths), np.int64), rest
    order = np.argsort(-lengths, kind="stable")
    if steps(counts) * (rest // unit + 1) > DP_BITS:
        # Too much for the programme: the same share of every size first, and of what that leaves the largest that fit.
        take = (counts * (rest / total)).astype(np.int64)
        left = rest - int((take * lengths).sum())
        most = DP_BITS // steps(counts - take) * unit
        for i in order:
            if left <= most:
                break
            more = min(int(counts[i] - take[i]), max(0, left - most // 2) // max(1, int(lengths[i])))
            take[i] += more
            left -= more * int(lengths[i])
    if left > 0:
        spare = [i for i in order if counts[i] > take[i] and 0 < lengths[i] <= left]
        got = knapsack([int(lengths[i]) // unit for i in spare], [int(counts[i] - take[i]) for i in spare], left // unit)
        take[spare] += np.array(got, np.int64)
    # One document more, if that is nearer than none.
    off = want - copies * total - int((take * lengths).sum())
    free = np.flatnonzero((counts > take) & (lengths > 0))
    if len(free) and copies < MOST_COPIES:
        i = free[np.argmin(lengths[free])]
        take[i] += abs(off - int(lengths[i])) < abs(off)
    return copies, take


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with what places a row in the mix: its source as a key, its size, a seeded hash and the hash's bucket."""
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    keyed = docs.withColumn("_lectern_size", n_words(F.col("text"))).withColumn("_lectern_source", key)
    keyed = keyed.withColumn("_lectern_h", F.xxhash64("doc_id", F.lit(seed)))
    return keyed.withColumn("_lectern_b", F.pmod("_lectern_h", F.lit(BUCKETS)).cast("int"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = SEED) -> DataFrame:
    """Per (_lectern_source, _lectern_size, _lectern_b): source_size, target, copies of each document, how many
    documents of this size get one more (take), and how many of them stand in earlier buckets (before)."""
    base = _keyed(docs.select("doc_id", "source", "text"), seed)
    keys = ["_lectern_source", "_lectern_size"]
    by_bucket = written(base.groupBy(*keys, "_lectern_b").agg(F.count("*").alias("n")), "mix-counts")
    by_size = by_bucket.groupBy(*keys).agg(F.sum("n").alias("n"))
    # One row a source goes to one task; a source's own task below gets one row a distinct size.
    sums = by_size.groupBy("_lectern_source").agg(F.sum(F.col("_lectern_size") * F.col("n")).cast("long").alias("source_size"))

    def goals(pdf: pd.DataFrame) -> pd.DataFrame:
        out = targets(pdf.assign(source=[None if k == "n" else k[1:] for k in pdf._lectern_source]), weights)
        return out[["_lectern_source", "source_size", "target"]]

    goal = sums.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(goals, "_lectern_source string, source_size long, target double")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_lectern_size").reset_index(drop=True)
        copies, take = quota(pdf._lectern_size.to_numpy(), pdf.n.to_numpy(), float(pdf.target.iloc[0]))
        return pdf[[*keys, "source_size", "target"]].assign(copies=copies, take=take)

    fitted = (
        by_size.join(goal, "_lectern_source").groupBy("_lectern_source")
            .applyInPandas(fit, "_lectern_source string, _lectern_size long, source_size long, target double, copies int, take long")
    )
    before = F.sum("n").over(W.partitionBy(*keys).orderBy("_lectern_b")) - F.col("n")
    return written(by_bucket.withColumn("before", before).join(fitted, keys).drop("n"), "mix-plan")


def _decided(docs: DataFrame, rows: DataFrame, weights: tuple[float, ...], seed: int) -> DataFrame:
    """rows (keyed rows of docs) with target, source_size and copies."""
    keys = ["_lectern_source", "_lectern_size", "_lectern_b"]
    plan = plan_mix(docs, weights, seed).select(*keys, *(F.col(c).alias(f"_lectern_{c}") for c in ("source_size", "target", "copies", "take", "before")))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_lectern_h", "doc_id"))
    more = (F.col("_lectern_before") + rank <= F.col("_lectern_take")).cast("int")
    return rows.join(plan, keys).withColumn("_lectern_copies", F.when(F.col("_lectern_size") > 0, F.col("_lectern_copies") + more).otherwise(0))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken."""
    rows = _decided(docs, _keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), weights, seed)
    size, copies = F.col("_lectern_size"), F.col("_lectern_copies")
    return rows.select(
        "doc_id", "source", size.alias("size"), F.col("_lectern_source_size").alias("source_size"), F.col("_lectern_target").alias("target"),
        copies.alias("copies"), (size * copies).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: each document as often as it is taken, with all its columns.

    Documents of size 0 are taken 0 times; rows that repeat are documents of their own; a null source is a source. An empty
    table, and one of empty texts, gives an empty one.
    """
    rows = _decided(docs, _keyed(docs, seed), weights, seed).where("_lectern_copies > 0")
    return rows.withColumn("_lectern_i", F.explode(F.sequence(F.lit(1), F.col("_lectern_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
