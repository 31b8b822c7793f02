"""Embedding near-duplicates by collision counting on sorted one-dimensional projections.

Every unit vector is projected on many random lines. In each of several tables the vectors are sorted by a cell (the
signs of some projections) and by one more projection, and a query-centred window along that projection gives its
candidate pairs. For a candidate pair the projections on which it collides (differs by no more than a window) are
counted; pairs that reach the calibrated count are verified by cosine in double precision.

The window follows from the threshold: the difference of two projections is normal with the standard deviation
sqrt(2 - 2 * threshold). The count and the number of tables are calibrated on the data: up to `SAMPLE` vectors, picked by
a seeded hash, each get a partner at exactly the threshold in a random direction, and these pairs say how often such
pairs collide and how often they meet in a table. The number of sign bits grows with the logarithm of the number of
vectors, so work grows little faster than the input. Cells are needed because a window alone holds a fixed share of all
vectors on any line: at 0.95 some 0.6 of them, which would be a quadratic number of pairs.

Counting needs no vectors: a row of the first search is a cell, a number, its place along the table's line and 24
projections of 8 bits. Vectors are joined to those rows only that have a partner with enough collisions, and the second
search repeats windows and counts exactly and verifies. What is shuffled per table is thus some 50 bytes a vector, and the
vectors only as often as they have candidates. 24 lines leave few of those by chance: a pair of unrelated vectors
collides on 0.44 of them, a pair at the threshold on 0.99.

A pair that meets in several tables counts in the first of them only, so links are summed without listing pairs, and
each cell hands on a spanning forest of its links for the components. Equal vectors are one class with a size.

Defined results: null vectors, zero vectors, and vectors with null or non-finite components link with nothing (n_links 0,
their own component); vectors of different lengths never link, and each length is searched by itself. Every row of the
table is returned; rows that repeat a vec_id are vectors of their own, and classes whose smallest id is the same share a component. A null vec_id
is returned as its own component null, kept. An empty table gives no rows. Ties do not arise: a component's name is its
smallest id. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small, written
from lectern.llm.graph import components, in_groups, split_hot

#: Most rows of a cell that are handled as one group, counted lines, and vectors to calibrate on.
CELL_BOUND, COUNTED, SAMPLE = 4096, 24, 1000
#: Steps of a window in which the counted projections travel.
STEPS = 16
#: What share of the pairs at the threshold must meet in a table, and what share of those must reach the count.
MEET, REACH = 0.995, 0.999


def plan(n: int, threshold: float, sample: np.ndarray, seed: int, meet: float = MEET, reach: float = REACH) -> tuple[dict, np.ndarray]:
    """(sign bits of a cell, tables, window and least count for n vectors, the lines), calibrated on unit vectors."""
    sd = math.sqrt(max(1e-9, 2 - 2 * threshold))
    p = {"bits": min(24, max(2, round(math.log2(max(n, 1) / 200)))) if n > 200 else 2, "window": 2.6 * sd, "tables": 1}
    dim, rng = sample.shape[1], np.random.default_rng(seed + 1)
    away = rng.standard_normal(sample.shape)
    away -= (away * sample).sum(1)[:, None] * sample
    size = np.linalg.norm(away, axis=1)
    # In one dimension there is no other direction: such a pair is equal.
    other = np.where((size > 1e-9)[:, None], threshold * sample + math.sqrt(1 - threshold**2) * away / np.maximum(size, 1e-9)[:, None], sample)
    trial = p | {"tables": 8}
    lines = projections(dim, 8 * (1 + p["bits"]), seed + 2)
    P, Q = sample @ lines, other @ lines
    met = (cells(P, trial) == cells(Q, trial)) & (np.abs(P[:, :8] - Q[:, :8]) <= p["window"])
    share = met.mean() - 3 * math.sqrt(max(met.mean() * (1 - met.mean()), 1e-4) / met.size)
    p["tables"] = max(1, math.ceil(math.log(1 - meet) / math.log(1 - min(0.999, max(0.02, share)))))
    lines = projections(dim, p["tables"] * (1 + p["bits"]) + COUNTED, seed)
    counts = (np.abs((sample - other) @ lines[:, -COUNTED:]) <= p["window"]).sum(1)
    p["count"] = max(c for c in range(COUNTED + 1) if (counts >= c).mean() >= reach)
    return p, lines


def projections(dim: int, lines: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, lines))


def _windows(along: np.ndarray, lo: int, hi: int, window: float, own: np.ndarray | None, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows lo..hi whose places along a line differ by no more than a window, about `most` at a time.

    With own, only pairs of different chunks, for the others meet in a group of their own.
    """
    at = lo + np.argsort(along[lo:hi], kind="stable")
    ends = np.searchsorted(along[at], along[at] + window, "right")
    n = np.maximum(ends - np.arange(len(at)) - 1, 0)
    begin = 0
    while begin < len(at):
        stop = min(len(at), max(begin + 1, int(np.searchsorted(np.cumsum(n[begin:]), most)) + begin))
        m = n[begin:stop]
        first = np.repeat(np.arange(begin, stop), m)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(m) - m, m)
        X, Y = at[first], at[second]
        if own is not None:
            meet = own[X] != own[Y]
            X, Y = X[meet], Y[meet]
        yield X, Y
        begin = stop


def _collisions(p: dict):
    """Marks the rows of a cell that have a partner within the window and with enough collisions.

    A row has its place along the table's line and its COUNTED projections in 8 bits each, in steps of a STEPS-th of the
    window: a collision is one of the exact projections or lies just beyond, so no partner is lost.
    """

    def search(c: dict[str, np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        q = np.concatenate([np.ascontiguousarray(c[x]).view(np.uint8).reshape(-1, 8) for x in ("q1", "q2", "q3")], 1).astype(np.int16)
        along, marked = c["along"].astype(np.float64), np.zeros(len(q), bool)
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            for X, Y in _windows(along, lo, hi, p["window"] + 1e-4, c["own"] if c["a"][lo] != c["b"][lo] else None):
                new = ~(marked[X] & marked[Y])
                X, Y = X[new], Y[new]
                hit = (np.abs(q[X] - q[Y]) <= STEPS + 1).sum(1) >= p["count"]
                marked[X[hit]] = marked[Y[hit]] = True
        return pa.record_batch([pa.array(c[x][marked]) for x in ("k", "cid")], ["k", "cid"])

    return search


def _search(p: dict, lines: np.ndarray, threshold: float):
    counted, sorting = lines[:, -COUNTED:], lines[:, : p["tables"] * (1 + p["bits"])]

    def links(V, along, C, X, Y, t):
        """Which of the pairs X, Y of table t are in the window, collide often enough, have the cosine, and met in no earlier table."""
        ok = np.abs(along[X] - along[Y]) <= p["window"]
        X, Y = X[ok], Y[ok]
        ok = (np.abs(C[X] - C[Y]) <= p["window"]).sum(1) >= p["count"]
        X, Y = X[ok], Y[ok]
        ok = np.einsum("ij,ij->i", V[X], V[Y]) >= threshold
        X, Y = X[ok], Y[ok]
        if t and len(X):
            rows, at = np.unique(np.concatenate([X, Y]), return_inverse=True)
            P = V[rows] @ sorting
            S, x, y = cells(P, p)[:, :t], at[: len(X)], at[len(X) :]
            new = ~((S[x] == S[y]) & (np.abs(P[x, :t] - P[y, :t]) <= p["window"])).any(1)
            X, Y = X[new], Y[new]
        return X, Y

    def search(c: dict[str, np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        V = c["v"].astype(np.float64)
        V /= np.linalg.norm(V, axis=1)[:, None]
        C = V @ counted
        cid, vid, size, own, along = c["cid"], c["vec_id"], c["n"], c["own"], np.empty(len(V))
        out = []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo < 2:
                continue
            t = int(c["k"][lo] >> 40)
            along[lo:hi] = V[lo:hi] @ lines[:, t]
            total = np.zeros(hi - lo, np.int64)
            up = np.arange(hi - lo)

            def root(i, up=up):
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            for X, Y in _windows(along, lo, hi, p["window"], own if c["a"][lo] != c["b"][lo] else None):
                X, Y = links(V, along, C, X, Y, t)
                np.add.at(total, X - lo, size[Y])
                np.add.at(total, Y - lo, size[X])
                for x, y in zip((X - lo).tolist(), (Y - lo).tolist(), strict=True):
                    x, y = root(x), root(y)
                    if x != y:
                        up[max(x, y)] = min(x, y)
            found = np.flatnonzero(total)
            out.append((cid[lo + found], total[found], vid[lo + found], vid[lo + np.array([root(i) for i in found], int)]))
        cat = lambda k: np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64)
        return pa.record_batch([pa.array(cat(k).astype(np.int64)) for k in range(4)], ["cid", "n", "u", "v"])

    return search


def cells(P: np.ndarray, p: dict) -> np.ndarray:
    """The cell of each row in each table: signs of the table's own projections, packed."""
    t, k = p["tables"], p["bits"]
    signs = (P[:, t : t + t * k] > 0).reshape(len(P), t, k)
    return signs @ (1 << np.arange(k, dtype=np.int64))


def valid(v: F.Column) -> F.Column:
    """Not null, with only finite components, not all of them zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.95, seed: int = 11, bound: int = CELL_BOUND) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    good = F.coalesce(valid(F.col("v")) & F.col("vec_id").isNotNull(), F.lit(False))
    dims = sorted(r["dim"] for r in base.where(good).select(F.size("v").alias("dim")).distinct().collect())
    alone = F.lit(0).cast("long").alias("n_links")
    if not dims:
        return base.select("vec_id", alone, F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Vectors of different lengths never link, so each length is searched by itself.
    named = reduce(DataFrame.unionByName, (_of_length(base.where(good & (F.size("v") == dim)), dim, threshold, seed, bound) for dim in dims))
    rows = base.select("vec_id", F.when(good, F.col("v")).alias("v")).join(named, "v", "left")
    out = rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _of_length(rows: DataFrame, dim: int, threshold: float, seed: int, bound: int) -> DataFrame:
    """(v, n_links, component_id) of each distinct vector of valid rows (vec_id, v), all of one length."""
    # Equal vectors: one class, named by its smallest id. Its key is the vector itself.
    # Links are counted by a number of its own, for several classes may have one name where ids repeat.
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    some = classes.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").select("v").limit(SAMPLE).collect()
    unit = np.array([r["v"] for r in some], float).reshape(-1, dim)
    p, lines = plan(classes.count(), threshold, unit / np.linalg.norm(unit, axis=1)[:, None], seed)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2000):
            V = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            P, t = V / np.linalg.norm(V, axis=1)[:, None] @ lines, p["tables"]
            k = (cells(P, p) + (np.arange(t, dtype=np.int64) << 40)).ravel()
            q = np.clip(np.floor(P[:, -COUNTED:] * (STEPS / p["window"])) + 128, 0, 255).astype(np.uint8)
            of = np.repeat(np.arange(len(V)), t)
            marks = q.view(np.int64)[of]
            along = pa.array(P[:, :t].ravel().astype(np.float32))
            yield pa.record_batch(
                [pa.array(k), b.column(1).take(pa.array(of)), along, *(pa.array(marks[:, i].copy()) for i in range(3))],
                ["k", "cid", "along", "q1", "q2", "q3"]
            )

    some = classes.repartition(max(2, min(2000, classes.rdd.getNumPartitions()))).select("v", "cid")
    small_rows = some.mapInArrow(keyed, "k long, cid long, along float, q1 long, q2 long, q3 long")
    # Vectors travel to those cells only in which they have a partner to verify.
    near = written(in_groups(split_hot(small_rows, "k", bound), "k", _collisions(p), "k long, cid long").distinct(), "near")
    dealt = near.join(classes, "cid").select("k", "v", "vec_id", "n", "cid")
    links = written(in_groups(split_hot(dealt, "k", bound), "k", _search(p, lines, threshold), "cid long, n long, u long, v long"), "links")
    totals = links.groupBy("cid").agg(F.sum("n").alias("others"))
    found = components(links.select("u", "v"))
    named = classes.select("cid", "vec_id", F.col("n").alias("size"), "v").join(totals, "cid", "left").join(found, F.col("vec_id") == F.col("node"), "left")
    return (
        named.select(
            "v", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"),
            F.coalesce("label", "vec_id").alias("component_id")
        )
    )
