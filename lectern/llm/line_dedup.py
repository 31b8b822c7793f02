"""Line dedup through a sharded minimal perfect hash.

One pass over the documents counts, per key of at least 20 code points, the documents that hold it and the largest of
them. Keys found in at least 3 documents go, dealt by hash, into shards: each is a minimal perfect hash (levels of bit
arrays, where a key that has a bit to itself is placed and the others go on to the next level) whose ranks index
arrays of fingerprints, document counts and largest ids. The second pass probes these arrays, so no line is joined.

The arrays take about 26 bytes a frequent key. Up to `broadcast_bound` bytes of them are broadcast; beyond, blocks of
documents ask the shards for the distinct hashes of their lines (never the lines), which are probed where the shard is,
and the answers return by block. Two independent 64-bit hashes identify a key: one places it, the other is its fingerprint.

Defined results: a null or empty text is one empty line. Very long texts are split whole. Rows that repeat a doc_id count
as documents of their own, and where that id is the largest all of them keep the line. A null doc_id counts as a document,
smaller than any other; the id -2^63 stands for it and is treated as null. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small, strings, texts, written

LEAST_POINTS, LEAST_DOCS = 20, 3
SHARD_KEYS = 200_000
LEVELS, GAMMA = 40, 1.6
BROADCAST_BOUND = 128 << 20
#: Beyond that bound: most documents and bytes of a block, and most rows that one place of a shard is asked for.
BLOCK_ROWS, BLOCK_BYTES, PLACE_ROWS = 2000, 4 << 20, 2_000_000
_NULL = -(2**63)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def key_of(line: bytes) -> bytes:
    """Stripped of space and \\t\\n\\v\\f\\r at both ends, A-Z lower-cased."""
    return line.strip().lower()


def hashes(text: str) -> tuple[list[bytes], np.ndarray]:
    """The lines, and for each line two 64-bit hashes of its key; zeros for a key of under 20 code points."""
    from xxhash import xxh64_intdigest

    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    out = np.zeros((len(lines), 2), np.uint64)
    for i, line in enumerate(lines):
        key = key_of(line)
        if len(key) >= LEAST_POINTS and (len(key) >= 4 * LEAST_POINTS or len(key.decode("utf-8", "surrogatepass")) >= LEAST_POINTS):
            out[i] = xxh64_intdigest(key, 1), xxh64_intdigest(key, 2) | 1
    return lines, out


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        rest = keys
        for level in range(LEVELS):
            if not len(rest):
                break
            size = max(64, int(GAMMA * len(rest)))
            at = (_mixed(rest, level) % np.uint64(size)).astype(np.int64)
            self.levels.append(np.bincount(at, minlength=size) == 1)
            rest = rest[~self.levels[-1][at]]
        self.left = np.sort(rest)  # none, for all that is likely
        self.base = np.cumsum([0, *(x.sum() for x in self.levels)])
        self.ranks = [np.concatenate([[0], np.cumsum(np.add.reduceat(x, np.arange(0, len(x), 64)))[:-1]]) for x in self.levels]
        self.levels = [np.packbits(x) for x in self.levels]
        self.sizes = [max(64, int(GAMMA * n)) for n in len(keys) - self.base[:-1]]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The key's number; -1, or the number of another key, for one that is not in the set."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks, size) in enumerate(zip(self.levels, self.ranks, self.sizes, strict=True)):
            at = (_mixed(keys[todo], level) % np.uint64(size)).astype(np.int64)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            own = at[hit]
            block = own >> 6
            padded = np.concatenate([bits, np.zeros(8, np.uint8)])
            word = padded[(block[:, None] << 3) + np.arange(8)].view(">u8").ravel().astype(np.uint64)
            inside = (own & 63).astype(np.uint64)
            before = np.where(inside == 0, np.uint64(0), word >> (np.uint64(64) - np.maximum(inside, np.uint64(1))))
            out[todo[hit]] = self.base[level] + ranks[block] + np.bitwise_count(before)
            todo = todo[~hit]
        if len(self.left) and len(todo):
            i = np.minimum(np.searchsorted(self.left, keys[todo]), len(self.left) - 1)
            out[todo] = np.where(self.left[i] == keys[todo], self.base[-1] + i, -1)
        return out


class Shard:
    """A perfect hash with the arrays that it indexes."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, last: np.ndarray):
        self.hash = PerfectHash(h1)
        at = self.hash(h1)
        self.mark, self.count, self.last = np.empty_like(h2), np.empty(len(h1), np.int32), np.empty_like(last)
        self.mark[at], self.count[at], self.last[at] = h2, np.minimum(count, 2**31 - 1), last

    def dump(self) -> bytes:
        """The arrays alone, so that reading them needs no class of this module."""
        return pickle.dumps((self.hash.__dict__, self.mark, self.count, self.last), 5)

    @classmethod
    def load(cls, data: bytes) -> Shard:
        new = cls.__new__(cls)
        new.hash = PerfectHash.__new__(PerfectHash)
        new.hash.__dict__, new.mark, new.count, new.last = pickle.loads(data)
        return new

    def keeper(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is frequent, and then the largest document that holds it."""
        at = self.hash(h1)
        found = at >= 0
        found[found] = self.mark[at[found]] == h2[found]
        return found, np.where(found, self.last[np.maximum(at, 0)], 0) if len(self.last) else np.zeros(len(h1), np.int64)


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def frequent_keys(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, n, last) of the keys found in at least `least` documents; counts combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2000):
            parts, ids = [], []
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                h = hashes(text)[1]
                h = np.unique(h[h[:, 1] != 0], axis=0) if len(h) > 1 else h[h[:, 1] != 0]
                parts.append(h)
                ids.append(np.full(len(h), _NULL if doc is None else doc, np.int64))
            h = np.concatenate(parts) if parts else np.empty((0, 2), np.uint64)
            yield pa.record_batch(
                [
                    pa.array(np.ascontiguousarray(h[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(h[:, 1]).view(np.int64)),
                    pa.array(np.concatenate(ids) if ids else np.empty(0, np.int64))
                ],
                ["h1", "h2", "doc_id"]
            )

    held = texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "h1 long, h2 long, doc_id long")
    return held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least)


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, arrays): a pickled Shard each, built where its keys were dealt."""
    def build(pdf):
        import pandas as pd

        s = Shard(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64), pdf.n.to_numpy(), pdf["last"].to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "arrays": [s.dump()]})

    numbered = keys.withColumn("shard", F.expr(f"cast(pmod(shiftrightunsigned(h1, 40), {shards}) as int)"))
    return numbered.groupBy("shard").applyInPandas(build, "shard int, arrays binary")


def _outcome(lines: list[bytes], gone: np.ndarray) -> tuple[int, int, str]:
    kept = b"\n".join([line for line, x in zip(lines, gone, strict=True) if not x]) if gone.any() else b"\n".join(lines)
    return len(lines), int(gone.sum()), kept


_SCHEMA = "doc_id {kind}, n_lines long, n_dropped long, kept_text string"


def _rows(ids: pa.Array, out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
    return pa.record_batch(
        [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
        ["doc_id", "n_lines", "n_dropped", "kept_text"]
    )


def line_dedup(docs: DataFrame, least: int = LEAST_DOCS, broadcast_bound: int = BROADCAST_BOUND, place_rows: int = PLACE_ROWS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = written(frequent_keys(docs, least), "line-keys")
    total = keys.count()
    shards = max(1, -(-total // SHARD_KEYS))
    built = written(build_shards(keys, shards), "line-shards")
    size = built.agg(F.sum(F.length("arrays"))).first()[0] or 0
    if size <= broadcast_bound:
        held = spark.sparkContext.broadcast({r[0]: r[1] for r in built.collect()})  # at most broadcast_bound bytes

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {k: Shard.load(x) for k, x in held.value.items()}
            for b in small(batches, 2000):
                ids = np.array([_NULL if x is None else x for x in b.column(0).to_pylist()], np.int64)
                each = [hashes(t) for t in strings(b.column(1))]
                ends = np.cumsum([0, *(len(x) for x, _ in each)])
                h = np.concatenate([x for _, x in each]) if each else np.empty((0, 2), np.uint64)
                gone = dropped(own, shards, h, np.repeat(ids, np.diff(ends)))
                yield _rows(b.column(0), [_outcome(x, gone[i:j]) for (x, _), i, j in zip(each, ends[:-1], ends[1:], strict=True)])

        return texts(docs).mapInArrow(probe, _SCHEMA.format(kind=kind))
    return _dealt(docs, built, shards, kind, place_rows)


def dropped(own: dict[int, Shard], shards: int, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    gone = np.zeros(len(h), bool)
    real = np.flatnonzero(h[:, 1] != 0)
    of = shard_of(h[real, 0], shards)
    for k, s in own.items():
        at = real[of == k]
        found, last = s.keeper(h[at, 0], h[at, 1])
        gone[at] = found & (ids[at] != last)
    return gone


def _dealt(docs: DataFrame, built: DataFrame, shards: int, kind: str, bound: int) -> DataFrame:
    """For arrays too large to broadcast: blocks of documents ask the shards, each for the distinct hashes of its lines.

    A line that stands in most documents is thus asked for once a block. A shard that is asked for more than `bound` rows
    is copied to as many places as that takes, by the counts observed, and its askers are dealt over them by block.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now, rows, size = TaskContext.get().partitionId() << 33, 0, 0
        for b in batches:
            own = []
            for n in pa.compute.binary_length(b.column(1)).to_pylist():
                if rows and (rows >= BLOCK_ROWS or size + n > BLOCK_BYTES):
                    now, rows, size = now + 1, 0, 0
                rows, size = rows + 1, size + n
                own.append(now)
            yield pa.record_batch([*b.columns, pa.array(own, pa.int64())], ["doc_id", "text", "block"])

    whole = written(texts(docs).mapInArrow(blocks, f"doc_id {kind}, text string, block long"), "line-docs")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, BLOCK_ROWS):
            block = b.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.empty(0, int)
            for lo, hi in zip(cuts, np.append(cuts[1:], len(block)), strict=True):
                h = [hashes(t)[1] for t in strings(b.column(0).slice(lo, hi - lo))]
                h = np.concatenate(h)
                h = np.unique(h[h[:, 1] != 0], axis=0)
                yield pa.record_batch(
                    [
                        pa.array(x)
                        for x in (
                            shard_of(h[:, 0], shards).astype(np.int32), np.ascontiguousarray(h[:, 0]).view(np.int64),
                            np.ascontiguousarray(h[:, 1]).view(np.int64), np.full(len(h), block[lo])
                        )
                    ],
                    ["shard", "h1", "h2", "block"]
                )

    asked = written(whole.select("text", "block").mapInArrow(ask, "shard int, h1 long, h2 long, block long"), "line-asked")
    places = F.broadcast(asked.groupBy("shard").agg(F.ceil(F.count("*") / bound).cast("int").alias("places")))  # a row a shard
    dealt = asked.join(places, "shard").withColumn("place", F.pmod(F.xxhash64("block"), F.col("places").cast("long")).cast("int")).drop("places")
    arrays = built.join(places, "shard").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).drop("places")

    def probe(key, left, right):
        import pandas as pd

        if not len(right) or not len(left):
            return pd.DataFrame({"block": np.empty(0, np.int64), "h1": np.empty(0, np.int64), "h2": np.empty(0, np.int64), "last": np.empty(0, np.int64)})
        found, last = Shard.load(right.arrays.iloc[0]).keeper(left.h1.to_numpy().view(np.uint64), left.h2.to_numpy().view(np.uint64))
        return left.loc[found, ["block", "h1", "h2"]].assign(last=last[found])

    answers = dealt.groupBy("shard", "place").cogroup(arrays.groupBy("shard", "place")).applyInPandas(probe, "block long, h1 long, h2 long, last long")

    def cut(key, left, right):
        import pandas as pd

        last = {
            (a, b): c for a, b,
            c in zip(right.h1.to_numpy().view(np.uint64).tolist(), right.h2.to_numpy().view(np.uint64).tolist(), right["last"].tolist(), strict=True)
        }
        out = []
        for doc, text in zip(left.doc_id, left.text, strict=True):
            parts, h = hashes(text)
            own = _NULL if doc is None or doc != doc else int(doc)
            out.append(_outcome(parts, np.array([last.get((a, b), own) != own for a, b in h.tolist()], bool)))
        n, gone, kept = zip(*out, strict=True)
        return (
            pd.DataFrame({"doc_id": left.doc_id.to_numpy(), "n_lines": n, "n_dropped": gone, "kept_text": [x.decode("utf-8", "surrogatepass") for x in kept]})
        )

    # A block's texts are bounded, unless it is one document.
    held = whole.select(F.col("doc_id").cast("string"), "text", "block")
    out = held.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(cut, "doc_id string, n_lines long, n_dropped long, kept_text string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
