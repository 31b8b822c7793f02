"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A pair within 4 of 64 bits differs in at most 4 of its 8 positional bytes, so it shares at least 4 of them. Posting
lists are keyed by three positional bytes at once: the 20 triples below meet every choice of 4 positions out of 8, so
each such pair meets in a list. For pairs that meet, shared positional bytes are tallied, those with fewer than the
guaranteed 4 are dropped, and the rest are verified on all bits. Every list hands on a spanning forest of its links, so
a group of near copies costs as many rows as it has members, and no link's connectivity is lost.

Defined results: a null or empty text, and a text of white space only, has fingerprint 0 and links as any other. Equal
texts share a fingerprint. Rows that repeat a doc_id count as that document; a null doc_id is never the smallest one
unless nothing else is reachable, where the component is null. Very long texts are taken whole. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small, strings, texts, written
from lectern.llm.graph import components, in_groups, split_hot

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Most rows of a posting list that are handled as one group.
LIST_BOUND = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_ONES = _BITS.sum(1).astype(np.uint8)


def covering_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions such that any 4 positions hold one of them (Turan's system on 3 parts)."""
    part = lambda p: p % 3
    out = []
    for t in combinations(range(8), 3):
        sizes = [sum(part(p) == k for p in t) for k in range(3)]
        if 3 in sizes or any(sizes[k] == 2 and sizes[(k + 1) % 3] == 1 for k in range(3)):
            out.append(t)
    return out


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """8 bytes, the highest bit first: a bit is set if it is set in more than half of the shingles' XXH64."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    if len(words) <= shingle:
        return xxh64_digest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    every = b"".join([xxh64_digest(b" ".join(w), seed) for w in zip(*(words[i:] for i in range(shingle)), strict=False)])
    each = np.frombuffer(every, np.uint8).reshape(n, 8)
    votes = np.stack([np.bincount(each[:, j], minlength=256) @ _BITS for j in range(8)])
    return np.packbits(votes * 2 > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            raw = b"".join(fingerprint(t, shingle, seed) for t in strings(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array(np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, fp long")


def _links(most: int):
    def near(x: np.ndarray) -> np.ndarray:
        """x: XOR of pairs, as uint64. The tally of shared bytes filters, then all bits decide."""
        each = x.view(np.uint8).reshape(-1, 8)
        keep = (each == 0).sum(1) >= 8 - most
        keep[keep] = _ONES[each[keep]].sum(1) <= most
        return keep

    def search(c: dict[str, np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        fp, rep, own, a, b = c["fp"].view(np.uint64), c["rep"], c["own"], c["a"], c["b"]
        sizes = np.diff(starts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        left, right = [], []
        small = (sizes <= 32)[group]
        at, d = np.flatnonzero(small), 1
        while True:  # members of small groups meet the one d places later
            at = at[at + d < len(fp)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            hit = at[near(fp[at] ^ fp[at + d])]
            hit = hit[(a[hit] == b[hit]) | (own[hit] != own[hit + d])]
            left.append(rep[hit])
            right.append(rep[hit + d])
            d += 1
        for g in np.flatnonzero(sizes > 32):
            lo, hi = starts[g], starts[g + 1]
            f, o, r, one = fp[lo:hi], own[lo:hi], rep[lo:hi], a[lo] == b[lo]
            todo = np.ones(hi - lo, bool)
            for root in range(hi - lo):  # breadth first: what a member reaches leaves the list
                if not todo[root]:
                    continue
                todo[root] = False
                queue = [root]
                while queue:
                    i = queue.pop()
                    rest = np.flatnonzero(todo if one else todo & (o != o[i]))
                    new = rest[near(np.ascontiguousarray(f[rest] ^ f[i]))]
                    todo[new] = False
                    queue.extend(new.tolist())
                    left.append(np.full(len(new), r[i]))
                    right.append(r[new])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, rep.dtype)
        return pa.record_batch([pa.array(cat(left), pa.int64()), pa.array(cat(right), pa.int64())], ["u", "v"])

    return search


def near_components(prints: DataFrame, most_bits: int = MOST_BITS, bound: int = LIST_BOUND) -> DataFrame:
    """(fp, rep, component): per distinct fingerprint its smallest doc_id, and the smallest one reachable from it."""
    if not 0 <= most_bits <= 4:
        raise ValueError("the covering triples hold for 4 bits or fewer")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")), "classes")
    byte = lambda p: F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(k << 24).cast("long") + F.shiftleft(byte(x), 16) + F.shiftleft(byte(y), 8) + byte(z) for k, (x, y, z) in enumerate(covering_triples())]
    # A class without any id gets no links: it could not carry a component.
    posts = classes.where("rep IS NOT NULL").select(F.explode(F.array(*keys)).alias("k"), "fp", "rep")
    edges = in_groups(split_hot(posts, "k", bound), "k", _links(most_bits), "u long, v long")
    found = components(edges)
    return classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", "rep", F.coalesce("label", "rep").alias("component"))


def simhash_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    prints = written(fingerprints(docs), "prints")
    found = near_components(prints)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").select("doc_id", hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id, null last, with all its columns.

    Fingerprints are made once, beside two hashes of the text that Spark makes of rows wherever it needs them again, so the
    rows to keep are found by doc_id and hashes. Components are taken of fingerprints, so rows with a null or repeated
    doc_id stay if their texts are no near-duplicates; of rows that repeat both doc_id and text one stays. Null and empty
    texts are near-duplicates of each other. An empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = F.coalesce(F.col("text"), F.lit(""))
    marks = (F.xxhash64(plain, F.lit(1)), F.xxhash64(plain, F.lit(2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            raw = b"".join(fingerprint(t) for t in strings(b.column(1)))
            fp = pa.array(np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64))
            yield pa.record_batch([b.column(0), fp, b.column(2), b.column(3)], ["doc_id", "fp", "h1", "h2"])

    rows = docs.select("doc_id", plain.alias("text"), marks[0].alias("h1"), marks[1].alias("h2"))
    prints = written(rows.mapInArrow(run, f"doc_id {kind}, fp long, h1 long, h2 long"), "prints")
    each = prints.groupBy("fp", "doc_id", "h1", "h2").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "n")
    classes = each.groupBy("fp").agg(F.min(order).alias("least"))
    found = near_components(classes.select("fp", F.col("fp").alias("doc_id"))).select("fp", "component")
    first = classes.join(found, "fp").groupBy("component").agg(F.min("least").alias("k")).select("k.*")
    keep = written(first.select(F.col("doc_id").alias("_lectern_keep"), F.col("h1").alias("_lectern_1"), F.col("h2").alias("_lectern_2"), "n"), "keep")
    same = F.col("doc_id").eqNullSafe(F.col("_lectern_keep")) & (marks[0] == F.col("_lectern_1")) & (marks[1] == F.col("_lectern_2"))
    # Only rows that stand there more than once are gathered to leave one of them.
    many = docs.join(keep.where("n > 1"), same, "left_semi")
    many = many.withColumns({"_lectern_1": marks[0], "_lectern_2": marks[1]}).dropDuplicates(["doc_id", "_lectern_1", "_lectern_2"])
    return docs.join(keep.where("n = 1"), same, "left_semi").unionByName(many.drop("_lectern_1", "_lectern_2"))
