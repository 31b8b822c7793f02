"""Benchmark decontamination with a distributed positional inverted index.

The training side is stored as an index of shards, one per about `SHARD_BYTES` of text (a longer document is a shard by
itself): the shard's terms, how many postings each has, and the postings, which are token positions within the shard,
sorted by term and position. The index is written once to the shared folder and read by every pass over the benchmark.

A benchmark window takes its terms' lists from the shard's rarest term on: postings less the term's offset are possible
starts, and each further list, adjusted by its own offset, is intersected with what is left (by binary search, as the
starts are few and the lists are sorted). Starts that pass all lists are exact phrase matches. Proximity matches take
the same lists with some slack around each offset. Nothing is shuffled; a document's result is complete in its shard.

The benchmark's items are broadcast in slices of at most `slice_words` words; a worker makes a slice's windows once. More
slices mean more passes over the index, whose hits are merged by shard and place. `clean_only` removes rows by the same
index.

Defined results: a null text has no words; an item or a document without words has no windows and no hits. Very long texts
are indexed whole. Equal items each count; rows that repeat an item_id count once. An item without an id hits and
contaminates as any other, but is not in the list of items, nor counted there. Repeated document rows, and rows with a
null doc_id, have results of their own. An empty table gives no rows, an empty benchmark no hits. Other columns are
ignored, whatever their names. Lists start from the term that is rarest in the shard; of equal terms from the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small, strings, texts, written

WINDOW = 10
SLICE_WORDS = 2_000_000
#: Most characters of a shard's texts, unless it is one text.
SHARD_BYTES = 2_000_000
PARTS = ("terms", "counts", "postings", "lengths")
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """A-Z lower-cased; runs of digits, letters and everything from U+0080 on."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Windows:
    """The windows of some items: term numbers by offset, -1 behind a short item's end."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.terms: dict[bytes, int] = {}
        rows, lengths, of = [], [], []
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            t = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            for s in range(max(1, len(t) - window + 1) if t else 0):
                part = t[s : s + window]
                rows.append(part + [-1] * (window - len(part)))
                lengths.append(len(part))
                of.append(k)
        self.rows = np.array(rows, np.int32).reshape(-1, window)
        self.lengths, self.of = np.array(lengths, np.int64), np.array(of, np.int64)


def _windows(held, window: int) -> Windows:
    """The windows of a broadcast slice, kept beside it, so that a worker that is reused makes them once."""
    if ("windows", window) not in held.value:
        held.value["windows", window] = Windows(held.value["items"], window)
    return held.value["windows", window]


class ShardIndex:
    """A positional inverted index of some documents: terms, their numbers of postings, sorted postings, word counts."""

    def __init__(self, terms: list[bytes], counts: np.ndarray, postings: np.ndarray, lengths: np.ndarray):
        self.terms, self.counts, self.postings = terms, counts, postings
        self.ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    @classmethod
    def build(cls, docs: list[str]) -> ShardIndex:
        from collections import defaultdict
        from itertools import count

        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        each = [np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in map(words, docs)]
        tokens = np.concatenate(each) if each else np.empty(0, np.int32)
        return cls(list(number), np.bincount(tokens, minlength=len(number)), np.argsort(tokens, kind="stable"), np.array([*map(len, each)], np.int64))

    def stored(self) -> tuple[bytes, bytes, bytes, bytes]:
        """terms, counts, postings and word counts as bytes; differences of postings are laid out byte by byte to compress well."""
        steps = np.diff(self.postings, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4)
        return b" ".join(self.terms), self.counts.astype("<i4").tobytes(), steps.T.tobytes(), np.diff(self.ends).astype("<i4").tobytes()

    @classmethod
    def load(cls, terms: bytes, counts: bytes, postings: bytes, lengths: bytes) -> ShardIndex:
        steps = np.ascontiguousarray(np.frombuffer(postings, np.uint8).reshape(4, -1).T).view("<i4").ravel()
        return cls(terms.split(), np.frombuffer(counts, "<i4"), np.cumsum(steps, dtype=np.int64), np.frombuffer(lengths, "<i4"))

    def starts(self, w: Windows, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window number, start, document) of every match. With slack, each term may stand so far from its place."""
        none = (np.empty(0, np.int64),) * 3
        size = int(self.ends[-1]) + 1
        # Lists of the benchmark's terms alone: where each begins and how long it is, by the benchmark's numbers.
        of = np.fromiter(map(w.terms.get, self.terms, repeat(-1)), np.int64, len(self.terms))
        held = np.flatnonzero(of >= 0)
        count, begin = np.zeros(len(w.terms) + 1, np.int64), np.zeros(len(w.terms) + 1, np.int64)
        count[of[held]], begin[of[held]] = self.counts[held], self.offsets[held]
        own = w.rows >= 0
        n = np.where(own, count[w.rows], np.iinfo(np.int64).max)
        alive = np.flatnonzero((n > 0).all(1) & own.any(1))
        if not len(alive):
            return none
        order = np.argsort(n[alive], axis=1, kind="stable")  # rarest first
        rare = w.rows[alive, order[:, 0]]
        reps = count[rare]
        win = np.repeat(np.arange(len(alive)), reps)
        inside = np.arange(len(win)) - np.repeat(np.cumsum(reps) - reps, reps)
        anchor = self.postings[begin[rare][win] + inside]
        start, length = anchor - order[win, 0], w.lengths[alive]
        doc = np.searchsorted(self.ends, anchor, "right") - 1
        fits = (start >= self.ends[doc] - slack) & (start + length[win] <= self.ends[doc + 1] + slack)
        win, start, doc = win[fits], start[fits], doc[fits]
        # All lists behind one another are one sorted array of (list, position).
        lists = np.repeat(np.arange(len(self.terms)), self.counts) * size + self.postings
        place = np.full(len(w.terms) + 1, -1, np.int64)
        place[of[held]] = held
        for k in range(1, w.rows.shape[1]):
            if not len(win):
                break
            off = order[win, k]
            term = w.rows[alive[win], off]
            ok = term < 0
            for d in range(-slack, slack + 1):
                p = start + off + d
                there = (p >= self.ends[doc]) & (p < self.ends[doc + 1])
                asked = place[term] * size + p
                at = np.minimum(np.searchsorted(lists, asked), len(lists) - 1)
                ok |= there & (lists[at] == asked)
            win, start, doc = win[ok], start[ok], doc[ok]
        return alive[win], start, doc


def _matches(index: ShardIndex, w: Windows) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which tokens are hit, and per document the items with occurring windows."""
    win, start, doc = index.starts(w)
    edge = np.zeros(int(index.ends[-1]) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + w.lengths[win], -1)
    hit = np.cumsum(edge[:-1]) > 0
    pairs = np.unique(np.stack([doc, w.of[win]], 1), axis=0) if len(win) else np.empty((0, 2), np.int64)
    cuts = np.searchsorted(pairs[:, 0], np.arange(len(index.ends)))
    return hit, [pairs[i:j, 1] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def shards(texts_: list[str], most: int = SHARD_BYTES) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of runs of texts of at most `most` characters in all, or of one text."""
    lo = total = 0
    for i, t in enumerate(texts_):
        if i > lo and total + len(t) > most:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts_):
        yield lo, len(texts_)


def positional_index(docs: DataFrame) -> DataFrame:
    """The stored index, one row a shard: shard, doc_ids, terms, counts, postings, lengths."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1000):
            held = strings(b.column(1))
            for lo, hi in shards(held):
                ids = b.column(0).slice(lo, hi - lo)
                parts = ShardIndex.build(held[lo:hi]).stored()
                yield pa.record_batch([pa.array([ids.to_pylist()], pa.list_(ids.type)), *(pa.array([x], pa.binary()) for x in parts)], ["doc_ids", *PARTS])

    built = texts(docs).mapInArrow(run, f"doc_ids array<{kind}>, " + ", ".join(f"{x} binary" for x in PARTS))
    return written(built.select(F.monotonically_increasing_id().alias("shard"), "*"), "positional-index", compression="zstd")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()


def slices(benchmark: DataFrame, slice_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items by id, read one partition at a time, in lists of at most about slice_words words."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.groupBy("i", "t").agg(F.lit(1).alias("_")).orderBy("i", "t")
    now, n = [], 0
    for r in rows.toLocalIterator():
        now.append((r[0], r[1]))
        n += len(words(r[1]))
        if n >= slice_words:
            yield now
            now, n = [], 0
    yield now


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = positional_index(docs)
    parts = slices(benchmark, slice_words)
    found, second = _scan(index, next(parts), window, kind, False), next(parts, None)
    if second is not None:
        found = None
        for part in slices(benchmark, slice_words):
            df = _scan(index, part, window, kind, True)
            found = df if found is None else found.unionByName(df)

        def merge(batches):
            for b in batches:
                n = [int(np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in v]).sum()) for v in b.column(2).to_pylist()]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), b.column(3)], ["doc_id", "n_words", "n_hit", "items"])

        merged = found.groupBy("shard", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        found = merged.drop("shard", "place").mapInArrow(merge, f"doc_id {kind}, n_words long, n_hit long, items array<string>")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, ShardIndex]]:
    for b in small(batches, 1):
        yield b.column(0)[0].as_py(), b.column(1).flatten(), ShardIndex.load(*(b.column(k)[0].as_py() for k in range(2, 6)))


def _scan(index: DataFrame, items: list[tuple[str, str]], window: int, kind: str, bits: bool) -> DataFrame:
    """Every document's hits of these items: their number, or with bits a byte a word and the document's place."""
    held = index.sparkSession.sparkContext.broadcast({"items": items})  # at most slice_words words, and one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _windows(held, window)
        for shard, ids, x in _shards_of(batches):
            hit, of = _matches(x, w)
            names = pa.array([sorted({w.items[i] for i in y} - {None}) for y in of], pa.list_(pa.string()))
            n = pa.array(np.diff(x.ends), pa.int64())
            if bits:
                raw = [hit[i:j].astype(np.uint8).tobytes() for i, j in zip(x.ends[:-1], x.ends[1:], strict=True)]
                yield pa.record_batch(
                    [ids, n, pa.array(raw, pa.binary()), names, pa.array([shard] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int64())],
                    ["doc_id", "n_words", "hits", "items", "shard", "place"]
                )
            else:
                total = np.concatenate([[0], np.cumsum(hit)])
                yield pa.record_batch([ids, n, pa.array(total[x.ends[1:]] - total[x.ends[:-1]], pa.int64()), names], ["doc_id", "n_words", "n_hit", "items"])

    more = "hits binary, items array<string>, shard long, place long" if bits else "n_hit long, items array<string>"
    return index.mapInArrow(run, f"doc_id {kind}, n_words long, {more}")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 2, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, position): window places where every term stands within `slack` words of its offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = positional_index(docs)
    out = None
    for part in slices(benchmark, slice_words):
        held = docs.sparkSession.sparkContext.broadcast({"items": part})

        def run(batches, held=held):
            w = _windows(held, window)
            for _, ids, x in _shards_of(batches):
                win, start, doc = x.starts(w, slack)
                yield pa.record_batch(
                    [ids.take(pa.array(doc)), pa.array([w.items[k] for k in w.of[win]], pa.string()), pa.array(start - x.ends[doc], pa.int64())],
                    ["doc_id", "item_id", "position"]
                )

        df = index.mapInArrow(run, f"doc_id {kind}, item_id string, position long")
        out = df if out is None else out.unionByName(df)
    return out


def clean_only(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """docs without the contaminated documents, with all their columns, by the stored index as above.

    A verdict hangs on the text alone, so it is carried by two hashes of the text: rows that repeat a doc_id or a text, and
    rows without an id, stay or go by their own texts. Null and empty texts stay. An empty benchmark keeps all rows.
    """
    key = F.concat_ws(":", F.xxhash64("text", F.lit(1)), F.xxhash64("text", F.lit(2)))
    found = decontaminate(docs.where("text IS NOT NULL").select(key.alias("doc_id"), "text"), benchmark, window, slice_words)
    dirty = written(found.where("contaminated").select(F.col("doc_id").alias("_lectern_dirty")).distinct(), "contaminated")
    return docs.join(dirty, key == F.col("_lectern_dirty"), "left_anti")
