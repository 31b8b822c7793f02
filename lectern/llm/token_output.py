"""Token ids in Simple-8b files.

File format (all little-endian): the magic b"S8B1"; a u32 with the length of the header; the header as JSON, with the
partition, the number of ids that its partition holds before this file, documents, ids and blocks; per document its
doc_id (i64) and number of ids (u32); per block its first id's number in the file (u64) and its first word's number
(u64); then the words. A word's top 4 bits are its selector: how many values of how many bits follow, the first in the
lowest bits. Selectors 0 and 1 hold 240 and 120 ones, 15 is the escape: the next word is one raw 64-bit value, for
values of over 60 bits. Every block starts with a new word, so blocks decode alone, each by a few array operations.

Documents are dealt by ranges of doc_id, sorted within (ties by text), tokenized and written by the task that has
them, in files of about `file_ids` ids, so memory does not depend on the size of a partition. A file is written under
another name and then renamed; a repeated task writes the same bytes. The files are then read back through Spark.

Defined results: a null text is empty and has the end id alone. Very long texts are encoded whole; a document lies in
one file, however long. A null doc_id comes first; the files mark it by the lowest long, -2^63, which as an id is
therefore read back as null. Ties of doc_id go by text; repeated rows are documents of their own. An empty table writes
no file and gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import shared_dir, strings, texts, written

MAGIC = b"S8B1"
# Values a word and bits a value, by selector. Selectors 0 and 1 are runs of ones, 15 is the escape.
COUNTS = [240, 120, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1]
WIDTHS = [0, 0, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64]
BLOCK, FILE_IDS = 16_384, 2_000_000
END_ID = 1
_NULL = -(2**63)
# Between pieces: no id, as a tokenizer has fewer than 2^24 of them.
_BETWEEN = b"\xff" * 4
# Bytes of text that are split together, and unseen pieces that are encoded at once.
_TOGETHER, _AT_ONCE = 4_000_000, 50_000


def encode_block(ids: np.ndarray) -> np.ndarray:
    """The words of one block: at each place the selector that takes most values."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    ids = ids.astype(np.uint64)
    wide = np.zeros(n + COUNTS[2], np.uint64)  # places behind the end fit everywhere
    wide[:n] = ids
    slim = wide.astype(np.uint32) if ids.max() < 1 << 32 else wide
    # The first selector whose bits hold a value, then the largest of these over as many values as each selector takes.
    need = np.full(len(wide), 2, np.uint8)
    for w in WIDTHS[2:15]:
        if w < 8 * slim.itemsize:
            need += slim > slim.dtype.type((1 << w) - 1)
    choice, over = np.full(n, 15, np.uint8), 1
    for s in range(14, 1, -1):
        step, over = COUNTS[s] - over, COUNTS[s]
        if step:
            need = np.maximum(need[:-step], need[step:])
        np.putmask(choice, need[:n] <= s, s)
    ones = ids == 1
    for s in (1, 0):
        if np.count_nonzero(ones) >= COUNTS[s]:
            run = np.concatenate([[0], np.cumsum(~ones)])
            choice[np.flatnonzero(run[COUNTS[s] :] == run[: n + 1 - COUNTS[s]])] = s
    take = np.array(COUNTS, np.uint8)[choice].tobytes()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += take[i]
    at = np.array(at)
    sel = choice[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(sel == 15)[:-1]])
    words = np.zeros(len(at) + int((sel == 15).sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel).tolist():
        own = np.flatnonzero(sel == s)
        p, first = place[own], at[own]
        if s == 15:
            words[p + 1] = ids[first]
        elif s > 1:
            word = wide[first]
            for k in range(1, COUNTS[s]):
                word |= wide[first + k] << np.uint64(k * WIDTHS[s])
            words[p] |= word
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block's words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    real = np.ones(len(words), bool)
    for i in np.flatnonzero(sel == 15).tolist():  # the word behind an escape is raw, whatever its top bits are
        if real[i] and i + 1 < len(words):
            real[i + 1] = False
    heads = np.flatnonzero(real)
    s = sel[heads]
    counts = np.array(COUNTS)[s]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k in np.unique(s).tolist():
        at, first = heads[s == k], starts[s == k]
        if k < 2:
            out[(first[:, None] + np.arange(COUNTS[k])).ravel()] = 1
        elif k == 15:
            out[first] = words[at + 1]
        else:
            shifts = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
            out[(first[:, None] + np.arange(COUNTS[k])).ravel()] = ((words[at][:, None] >> shifts) & np.uint64((1 << WIDTHS[k]) - 1)).ravel()
    return out[:n]


def pack(docs: list[tuple[int, np.ndarray]], partition: int, before: int, block: int = BLOCK) -> bytes:
    """A file's bytes."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.empty(0, np.uint32)
    blocks = [encode_block(ids[i : i + block]) for i in range(0, len(ids), block)]
    head = json.dumps({"partition": partition, "before": before, "docs": len(docs), "ids": len(ids), "blocks": len(blocks), "block": block}).encode()
    table = np.array([(d, len(x)) for d, x in docs], [("doc", "<i8"), ("n", "<u4")])
    firsts = np.stack([np.arange(len(blocks)) * block, np.cumsum([0, *map(len, blocks)])[:-1]], 1).astype("<u8") if blocks else np.empty((0, 2), "<u8")
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table.tobytes(), firsts.tobytes(), *(b.astype("<u8").tobytes() for b in blocks)])


def unpack(data: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
    """(header, (doc, n) table, ids) of a file's bytes."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b token file")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    head = json.loads(data[8:at])
    table = np.frombuffer(data, [("doc", "<i8"), ("n", "<u4")], head["docs"], at)
    at += table.nbytes
    firsts = np.frombuffer(data, "<u8", 2 * head["blocks"], at).reshape(-1, 2).astype(np.int64)
    words = np.frombuffer(data, "<u8", offset=at + firsts.nbytes)
    ends = np.append(firsts[1:, 1], len(words)) if len(firsts) else []
    parts = [decode_block(words[a:b], min(head["block"], head["ids"] - i)) for (i, a), b in zip(firsts, ends, strict=True)]
    return head, table, np.concatenate(parts) if parts else np.empty(0, np.uint64)


class Encoder:
    """Ids as little-endian u32 bytes, by the tokenizers library.

    Where the tokenizer squeezes white space first and lets no token hold any, pieces between ASCII white space are
    encoded once and kept, across the tasks of a worker. Pieces that were not seen are split, many at once, as the
    tokenizer's own pattern splits them, and their parts, kept likewise, go to the library's model together; pieces
    outside plain Latin text go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 350_000):
        import re

        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.pieces: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        rules = json.loads(self.tokenizer.to_str())
        steps = (rules.get("normalizer") or {}).get("normalizers", [])
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        added = [x["content"] for x in rules["added_tokens"]]
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in rules["added_tokens"]) and all("<" in x for x in added)
        self.apart = (
            plain and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed" and split[0]["invert"]
            and not split[1]["add_prefix_space"] and not split[1]["use_regex"] and rules["model"]["type"] == "BPE"
        )
        if self.apart:
            self.parts["\n"] = _BETWEEN
            # Below U+0250 each letter is lowered, and found normal, by itself.
            own = [c for c in map(chr, range(0x250)) if c.isprintable() and c not in " <\u0130" and is_normalized("NFC", c)]
            self.odd = re.compile("[^\n" + re.escape("".join(own)) + "]").search
            # The pattern with the plain letters and numbers listed in its brackets is one for re, which is faster.
            pattern = split[0]["pattern"]["Regex"]
            kinds = {k: re.escape("".join([c for c in own if regex.match(rf"\p{{{k}}}", c)])) for k in "LN"}
            listed = re.sub(r"\\p\{([LN])\}", lambda m: kinds[m[1]], pattern)
            simple = r"\p" not in re.sub(r"\[.*?\]", "", pattern) and r"\p" not in listed
            self.find = re.compile(listed + r"|\n").findall if simple else regex.compile(pattern + r"|\n").findall
            # The byte-level alphabet: printable bytes stand for themselves, the others for what follows U+00FF.
            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in own]
            letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)} | {32: " "}
            self.letters = "".join([letters[b] for b in range(256)])
            # The model alone, on words of that alphabet between spaces.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = CharDelimiterSplit(" ")
            suffix, vocab = rules["model"]["end_of_word_suffix"], rules["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each part of plain pieces. A word's last id alone has the end-of-word suffix."""
        letters = charmap_decode(" ".join(words).encode(), "strict", self.letters)[0]
        raw = array("I", self.model.encode_batch_fast([letters], add_special_tokens=False)[0].ids).tobytes()
        ends = (4 * np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 4).tolist()
        if len(ends) == len(words) and ends[-1] == len(raw):
            return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        return [array("I", [t.id for t in self.tokenizer.model.tokenize(w)]).tobytes() for w in letters.split(" ")]

    def plain(self, text: str) -> list[bytes]:
        """The ids of each of the plain pieces between line feeds."""
        return b"".join(self.known(self.find(text.lower()), self.parts, self.words)).split(_BETWEEN)

    def fresh(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        text, odd = "\n".join(pieces), self.odd
        if not odd(text):
            return self.plain(text)
        plain = iter(self.plain("\n".join([x for x in pieces if not odd(x)])))
        return [self.whole(x) if odd(x) else next(plain) for x in pieces]

    def known(self, keys: list[str], kept: dict[str, bytes], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each key: those kept, the others encoded together."""
        out = list(map(kept.get, keys))
        gaps = [i for i, x in enumerate(out) if x is None]
        new, made = list({keys[i] for i in gaps}), {}
        for i in range(0, len(new), _AT_ONCE):
            made.update(zip(new[i : i + _AT_ONCE], encode(new[i : i + _AT_ONCE]), strict=True))
        for i in gaps:
            out[i] = made[keys[i]]
        kept.update(islice(made.items(), max(0, self.most - len(kept))))  # frequent keys come early, so the first ones stay
        return out

    def joined(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; pieces that texts repeat are looked up once."""
        split = pc.ascii_split_whitespace(texts)
        pieces = split.values.dictionary_encode()
        ids = self.known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), self.pieces, self.fresh)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which, flat = pieces.indices.to_numpy(), np.frombuffer(b"".join(ids), "<u4")
        ends = np.cumsum(np.append(0, sizes[which]))
        # The ids of piece after piece, each from where its own begin in flat.
        flat = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], np.diff(ends))]
        cuts = ends[split.offsets.to_numpy()].tolist()
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield flat[i:j]

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; texts of some megabytes are worked on together."""
        if not self.apart:
            for text in strings(texts):
                yield np.frombuffer(self.whole(text), "<u4")
            return
        texts = texts.fill_null("")
        group = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // _TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield from self.joined(texts.slice(i, j - i))

    def __call__(self, text: str) -> bytes:
        return next(self.many(pa.array([text]))).tobytes()


def encoder(path: str) -> Encoder:
    """The worker's encoder: it outlives the task, for Python workers are reused."""
    import os
    import sys
    from types import ModuleType

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.modules.setdefault("_lectern_kept", ModuleType("_lectern_kept")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _put(folder: str, name: str, data: bytes, attempt: str) -> None:
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{path}/_{name}.{attempt}") as f:
        f.write(data)
    fs.move(f"{path}/_{name}.{attempt}", f"{path}/{name}")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """(folder, (partition, file, docs, ids) of every file written)."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    _folder(spark, folder)
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), f"{task.stageId()}-{task.taskAttemptId()}"
        code, held, n, before, k, made = encoder(tokenizer), [], 0, 0, 0, []

        def flush() -> None:
            nonlocal held, n, before, k
            name = f"p{part:06d}-{k:06d}.s8b"
            _put(folder, name, pack(held, part, before), attempt)
            made.append((part, name, len(held), n))
            held, n, before, k = [], 0, before + n, k + 1

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), code.many(b.column(1)), strict=True):
                ids = np.append(ids, end)
                held.append((_NULL if doc is None else doc, ids))
                n += len(ids)
                if n >= file_ids:
                    flush()
        if held:
            flush()
        cols = list(zip(*made, strict=True)) or [[]] * 4
        yield pa.record_batch(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
            ["partition", "file", "docs", "ids"]
        )

    rows = texts(docs).select(F.col("doc_id").cast("long"), "text")
    dealt = (
        rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    )
    return folder, written(dealt.mapInArrow(run, "partition int, file string, docs long, ids long"), "token-files")


def _folder(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def read_tokens(spark: SparkSession, folder: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                head, table, ids = unpack(data.as_py())
                raw = ids.astype("<u4")
                ends = np.cumsum(table["n"].astype(np.int64))
                begins = ends - table["n"]
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
                doc = pa.array(table["doc"], mask=table["doc"] == _NULL)
                cols = [
                    pa.array(np.full(len(table), head["partition"], np.int32)), doc, pa.array(head["before"] + begins),
                    pa.array(table["n"].astype(np.int64)), pa.array(crc, pa.int64())
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:] if len(ends) else [0]).astype(np.int32)), pa.array(raw.astype(np.int64))))
                for i in range(0, len(table), 10_000):
                    yield pa.record_batch([c.slice(i, 10_000) for c in cols], names)

    schema = "partition int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    names = ["partition", "doc_id", "inner", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("content")
    docs = data.mapInArrow(run, schema)
    # A row for each partition that was written, so its number is bounded by the number of tasks.
    base = files.groupBy("partition").agg(F.sum("ids").alias("n"))
    base = base.select("partition", (F.sum("n").over(W.orderBy("partition")) - F.col("n")).alias("base"))
    return (
        docs.join(F.broadcast(base), "partition").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
    )


def token_output(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Writes the files and returns doc_id, start, n_tokens, ids_crc32, read from them."""
    folder, files = write_tokens(docs, tokenizer, folder, end_id)
    return read_tokens(docs.sparkSession, folder, files)
