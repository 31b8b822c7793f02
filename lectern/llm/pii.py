"""Personal data by weak supervision.

Base detectors (email, ip, card, phone) follow fixed patterns and their spans always stay. Looser candidates (spelled
out e-mail addresses and ones without a domain's end, version-like and IPv6 addresses, digit runs of 9 to 19 digits in
any grouping) are judged by labelers that vote for, vote against or abstain: the strict pattern, gazetteers of what such
data begins or ends with, words before and behind, the shape of the number, and repetition within the document.

One pass over the texts writes each document's base spans and candidates, with votes and features, to the shared folder.
Votes of all candidates of the corpus are counted by kind and vote pattern; expectation-maximisation over these counts
estimates the chance of each of the three outcomes of a labeler for true and for false candidates, and each kind's rate.
A logistic span classifier then learns EM's posteriors from features that the labelers don't see as such: the span's
form, and the words around it. It is fitted on at most `SAMPLE` candidates of each kind and vote pattern, picked by a
seeded hash and weighted to the pattern's count, so at most 4 * 3^5 * SAMPLE rows reach its one task. Candidates that it
accepts are added where they overlap no base span and no accepted candidate before them.

Defined results: a null or empty text has no spans. Very long texts are searched whole, in time that grows with their
length and number of candidates alone. Repeated rows, and rows with a null doc_id, have results of their own and count
each by itself. An empty table, or one without candidates, adds nothing. Other columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import sigmoid, small, strings, texts, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base detectors, sorted."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, 0, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# Gazetteers, fixed: what of each kind's data begins or ends with, and words that name it or name something else.
_TOP = frozenset("com org net edu gov io info biz de fr es it uk us nl ch at eu ru jp cn in br ca au".split())
_NAMING = (
    re.compile(r"e-?mail|contact|write|reach|mailto|correo|courriel", re.I),
    re.compile(r"\bips?\b|address|host|server|adresse", re.I),
    re.compile(r"card|visa|master|amex|credit|debit|karte|carte|tarjeta", re.I),
    re.compile(r"phone|call|tel|mobile|cell|fax|dial|whatsapp", re.I),
)
_OTHER = re.compile(r"order|invoice|isbn|issn|doi|version|serial|model|page|vol|figure|table|sku|item|example", re.I)
# Looser candidates: e-mail addresses in words or without a domain's end, IPv6, and digit runs of any grouping.
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]{2,63})+", re.I)
_BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?![A-Za-z0-9.-])")
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){3}(?![0-9.])")
_RUN = re.compile(r"(?<![A-Za-z0-9+])\(?[0-9](?:[ ().-]{0,2}[0-9]){8,18}(?![A-Za-z0-9])")
_AT = re.compile(r"[\[({]at[\])}]", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_JOINT = re.compile(r"@|[\[({]at[\])}]", re.I)
_GROUP = re.compile("[0-9]+")
#: Votes are 1 for, -1 against, 0 none.
LABELERS = ("pattern", "gazetteer", "context", "shape", "repeat")
FLOOR, AROUND = 0.5, 40
#: Most candidates of a kind and vote pattern that the span classifier learns from, and its number of features.
SAMPLE, WIDTH = 64, 1024


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of looser candidates, some of which may overlap; sorted."""
    out = []
    if _AT.search(text):
        out += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _BARE.finditer(text)]
    if ":" in text:
        out += [(m.start(), 1, m.end()) for m in _SIX.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _QUAD.finditer(text)]
        for m in _RUN.finditer(text):
            if not _QUAD.fullmatch(m[0]):
                out.append((m.start(), 2 if len(_NOT_DIGIT.sub("", m[0])) >= 13 else 3, m.end()))
    return sorted(set(out))


def _own_votes(kind: int, strict: bool, piece: str) -> tuple[int, int, int]:
    """What pattern, gazetteer and shape say of a span by itself."""
    digits = _NOT_DIGIT.sub("", piece)
    if kind == 0:
        domain = _JOINT.split(piece)[-1].strip().lower()
        end = domain.replace(" ", ".").replace("]", ".").replace(")", ".").replace("}", ".").rpartition(".")[2]
        form, listed = 0 if end != domain else -1, 1 if end in _TOP else 0 if end.isalpha() else -1
    elif kind == 1:
        parts = piece.split(".")
        form = -1 if len(parts) == 4 and any(int(p) > 255 for p in parts) else 0
        listed = -1 if piece.startswith(("0.", "127.", "10.", "192.168.", "255.")) else 1 if ":" in piece or len(piece) >= 10 else 0
    elif kind == 2:
        form, listed = 0 if luhn(digits) else -1, 1 if digits[0] in "3456" else -1
    else:
        form, listed = 0, 1 if strict or digits.startswith("00") else -1 if digits[0] in "01" else 0
    # One digit throughout, or digits that count up, are no number of anybody's; groups of a usual size speak for one.
    shape = 0
    if len(digits) > 5 and (len(set(digits)) <= 2 or digits in "01234567890123456789"):
        shape = -1
    elif kind >= 2:
        groups = _GROUP.findall(piece)
        shape = int({len(g) for g in groups[:-1]} == {4} if kind == 2 else 2 < len(groups) < 7 and len(groups[-1]) >= 2)
    return 1 if strict else form, listed, shape


def _features(kind: int, piece: str, left: str, right: str) -> list[int]:
    """Numbers of the features of a candidate: its form, and the words around it, each for its kind."""
    digits = _NOT_DIGIT.sub("", piece)
    form = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]", "0", piece)))
    before, behind = _WORD.findall(left.lower())[-4:], _WORD.findall(right.lower())[:2]
    own = [
        f"form={form[:40]}", f"size={len(digits)}", f"start={digits[:1]}", f"few={len(set(digits)) < 3}", f"check={kind == 2 and luhn(digits)}",
        f"large={kind == 1 and max(map(int, _GROUP.findall(piece))) > 255}", f"signs={''.join(sorted(set(re.sub('[A-Za-z0-9]', '', piece))))}",
        f"last={left[-1:]}", *(f"before={x}" for x in before), *(f"behind={x}" for x in behind)
    ]
    return [kind, *(4 + zlib.crc32(f"{kind}{x}".encode("utf-8", "surrogatepass")) % (WIDTH - 4) for x in own)]


Candidate = tuple[int, int, int, bool, tuple[int, ...], list[int] | None]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[Candidate]:
    """(start, kind, end, is base, votes, features) of base spans and of looser candidates that overlap none of them."""
    ends, top = [], 0
    for _, _, e in base:
        top = max(top, e)
        ends.append(top)
    starts = [s for s, _, _ in base]
    found = [(s, k, e, True) for s, k, e in base]
    for s, k, e in loose_spans(text):
        i = bisect_right(starts, e - 1)  # base spans that begin before this one's end
        if i == 0 or ends[i - 1] <= s:
            found.append((s, k, e, False))
    times = Counter(text[s:e] for s, _, e, _ in found)
    own: dict[tuple[int, bool, str], tuple[int, int, int]] = {}
    told: Counter = Counter()
    out = []
    for s, k, e, strict in found:
        piece, left, right = text[s:e], text[max(0, s - AROUND) : s], text[e : e + AROUND]
        if (k, strict, piece) not in own:
            own[k, strict, piece] = _own_votes(k, strict, piece)
        form, listed, shape = own[k, strict, piece]
        context = 1 if _NAMING[k].search(left) else -1 if _OTHER.search(left) else 0
        votes = (form, listed, context, shape, -1 if times[piece] > 5 else 0)
        told[k, votes] += 1
        # Base spans stay whatever the classifier says: only those that it may learn from need features.
        x = _features(k, piece, left, right) if not strict or told[k, votes] <= SAMPLE else None
        out.append((s, k, e, strict, votes, x))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, numbers and digest of base spans, and (s, k, e, votes, features) of all candidates.

    A table in the shared folder, small beside the texts: the texts are read once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("x", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n, digests, found = [], [], []
            for t in strings(b.column(1)):
                base = base_spans(t)
                held = Counter(k for _, k, _ in base)
                n.append([held[i] for i in range(len(KINDS))])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append([{"s": s, "k": k, "e": e, "base": own, "votes": packed(v), "x": x} for s, k, e, own, v, x in candidates(t, base)])
            cols = list(zip(*n, strict=True)) or [()] * len(KINDS)
            yield pa.record_batch(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.array(digests, pa.string()), pa.array(found, pa.list_(each))],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "found"]
            )

    schema = (
        f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS)
        + ", base_sha256 string, found array<struct<s:bigint,k:int,e:bigint,base:boolean,votes:int,x:array<int>>>"
    )
    return written(texts(docs).mapInArrow(run, schema), "pii")


def packed(votes: tuple[int, ...]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def unpacked(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


def reliabilities(votes: np.ndarray, kinds: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over counted patterns: (posterior of each pattern, P(vote | class) as [kind, labeler, class 0 or 1, vote + 1], rate of each kind).

    Abstaining is an outcome of its own, and a labeler is as reliable for each kind as that kind's candidates say. The
    start, which goes on to count as a fifth of a class's candidates (for the strict pattern as twice as many), says which
    class is which: for true candidates votes for are likelier than votes against.
    """
    m = votes.shape[1]
    start = np.tile(np.array([[0.45, 0.4, 0.15], [0.15, 0.4, 0.45]]), (m, 1, 1))
    start[0] = [[0.6, 0.38, 0.02], [0.02, 0.38, 0.6]]
    total, trust = np.bincount(kinds, n, len(KINDS)), np.array([2.0] + [0.2] * (m - 1))
    theta, rate = np.tile(start, (len(KINDS), 1, 1, 1)), np.full(len(KINDS), 0.5)
    hot = (votes[:, :, None] == np.arange(-1, 2)).astype(float)  # pattern, labeler, vote
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        like = np.einsum("pjv,pjcv->pc", hot, np.log(theta[kinds]))
        post = sigmoid(like[:, 1] - like[:, 0] + np.log(rate[kinds]) - np.log1p(-rate[kinds]))
        for c, share in enumerate((1 - post, post)):
            of_class = np.bincount(kinds, n * share, len(KINDS))
            held = (10 + np.outer(of_class, trust))[:, :, None] * start[:, c]
            np.add.at(held, kinds, (n * share)[:, None, None] * hot)
            theta[:, :, c] = held / held.sum(2, keepdims=True)
        rate = np.clip((np.bincount(kinds, n * post, len(KINDS)) + 1) / (total + 2), 0.01, 0.99)
    return post, theta, rate


def span_classifier(x: list[list[int]], target: np.ndarray, weight: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic classifier over sparse features, fitted to soft targets by Adam; the last is the bias."""
    w = np.zeros(WIDTH + 1)
    if not len(x):
        return w
    of, idx = np.repeat(np.arange(len(x)), [len(f) for f in x]), np.concatenate([np.asarray(f, np.int64) for f in x])
    weight = weight / weight.sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = weight * (sigmoid(np.bincount(of, w[idx], len(x)) + w[-1]) - target)
        grad = np.append(np.bincount(idx, g[of], WIDTH), g.sum()) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def probability(x: list[int], w: np.ndarray) -> float:
    return float(sigmoid(w[x].sum() + w[-1]))


def fit(found: DataFrame) -> np.ndarray:
    """The span classifier's weights, from counts of all candidates and a bounded sample of each kind and vote pattern."""
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    counts = each.groupBy("k", "votes").agg(F.count("*").alias("n")).orderBy("k", "votes").collect()  # at most 4 * 3^5 rows
    if not counts:
        return span_classifier([], np.empty(0), np.empty(0))
    kinds, n = np.array([r["k"] for r in counts]), np.array([r["n"] for r in counts], float)
    post = reliabilities(np.array([unpacked(r["votes"]) for r in counts]), kinds, n)[0]
    told = {(r["k"], r["votes"]): (p, c) for r, p, c in zip(counts, post, n, strict=True)}
    order = [F.xxhash64("doc_id", "s", "e", F.lit(41)), F.col("doc_id"), F.col("s"), F.col("e")]
    some = each.where("x IS NOT NULL").withColumn("rank", F.row_number().over(W.partitionBy("k", "votes").orderBy(*order))).where(F.col("rank") <= SAMPLE)
    rows = sorted((r["k"], r["votes"], r["x"]) for r in some.select("k", "votes", "x").collect())  # SAMPLE a pattern
    held = Counter((k, v) for k, v, _ in rows)
    # A pattern weighs by the logarithm of its count, so that rare ones are heard.
    weight = np.array([np.log1p(told[k, v][1]) / held[k, v] for k, v, _ in rows])
    return span_classifier([x for *_, x in rows], np.array([told[k, v][0] for k, v, _ in rows]), weight)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    found = scan(docs)
    w = fit(found)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            spans, added = [], []
            for row in b.column(6).to_pylist():
                base, more, busy = [], [], 0
                for c in row:
                    if c["base"]:
                        base.append((c["s"], c["k"], c["e"]))
                    elif c["s"] >= busy and probability(c["x"], w) > FLOOR:
                        more.append((c["s"], c["k"], c["e"]))
                        busy = c["e"]
                spans.append(joined(sorted([*base, *more])))
                added.append(len(more))
            yield pa.record_batch(
                [*(b.column(i) for i in range(6)), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                [*b.schema.names[:6], "spans", "n_added"]
            )

    return found.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
