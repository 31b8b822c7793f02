"""Record linkage: exact keys, prefixes, containment, word overlap and sequence similarity, and what links fill in."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import STOP_WORDS, jaccard, jaccard_stop, present, title_key, tokens
from lectern.sources.shared import kept

# Fixed values of the candidate searches; none of them decides what is found.
GRAM, RANKED = 21, 5_000
#: Pairs of blocks that titles are dealt into, and titles of a side in a block at most.
BLOCKS, MOST_IN_BLOCK = 200, 16_384
#: Most short titles that are broadcast, at 16 bytes each.
FEW = 500_000


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by order. max_by combines before its shuffle, unlike a window."""
    kept = F.struct(*(F.col(c) for c in rows.columns))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(kept, order).alias("_r")).select("_r.*")


def link_equal(papers: DataFrame, source: DataFrame, key: str, order: str, prefix: str) -> DataFrame:
    """papers left-joined with the source's last row of the same key; every paper stays once."""
    side = last_of_each(source, key, order).select(F.col(key), *(F.col(c).alias(prefix + c) for c in source.columns if c != key))
    return papers.join(side, key, "left")


def link_key_then_title(papers: DataFrame, source: DataFrame) -> DataFrame:
    """By doi_key, else by the title's first 50 characters: (paper_id, item_id, how)."""
    by_doi = last_of_each(source.where(present(F.col("doi_key"))), "doi_key", "item_id").select(F.col("doi_key"), F.col("item_id").alias("_d"))
    by_title = (
        last_of_each(source.withColumn("tk", title_key(F.col("title"))).where(present(F.col("tk"))), "tk", "item_id").select("tk", F.col("item_id").alias("_t"))
    )
    both = papers.withColumn("tk", title_key(F.col("title"))).join(by_doi, "doi_key", "left").join(by_title, "tk", "left")
    return both.select(
        "paper_id", F.coalesce("_d", "_t").alias("item_id"),
        F.when(F.col("_d").isNotNull(), "doi").when(F.col("_t").isNotNull(), "title").alias("how")
    )


def _titles(rows: DataFrame, name: str) -> DataFrame:
    """Distinct lower-cased titles: what is compared, so that copies of a title are compared once. Written, for the searches
    read them several times and making them may mean reading whole texts."""
    return kept(rows.where(present(F.col("title"))).select(F.lower("title").alias(name)).distinct(), "titles")


def _ranks(words: DataFrame) -> DataFrame:
    """(k, n) of the most frequent keys. Rarity only orders the keys of a title, so a bounded list loses no pair; keys that
    stand in one title alone, which most do, are left out before the list is made."""
    return F.broadcast(words.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "k").limit(RANKED))


def _rows_of(found: DataFrame, papers: DataFrame, source: DataFrame, *also: str) -> DataFrame:
    """Pairs of titles (t, u) as pairs of papers and items; of items alike in title and `also`, the first."""
    items = source.groupBy(F.lower("title").alias("u"), *(F.col(c).alias(f"item_{c}") for c in also)).agg(F.min("item_id").alias("item_id"))
    return papers.select("paper_id", F.lower("title").alias("t"), *also).join(found, "t").join(items, "u")


def best(pairs: DataFrame, score: str) -> DataFrame:
    """Per paper the candidate of the highest score; of equals the first item."""
    top = F.max_by(F.struct("item_id", F.col(score)), F.struct(F.col(score), -F.col("item_id")))
    return pairs.groupBy("paper_id").agg(top.alias("_b")).select("paper_id", "_b.item_id", f"_b.{score}")


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(size))))


def _hashed_grams(text: Column, *sizes: int) -> Column:
    return F.array_distinct(F.transform(F.flatten(F.array(*(_grams(text, k) for k in sizes))), lambda g: F.xxhash64(g)))


def held_in(needles: DataFrame, n: str, hay: DataFrame, h: str, few: int = FEW) -> DataFrame:
    """(n, h) with the first 50 characters of n in h.

    A needle of GRAM characters and more looks up its rarest gram, which every match holds; a shorter needle is a gram
    itself, among grams of the sizes that occur. What is joined are hashes of grams and of titles, and what two titles
    have in common is verified on them. Up to `few` short needles (a hash each) are broadcast.
    """
    first = kept(needles.select(n, F.substring(n, 1, 50).alias("first"), F.xxhash64(n).alias("_a")), "needles")
    marked = hay.select(h, F.xxhash64(h).alias("_b"))
    long, short = first.where(F.length("first") >= GRAM), first.where(F.length("first") < GRAM)
    held = marked.where(F.length(h) >= GRAM).select("_b", F.explode(_hashed_grams(F.col(h), GRAM)).alias("k"))
    each = long.select("_a", F.explode(_hashed_grams(F.col("first"), GRAM)).alias("k"))
    rarest = each.join(_ranks(held), "k", "left").groupBy("_a").agg(F.min_by("k", F.struct(F.coalesce("n", F.lit(0)), "k")).alias("k"))
    pairs = rarest.join(held, "k").select("_a", "_b")
    sizes = {r["size"]: r["n"] for r in short.groupBy(F.length("first").alias("size")).agg(F.count("*").alias("n")).collect()}
    if sizes:
        asked = short.select("_a", F.xxhash64("first").alias("k"))
        cut = marked.select("_b", F.explode(_hashed_grams(F.col(h), *sorted(sizes))).alias("k"))
        pairs = pairs.unionByName(cut.join(F.broadcast(asked) if sum(sizes.values()) <= few else asked, "k").select("_a", "_b"))
    return pairs.join(first, "_a").join(marked, "_b").where(F.col(h).contains(F.col("first"))).select(n, h).distinct()


def link_contains(papers: DataFrame, source: DataFrame) -> DataFrame:
    """Titles of over 20 characters of which one's first 50 stand in the other: the first item."""
    papers = papers.where(F.length("title") > 20)
    a, b = _titles(papers, "t"), _titles(source, "u")
    found = held_in(a, "t", b, "u").unionByName(held_in(b, "u", a, "t")).distinct()
    return _rows_of(found, papers, source).groupBy("paper_id").agg(F.min("item_id").alias("item_id"))


def overlapping(a: DataFrame, b: DataFrame, words: Callable[[Column], Column], floor: float) -> DataFrame:
    """(t, u) that can have a word overlap of floor or more: by prefix filtering, in which titles of that overlap share one
    of their rarest words, size - ceil(floor * size) + 1 of them. Titles without words meet their equals."""
    least = floor - 1e-6

    def side(titles: DataFrame, t: str) -> DataFrame:
        return titles.select(t, words(F.col(t)).alias("w"))

    left, right = side(a, "t"), side(b, "u")
    ranks = _ranks(left.select(F.explode("w").alias("k")).unionAll(right.select(F.explode("w").alias("k"))))

    def keyed(rows: DataFrame, t: str) -> DataFrame:
        each = (
            rows.select(t, F.explode("w").alias("k")).join(ranks, "k", "left").groupBy(t)
                .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k"))).alias("w"))
        )
        size = F.size("w")
        some = each.select(t, size.alias(f"size_{t}"), F.explode(F.slice("w", F.lit(1), size - F.ceil(size * least).cast("int") + 1)["k"]).alias("k"))
        return some.unionByName(rows.where(F.size("w") == 0).select(t, F.lit(0).alias(f"size_{t}"), F.concat(F.lit("\0"), t).alias("k")))

    near = (F.col("size_t") >= F.col("size_u") * least) & (F.col("size_u") >= F.col("size_t") * least)
    return keyed(left, "t").join(keyed(right, "u"), "k").where(near).select("t", "u").distinct()


def link_jaccard_stop(papers: DataFrame, source: DataFrame, floor: float = 0.85) -> DataFrame:
    near = overlapping(_titles(papers, "t"), _titles(source, "u"), lambda c: F.array_except(tokens(c), F.array(*map(F.lit, STOP_WORDS))), floor)
    found = near.withColumn("score", F.round(jaccard_stop(F.col("t"), F.col("u")), 6)).where(F.col("score") >= floor)
    return best(_rows_of(found, papers, source), "score")


def link_jaccard_author(papers: DataFrame, source: DataFrame, floor: float = 0.7) -> DataFrame:
    """Word overlap of at least floor, and 0.2 more where an author of one side is part of one of the other."""
    near = overlapping(_titles(papers, "t"), _titles(source, "u"), tokens, floor)
    found = near.withColumn("o", jaccard(tokens(F.col("t")), tokens(F.col("u")))).where(F.col("o") >= floor)
    known = F.exists("authors", lambda x: F.exists(F.col("item_authors"), lambda y: F.lower(x).contains(F.lower(y)) | F.lower(y).contains(F.lower(x))))
    return best(_rows_of(found, papers, source, "authors").withColumn("score", F.round(F.col("o") + F.when(known, 0.2).otherwise(0.0), 6)), "score")


def alike(a: DataFrame, b: DataFrame, bonus: float) -> DataFrame:
    """(t, u, ratio): difflib's ratio of the pairs that can be a title's best. a: t, least, years; b: u, years (sets, as bits).

    A pair can be one if its ratio, with the bonus where years meet, is `least` of t or more, and no smaller than a ratio
    found for t. All titles meet, block by block. Matched blocks are a common subsequence, so two bounds come first: the
    characters that both hold, for a whole block in one matrix product, and the longest common subsequence, by bits of many
    pairs at once. Rare characters share places in both, which only raises them.
    """
    own, rest, deep, most, part, chunk = 40, 8, 32, 512, 512, 16_384

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        import numpy as np

        def points(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Code points of all titles, and of each its row, its place and, by row, the lengths."""
            size = np.array([len(x) for x in titles])
            row = np.repeat(np.arange(len(titles)), size)
            return np.frombuffer("".join(titles).encode("utf-32-le"), "<u4"), row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), size

        def coded(at: np.ndarray, kinds: np.ndarray, often: np.ndarray, n: int, shared: int) -> np.ndarray:
            """Numbers below n for the most frequent characters; the others share the next ones."""
            code = n + kinds % shared
            first = often[:n]
            code[first] = np.arange(len(first))
            return code[at]

        def ratio(m: SequenceMatcher, t: str, u: str, need: float) -> float:
            """difflib's ratio, or 0 as soon as what is left cannot give `need`."""
            m.set_seq1(t)
            todo, got, left_over, total = [(0, len(t), 0, len(u))], 0, min(len(t), len(u)), len(t) + len(u)
            while todo:
                i, j, k, n = todo.pop()
                x, y, size = m.find_longest_match(i, j, k, n)
                left_over -= min(j - i, n - k)
                if size:
                    got += size
                    for s in ((i, x, k, y), (x + size, j, y + size, n)):
                        if s[0] < s[1] and s[2] < s[3]:
                            todo.append(s)
                            left_over += min(s[1] - s[0], s[3] - s[2])
                if 2 * (got + left_over) < need * total:
                    return 0.0
            return 2.0 * got / total

        left, right = (x.iloc[np.argsort(x[k].str.len().to_numpy(), kind="stable")] for x, k in ((left, "t"), (right, "u")))
        t, u = left["t"].tolist(), right["u"].tolist()
        if not t or not u:
            return pd.DataFrame({"t": [], "u": [], "ratio": []}).astype({"t": str, "u": str, "ratio": float})
        least, years, item_years = left["least"].to_numpy(), left["years"].to_numpy(), right["years"].to_numpy()
        (pa_, ra, xa, la), (pb, rb, xb, lb) = points(t), points(u)
        kinds, at, count = np.unique(np.concatenate([pa_, pb]), return_inverse=True, return_counts=True)
        often = np.argsort(-count, kind="stable")
        few = coded(at, kinds.astype(np.int64), often, own, rest)
        wide = coded(at, kinds.astype(np.int64), often, 200, 55)

        def counts(code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
            return np.bincount(row * (own + rest) + code, minlength=n * (own + rest)).reshape(n, own + rest)

        ca, cb = counts(few[: len(ra)], ra, len(t)), counts(few[len(ra):], rb, len(u))
        depth = np.minimum(np.minimum(ca.max(0), cb.max(0)), deep)
        over_a, over_b = np.maximum(ca - deep, 0).sum(1).astype("f4"), np.maximum(cb - deep, 0).sum(1).astype("f4")
        has = lambda c: np.concatenate([c[:, [k]] > np.arange(n) for k, n in enumerate(depth)], 1).astype("f4")
        bits = lambda y: ((y[:, None] >> np.arange(63)) & 1).astype("f4")
        share = bonus / 2 * bits(years)
        one = np.ones((len(u), 1), "f4")
        # The product is the characters in common, less half of what the ratio asks of both lengths, which meeting years lower.
        va = np.concatenate([has(ca), -least[:, None] / 2 * la[:, None], -least[:, None] / 2, share * la[:, None], share], 1).astype("f4")
        vb = np.concatenate([has(cb), one, lb[:, None] * one, bits(item_years), lb[:, None] * bits(item_years)], 1).astype("f4").T
        places = np.full((len(u), int(min(lb.max(), most))), 255, np.uint8)
        inside = xb < most
        places[rb[inside], xb[inside]] = wide[len(ra):][inside]
        out: list[tuple[str, str, float]] = []
        known: dict[int, SequenceMatcher] = {}

        def longest(ia: np.ndarray, ib: np.ndarray, lo: int, masks: list[np.ndarray]) -> np.ndarray:
            """Lengths of longest common subsequences: a zero bit is a matched place. Place 255 pads, and matches nothing."""
            base, steps = (ia - lo) * 256, np.ascontiguousarray(places[ib, : int(lb[ib].max())].T)
            v = [np.full(len(ia), ~np.uint64(0)) for _ in masks]
            for step in steps:
                at_ = base + step
                carry = None
                for w, mask in enumerate(masks):
                    x = v[w] & mask[at_]
                    total = v[w] + x
                    if len(masks) > 1:
                        up = total < x
                        if carry is not None:
                            total += carry
                            up |= total < carry
                        carry = up.astype(np.uint64)
                    v[w] = total | (v[w] & ~x)
            return sum(64 - np.bitwise_count(x).astype(np.int64) for x in v)

        for lo in range(0, len(t), part):
            hi = min(lo + part, len(t))
            r = max(float(least[lo:hi].min()) - bonus, 1e-9)
            b0, b1 = np.searchsorted(lb, [la[lo] * r / (2 - r) - 1, la[hi - 1] * (2 - r) / r + 1])
            if b0 == b1:
                continue
            product = va[lo:hi] @ vb[:, b0:b1]
            if over_a[lo:hi].any() and over_b[b0:b1].any():
                product += np.minimum.outer(over_a[lo:hi], over_b[b0:b1])
            flat = np.flatnonzero(product > -0.01 - 1e-5 * (la[hi - 1] + lb[b1 - 1]))
            ia, ib = flat // (b1 - b0) + lo, flat % (b1 - b0) + b0
            words = int(min(la[hi - 1], most) + 63) // 64
            masks = [np.zeros((hi - lo) * 256, np.uint64) for _ in range(words)]
            here = (ra >= lo) & (ra < hi) & (xa < most)
            for w, mask in enumerate(masks):
                at_w = here & (xa // 64 == w)
                np.bitwise_or.at(mask, (ra[at_w] - lo) * 256 + wide[: len(ra)][at_w], np.uint64(1) << (xa[at_w] % 64).astype(np.uint64))
            near: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for k in range(0, len(ia), chunk):
                x, y = ia[k : k + chunk], ib[k : k + chunk]
                total = la[x] + lb[y]
                common = np.minimum(la[x], lb[y])
                short = (la[x] <= most) & (lb[y] <= most)
                if short.any():
                    common[short] = longest(x[short], y[short], lo, masks)
                more = np.where((years[x] & item_years[y]) != 0, bonus, 0.0)
                can = 2 * common >= (least[x] - more) * total
                near.append((x[can], y[can], (2 * common / total + more)[can], more[can]))
            if not near:
                continue
            x, y, bound, more = (np.concatenate(z) for z in zip(*near, strict=True))
            best: dict[int, float] = {}
            for k in np.lexsort((-bound, x)).tolist():
                i, j = int(x[k]), int(y[k])
                need = max(float(least[i]), best.get(i, 0.0) - 2e-6) - float(more[k])
                if bound[k] - more[k] < need:
                    continue
                if j not in known:
                    if len(known) >= 2_000:
                        known.clear()
                    known[j] = SequenceMatcher(None, "", u[j])
                got = ratio(known[j], t[i], u[j], need)
                if got >= need:
                    out.append((t[i], u[j], got))
                    best[i] = max(best.get(i, 0.0), got)
        return pd.DataFrame(out, columns=["t", "u", "ratio"]).astype({"t": str, "u": str, "ratio": float})

    n, m = a.count(), b.count()
    block = min(MOST_IN_BLOCK, max(1_024, math.isqrt(n * m // BLOCKS)))
    i, j = -(-n // block) or 1, -(-m // block) or 1
    dealt = lambda name, k: F.pmod(F.xxhash64(name), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.array(*map(F.lit, range(k)))) if k <= 1_000 else F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = a.select("*", dealt("t", i).alias("i"), each(j).alias("j")).repartition(i * j, "i", "j")
    right = b.select("*", dealt("u", j).alias("j"), each(i).alias("i")).repartition(i * j, "i", "j")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(search, "t string, u string, ratio double")


def link_seqratio(papers: DataFrame, source: DataFrame, floor: float = 0.8) -> DataFrame:
    """Sequence similarity of lower-cased titles, and 0.1 more for equal years.

    A title that the source has too scores 1 at least, so it looks for equal years and a ratio of 0.9 alone.
    """
    bonus = 0.1
    bucket = "CASE WHEN year IS NOT NULL THEN shiftleft(1L, CAST(pmod(coalesce(try_cast(year AS BIGINT), xxhash64(year)), 63) AS INT)) END"

    def titles(rows: DataFrame, name: str) -> DataFrame:
        of = rows.where(present(F.col("title"))).groupBy(F.lower("title").alias(name))
        return of.agg(F.coalesce(F.bit_or(F.expr(bucket)), F.lit(0)).cast("long").alias("years"))

    b = kept(titles(source, "u"), "titles")
    equal = b.select(F.col("u").alias("t"), F.lit(True).alias("equal"))
    least = F.when(F.col("equal"), F.lit(max(1.0, floor))).otherwise(F.lit(float(floor))) - 1e-6
    a = kept(titles(papers, "t").join(equal, "t", "left").select("t", "years", least.alias("least")), "titles")
    found = alike(a, b, bonus)
    same = F.when(F.col("year") == F.col("item_year"), bonus).otherwise(0.0)
    scored = _rows_of(found, papers, source, "year").withColumn("score", F.round(F.col("ratio") + same, 6))
    return best(scored.where(F.col("score") >= floor), "score")


def fill_missing(linked: DataFrame, fields: dict[str, str], count: str = "n_filled") -> DataFrame:
    """fields: what to fill -> the column to fill it from. Adds provenance (filled) and the number of filled fields."""
    news = {f: ~present(F.col(f).cast("string")) & present(F.col(s).cast("string")) for f, s in fields.items()}
    filled = F.array_compact(F.array(*(F.when(n, F.lit(f)) for f, n in news.items())))
    out = linked.withColumn("filled", filled).withColumn(count, F.size("filled"))
    return out.withColumns({f: F.when(news[f], F.col(s)).otherwise(F.col(f)) for f, s in fields.items()})


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def rank_first(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


# What a paper must have to be complete, and what is always taken anew.
CRITICAL = ("title", "doi", "year", "authors", "abstract")
METRICS = ("citation_count", "influential_citation_count")


def already_complete(tests: dict[str, Column]) -> Column:
    """Whether every critical field is there: such papers pass through without a lookup."""
    out = F.lit(True)
    for test in tests.values():
        out = out & F.coalesce(test, F.lit(False))
    return out


def refresh(linked: DataFrame, fields: dict[str, str], metrics: dict[str, str], found: Column) -> DataFrame:
    """Fills missing fields as fill_missing does, and takes metrics anew whenever the source has them, as they change.

    Adds n_filled, and status: found or not_found.
    """
    out = fill_missing(linked, fields)
    out = out.withColumns({m: F.coalesce(F.col(s), F.col(m)) if m in linked.columns else F.col(s) for m, s in metrics.items()})
    return out.withColumn("status", F.when(found, "found").otherwise("not_found"))


def stamped(rows: DataFrame, source: str, at: Column, filled: Column) -> DataFrame:
    """rows with provenance: a struct of source, time, fields and their number."""
    return rows.withColumn("provenance", F.struct(F.lit(source).alias("source"), at.alias("at"), filled.alias("fields"), F.size(filled).alias("n_fields")))


def prefixed(rows: DataFrame, payload: str, prefix: str) -> DataFrame:
    """rows with the payload's fields as columns of their own name behind a prefix; null payloads give nulls."""
    names = rows.select(f"{payload}.*").columns
    return rows.select(*(c for c in rows.columns if c != payload), *(F.col(f"{payload}.{n}").alias(prefix + n) for n in names))


def distinct_titles(papers: DataFrame, floor: float = 0.95) -> DataFrame:
    """papers without those whose DOI or title an earlier paper (by doc_id) has: DOIs equal, titles of a word overlap above floor.

    Candidates come from prefix filtering, which loses no pair; copies of a title are compared once, by their first paper.
    """
    first = papers.where(present(F.col("title"))).groupBy(F.lower("title").alias("t")).agg(F.min("doc_id").alias("_id"))
    titles = first.select("t")
    near = overlapping(titles, titles.select(F.col("t").alias("u")), tokens, floor).where("t <> u")
    near = near.where(jaccard(tokens(F.col("t")), tokens(F.col("u"))) > floor)
    of_near = near.join(first.select(F.col("t").alias("u"), F.col("_id").alias("_other")), "u").groupBy("t").agg(F.min("_other").alias("_near"))
    earliest = first.join(of_near, "t", "left").select("t", F.least("_id", "_near").alias("_by_title"))
    by_doi = papers.where(present(F.col("doi"))).groupBy("doi").agg(F.min("doc_id").alias("_by_doi"))
    rows = papers.withColumn("t", F.lower("title")).join(earliest, "t", "left").join(by_doi, "doi", "left")
    kept = (F.coalesce("_by_title", "doc_id") >= F.col("doc_id")) & (F.coalesce("_by_doi", "doc_id") >= F.col("doc_id"))
    return rows.where(kept).select(*papers.columns)
