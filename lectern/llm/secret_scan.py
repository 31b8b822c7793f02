"""Secrets with corpus-wide ownership frequency, in DataFrame functions only.

Every candidate's hash is aggregated by the distinct owners and the distinct repositories that hold it: one that
`spread` or more owners and `spread` or more repositories share is a widely copied example, and any other looks live.
Base detectors (assign, access, hex) follow fixed patterns; their spans always stay, and columns of their own say which
of them are live and which are examples. Further candidates (tokens with well-known prefixes, JSON web tokens, private
key headers, bearer values) are findings only if they are live.

Texts are read once: positions and hashes of what matched go to a written table, and only rows with candidates take
part in the aggregation, whose counts combine before the shuffle. Positions come from the lengths of the pieces between
matches and of the matches.

Defined results: a null or empty text has no spans. Very long texts are searched whole. Repeated rows, and rows with a
null doc_id, have results of their own; they add no owner and no repository. A null source is an owner of its own, and a
repository by lang alone. Spans of equal start go by kind, then end. An empty table gives no rows. Other columns are
ignored, whatever their names. Offsets are code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    ("vendor", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|sk-|AIza|glpat-)[A-Za-z0-9_-]{16,}", 0, 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 24),
    ("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s[A-Za-z0-9+/=]{16,}", 0, 24),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 24),
)
#: What a text must contain for a pattern to match at all, tested before it; assign's words in either case.
NEEDS = {
    "assign": ("passw", "secret", "token", "api"), "access": ("AKIA",),
    "vendor": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "sk-", "AIza", "glpat-"),
    "jwt": ("eyJ",), "private": ("-----BEGIN ",), "bearer": ("earer ",),
}
KINDS = tuple(x[0] for x in BASE + MORE)
SPREAD = 3


def _found(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, k, e, h>> of the pattern's matches whose group has `least` characters or more."""
    kind = "array<struct<s:bigint,k:int,e:bigint,h:bigint>>"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.transform(hits, lambda x: F.regexp_extract(x, pattern, group)) if group else hits
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    each = F.arrays_zip(gaps.alias("gap"), F.transform(hits, lambda x: F.length(x).cast("long")).alias("size"), values.alias("value"))
    # The piece behind the last match has no match of its own.
    each = F.filter(each, lambda x: x["size"].isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        own = F.struct(s.alias("s"), F.lit(number).alias("k"), (s + x["size"]).alias("e"), F.xxhash64(x["value"]).alias("h"))
        return (
            F.struct(
                (s + x["size"]).alias("at"),
                F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out")
            )
        )

    spans = F.aggregate(each, start, step, lambda acc: acc["out"])
    held = F.lower(text) if KINDS[number] == "assign" else text
    needs = [held.contains(x) for x in NEEDS.get(KINDS[number], ())]
    test = reduce(Column.__or__, needs) & text.rlike(pattern) if needs else text.rlike(pattern)
    return F.when(test, spans).otherwise(F.array().cast(kind))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """(h, owners, repositories) from (h, owner, repository): each distinct first, so a hot candidate is combined early."""
    held = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("by")) for k, c in enumerate(("owner", "repository"))))
    each = candidates.select("h", F.inline(held)).groupBy("h", "k", "by").agg(F.lit(1).alias("_"))
    return each.groupBy("h").agg(F.count_if(F.col("k") == 0).alias("owners"), F.count_if(F.col("k") == 1).alias("repositories"))


def find_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, then the verdict on base candidates:
    n_base_live, n_base_example, base_live_spans, base_example_spans.

    owner and repository default to source, and source and lang: what in this table stands for them.
    """
    owner = F.coalesce(F.col("source"), F.lit("\x00null")) if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), owner.alias("owner"), repository.alias("repository"))
    found = base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository",
        *(_found(F.col("text"), i, p, g, n).alias(k) for i, (k, p, g, n) in enumerate(BASE)),
        F.array_sort(F.concat(*(_found(F.col("text"), i + len(BASE), p, g, n) for i, (_, p, g, n) in enumerate(MORE)))).alias("more"),
    )
    found = written(found.withColumn("base", F.array_sort(F.concat(*(F.col(k) for k, *_ in BASE)))), "secrets")
    asked = found.select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("m")).withColumn("h", F.col("m.h"))
    # Only the examples are joined back. Written, so that their size picks the join and a hot candidate's rows can be split.
    copied = (F.col("owners") >= spread) & (F.col("repositories") >= spread)
    examples = written(ownership(asked.select("h", "owner", "repository")).where(copied).select("h", F.lit(True).alias("example")), "examples")
    of_base, example = F.col("m.k") < len(BASE), F.col("example").isNotNull()
    some = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("m"))))
    judged = asked.join(examples, "h", "left").groupBy("row").agg(
        some(~of_base & ~example).alias("live"), F.count_if(~of_base & example).alias("n_example"), some(of_base & ~example).alias("base_live"),
        some(of_base & example).alias("base_example")
    )
    rows = found.join(judged, "row", "left")
    live, base_live, base_example = (F.coalesce(k, F.array().cast(found.schema["base"].dataType)) for k in ("live", "base_live", "base_example"))
    clear = F.filter(live, lambda m: ~F.exists(F.col("base"), lambda x: (x["s"] < m["e"]) & (m["s"] < x["e"])))
    return rows.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(F.col("base"), clear))).alias("spans"), F.size(clear).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.size(base_live).cast("long").alias("n_base_live"), F.size(base_example).cast("long").alias("n_base_example"),
        _joined(base_live).alias("base_live_spans"), _joined(base_example).alias("base_example_spans"),
    )
