"""DuckDB SQL for the corpus operators that SQL can express in full.

The others hold a trained model (op1, op3, op9), a seeded choice (op4), a tokenizer (op5), XXH64 (op6) or an index with
less than certain recall (op8).
"""

from __future__ import annotations

from lectern.llm import decontam, line_dedup, secret_scan

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def line_dedup_sql(least: int = line_dedup.LEAST_DOCS, points: int = line_dedup.LEAST_POINTS) -> str:
    blank = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    return f"""
WITH whole AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM whole),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {blank})")} AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT key, r, doc_id FROM keyed WHERE length(key) >= {points}) GROUP BY key HAVING count(*) >=
    {least}),
judged AS (SELECT keyed.*, frequent.key IS NOT NULL AND keyed.doc_id IS DISTINCT FROM frequent.last AS gone FROM keyed LEFT JOIN frequent ON keyed.key
    = frequent.key)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (
  SELECT r, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i)
    FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY r)"""


def decontamination_sql(window: int = decontam.WINDOW) -> str:
    words = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM documents),
terms AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM docs),
places AS (SELECT r, p, list(term) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS ahead FROM terms),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
of_items AS (SELECT item, unnest(w) AS term, generate_subscripts(w, 1) AS p, len(w) AS n, w FROM items),
item_places AS (SELECT item, n, p, list(term) OVER (PARTITION BY item, w ORDER BY p ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS ahead FROM
    of_items),
windows AS (SELECT DISTINCT item, least(n, {window}) AS n, array_to_string(ahead, ' ') AS gram FROM item_places WHERE len(ahead) = least(n,
    {window})),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT r, p, n, array_to_string(ahead[1:n], ' ') AS gram FROM places, sizes WHERE len(ahead) >= n),
matched AS (SELECT r, p, n, item FROM grams JOIN windows USING (n, gram)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM matched)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS held FROM (SELECT DISTINCT r, item FROM matched) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(held, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)"""


def secrets_sql(spread: int = secret_scan.SPREAD) -> str:
    def kind(k: int, pattern: str, group: int, least: int) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return f"""
SELECT r, {k} AS k, s, s + length(hit) AS e, value FROM (
  SELECT r, hit, value, sum(length(piece)) OVER before + coalesce(sum(length(hit)) OVER (before ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS s
  FROM (SELECT r, unnest(pieces) AS piece, unnest(hits) AS hit, unnest(vals) AS value, generate_subscripts(pieces, 1) AS i
        FROM (SELECT r, string_split_regex(t, {p}) AS pieces, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {group}) AS vals FROM
    docs WHERE regexp_matches(t, {p})))
  WINDOW before AS (PARTITION BY r ORDER BY i))
WHERE hit IS NOT NULL AND length(value) >= {least}"""

    every = [kind(k, *x[1:]) for k, x in enumerate(secret_scan.BASE + secret_scan.MORE)]
    n = len(secret_scan.BASE)
    names = "[" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "]"
    label = f"{names}[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE k = {k}), 0) AS n_{x[0]}" for k, x in enumerate(secret_scan.BASE))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1) || 'null') AS owner, concat_ws('/', source, lang) AS repository,
    coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(every[:n])}),
more AS ({" UNION ALL ".join(every[n:])}),
owned AS (SELECT value, count(DISTINCT owner) < {spread} OR count(DISTINCT repository) < {spread} AS live FROM (SELECT * FROM base UNION ALL SELECT *
    FROM more) JOIN docs USING (r) GROUP BY value),
judged AS (SELECT more.*, live FROM more JOIN owned USING (value)),
base_judged AS (SELECT base.*, live FROM base JOIN owned USING (value)),
clear AS (SELECT r, k, s, e FROM judged WHERE live AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = judged.r AND base.s < judged.e AND judged.s <
    base.e)),
by_base AS (SELECT r, {counts}, string_agg({label}, ',' ORDER BY s, k) AS held, count(*) FILTER (WHERE live) AS n_base_live, count(*) FILTER (WHERE
    NOT live) AS n_base_example,
  string_agg({label}, ',' ORDER BY s, k) FILTER (WHERE live) AS base_live, string_agg({label}, ',' ORDER BY s, k) FILTER (WHERE NOT live) AS
    base_example FROM base_judged GROUP BY r),
by_all AS (SELECT r, string_agg({label}, ',' ORDER BY s, k, e) AS held FROM (SELECT r, k, s, e FROM base UNION ALL SELECT * FROM clear) GROUP BY r),
lives AS (SELECT r, count(*) AS n_live FROM clear GROUP BY r),
examples AS (SELECT r, count(*) FILTER (WHERE NOT live) AS n_example FROM judged GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x[0]}, 0) AS n_{x[0]}" for x in secret_scan.BASE)}, sha256(coalesce(by_base.held, '')) AS base_sha256,
    coalesce(by_all.held, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_base_live, 0) AS n_base_live, coalesce(n_base_example, 0) AS
    n_base_example,
  coalesce(base_live, '') AS base_live_spans, coalesce(base_example, '') AS base_example_spans
FROM docs LEFT JOIN by_base USING (r) LEFT JOIN by_all USING (r) LEFT JOIN lives USING (r) LEFT JOIN examples USING (r)"""


ORACLES = {"op2_line_dedup": line_dedup_sql(), "op7_decontamination": decontamination_sql(), "op10_secrets": secrets_sql()}
