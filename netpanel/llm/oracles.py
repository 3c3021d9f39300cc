"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from netpanel.llm.queries import BLOCK_CHARS, PARTS

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE_HEX = "('0x' || substr(sha, {at}, 5))::BIGINT"
_DIGEST = " || ".join(f"substr('{_BASE32}', CAST(({_FIVE_HEX.format(at=5 * g + 1)} >> {15 - 5 * k}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for k in range(4))

OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, html, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
s AS (SELECT p.doc_id AS doc_id, p, w[p] AS word, CASE WHEN p + 19 <= len(w) THEN array_to_string(list_slice(w, p, p + 19), ' ') END AS grams FROM p JOIN d ON d.doc_id = p.doc_id),
f AS (SELECT grams, min({'d': doc_id, 'p': p}) AS first FROM s WHERE grams IS NOT NULL GROUP BY 1),
r AS (SELECT s.doc_id AS doc_id, p, word, CASE WHEN s.grams IS NOT NULL AND (f.first.d <> s.doc_id OR f.first.p <> s.p) THEN 1 ELSE 0 END AS again FROM s LEFT JOIN f ON f.grams = s.grams),
c AS (SELECT doc_id, p, word, max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
g AS (SELECT doc_id, sum(gone) AS n, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY p) AS kept FROM c GROUP BY 1)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""

_PARTS = " ".join(f"WHEN '+{s}' THEN {a}" for s, a in PARTS.items())
OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS s, CAST(greatest(length(coalesce(text, '')), 1) AS BIGINT) AS n, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY s ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - n AS pos FROM d),
src AS (SELECT s, CASE s {_PARTS} ELSE 1 END AS a, CAST(sum(n) AS BIGINT) AS chars FROM d GROUP BY s),
r AS (SELECT s, a, ((chars - 1) // {BLOCK_CHARS} + a) // a AS rounds FROM src),
ends AS (SELECT DISTINCT rounds AS e FROM r),
spans AS (SELECT e, coalesce(lag(e) OVER (ORDER BY e), 0) AS b FROM ends),
phases AS (SELECT e, spans.b AS b, CAST(sum(a) AS BIGINT) AS h, list(a ORDER BY s) AS parts, list(s ORDER BY s) AS names FROM spans JOIN r ON rounds >= e GROUP BY 1, 2),
based AS (SELECT *, CAST(coalesce(sum(h * (e - b)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM phases),
run(e, t, c, pick) AS (
  SELECT e, CAST(-1 AS BIGINT), list_transform(parts, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM phases
  UNION ALL
  SELECT e, t + 1, list_transform(c, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), best FROM (
    SELECT run.e AS e, t, c, list_min(list_filter(list_transform(generate_series(1, len(parts)), lambda i: CASE WHEN c[i] < parts[i] AND (c[i] * h) // parts[i] <= t + 1 THEN {{'d': ((c[i] + 1) * h + parts[i] - 1) // parts[i], 'i': i}} END), lambda x: x IS NOT NULL)).i AS best
    FROM run JOIN phases ON phases.e = run.e WHERE t + 1 < h)),
turns AS (SELECT run.e AS e, base, based.b AS b, h, t, names[pick] AS s, row_number() OVER (PARTITION BY run.e, pick ORDER BY t) - 1 AS place FROM run JOIN based ON based.e = run.e WHERE t >= 0)
SELECT doc_id, source, pos // {BLOCK_CHARS} AS block, (pos // {BLOCK_CHARS}) // a AS round, base + ((pos // {BLOCK_CHARS}) // a - turns.b) * turns.h + t AS slot, pos % {BLOCK_CHARS} AS rank
FROM b JOIN r ON r.s = b.s JOIN turns ON turns.s = b.s AND place = (pos // {BLOCK_CHARS}) % a AND (pos // {BLOCK_CHARS}) // a >= turns.b AND (pos // {BLOCK_CHARS}) // a < turns.e"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4, "op6_substrings": OP6, "op8_source_mixing": OP8}
