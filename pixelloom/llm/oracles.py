"""DuckDB SQL of what SQL can express: near copies as a whole, and the parts of other queries that no learned model, container or
tokenizer has a share in (queries mix_targets, lm_base and pii_base). The others are tested against brute force in tests/llm."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_SIZE = f"CAST(len({_WORDS.format(text='''coalesce(text,'')''')}) AS BIGINT)"
#: crc32 of the digits of doc_id, a bit at a time.
_BIT = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT))), lambda c, b: {_BIT}), 4294967295)"

NEAR_COPIES = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
x AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS m FROM reached GROUP BY a) ON a = doc_id
"""

MIX_TARGETS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, {_SIZE} AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
v AS (SELECT *, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
c AS (SELECT *, 2.0e0 * n / w AS full_at, sum(2.0e0 * n) OVER o - 2.0e0 * n AS given, sum(w) OVER () - sum(w) OVER o + w AS left_w, 1.5e0 * sum(n) OVER () AS total FROM v WHERE n > 0
  WINDOW o AS (ORDER BY 2.0e0 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, (total - given) / left_w AS unit FROM c),
f AS (SELECT min(unit) AS unit FROM (SELECT unit FROM u WHERE unit <= full_at ORDER BY full_at LIMIT 1)),
t AS (SELECT source, n, CASE WHEN full_at < f.unit THEN 2.0e0 * n ELSE w * f.unit END AS target FROM u, f UNION ALL SELECT source, n, 0.0e0 FROM v WHERE n = 0)
SELECT doc_id, size, n AS source_size, round(target, 6) + 0.0e0 AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

LM_BASE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, ({_CRC}) % 7 = 2 AS held_out, list_append({_WORDS.format(text=_LOWER)}, chr(10)) AS ts FROM documents),
t AS MATERIALIZED (SELECT doc_id, held_out, unnest(ts) AS w FROM d),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
z AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(c.c) AS BIGINT) AS n_known, any_value(z.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (z.n + z.v + 1)::DOUBLE)), 6) + 0.0e0 AS base_score
FROM t LEFT JOIN c ON t.w = c.w, z GROUP BY doc_id, held_out
"""

_DIGITS = "regexp_replace(m.v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), CAST(i AS INT), 1) AS INT) ELSE (CAST(substr(reverse({_DIGITS}), CAST(i AS INT), 1) AS INT) * 2) // 10 + (CAST(substr(reverse({_DIGITS}), CAST(i AS INT), 1) AS INT) * 2) % 10 END)) % 10 = 0"
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m.v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}


def _found(rank: int, kind: str) -> str:
    """doc_id, rank, kind, start, end of a kind's good matches: places from the lengths of gaps and matches before."""
    pattern, good = _KINDS[kind]
    ms, gs = f"regexp_extract_all(t, '{pattern}', 0)", f"string_split_regex(t, '{pattern}')"
    at = "list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0)"
    rows = f"SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{'v': ms[i], 's': {at}}})) AS m FROM (SELECT doc_id, {ms} AS ms, {gs} AS gs FROM d)"
    return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, CAST(m.s AS BIGINT) AS s, CAST(m.s + length(m.v) AS BIGINT) AS e FROM ({rows}) WHERE {good}"


PII_BASE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED ({' UNION ALL '.join(_found(i, k) for i, k in enumerate(_KINDS))})
SELECT d.doc_id, {', '.join(f"CAST(coalesce(count_if(kind = '{k}'), 0) AS BIGINT) AS n_{k}" for k in _KINDS)}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '')) AS base_sha256 FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""

SQL: dict[str, str] = {"op7_parity_sketch_join": NEAR_COPIES, "mix_targets": MIX_TARGETS, "lm_base": LM_BASE, "pii_base": PII_BASE}
