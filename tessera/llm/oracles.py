"""SQL for DuckDB of those queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, BARE = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_-]{12,}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lengths(items: str) -> str:
    return f"COALESCE(list_sum(list_transform({items}, lambda z: length(z))), 0)"


def _places(kind: int, pattern: str, group: int, least: int) -> str:
    """``doc_id, kind, start, "end", value`` of a pattern's matches whose value is long enough."""
    return f"""SELECT doc_id, {kind} AS kind, ({_lengths('g[1:i]')} + {_lengths('m[1:i-1]')})::BIGINT AS start, ({_lengths('g[1:i]')} + {_lengths('m[1:i]')})::BIGINT AS "end", v[i] AS value
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {_q(pattern)}, 0) AS m, regexp_extract_all(text, {_q(pattern)}, {group}) AS v, string_split_regex(text, {_q(pattern)}) AS g FROM documents WHERE regexp_matches(text, {_q(pattern)}))) WHERE length(v[i]) >= {least}"""


RANDOM = "(regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND length(value) >= 8 AND len(list_distinct(string_split(value, ''))) >= 6)"
NAME = "['assign', 'access', 'hex', 'bare'][kind + 1] || ':' || start || ':' || \"end\""

SECRETS = f"""WITH base AS ({_places(0, ASSIGN, 2, 6)} UNION ALL {_places(1, ACCESS, 0, 20)} UNION ALL {_places(2, HEX, 0, 24)}),
stats AS (SELECT value, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners, count(DISTINCT struct_pack(s := COALESCE(source, chr(1)), l := COALESCE(lang, chr(1)))) AS repositories FROM base JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id) GROUP BY value),
live AS (SELECT value FROM stats WHERE owners < 3 AND repositories < 6 AND {RANDOM}),
bare AS (SELECT * FROM ({_places(3, BARE, 0, 12)}) t WHERE {RANDOM} AND value IN (SELECT value FROM live) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start < t."end" AND t.start < b."end")),
spans AS (SELECT *, value IN (SELECT value FROM live) AS lives FROM base UNION ALL SELECT *, TRUE FROM bare)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
sha256(COALESCE(string_agg({NAME}, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, COALESCE(string_agg({NAME}, ',' ORDER BY start, kind), '') AS spans,
count(*) FILTER (lives) AS n_live, count(*) FILTER (NOT lives) AS n_copied, COALESCE(max(owners), 0)::BIGINT AS most_owners, COALESCE(max(repositories), 0)::BIGINT AS most_repositories
FROM documents d LEFT JOIN (SELECT * FROM spans LEFT JOIN stats USING (value)) s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_q(SPACE)}), lambda z: z <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, len(any_value(s.s))::BIGINT AS n_shingles, min(r) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY doc_id"""

ORACLE_SQL = {"op6_parity_join": JACCARD, "op7_secret_owners": SECRETS}
