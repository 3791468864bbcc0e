"""SQL of the derived entities, for the oracle engine (mirrors ``sources.tables``)."""

from __future__ import annotations

from brindle.functions.constants import DOMAINS
from brindle.sources.tables import AS_OF, FILES, FOLDERS


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def domain(path: str) -> str:
    hits = {d: "(" + " + ".join(f"contains(lower({path}), '{w}')::INT" for w in words) + ")" for d, words in DOMAINS.items()}
    top = f"greatest({', '.join(hits.values())})"
    return f"CASE WHEN {top} = 0 THEN 'general' " + " ".join(f"WHEN {n} = {top} THEN '{d}'" for d, n in hits.items()) + " END"


def keywords(path: str) -> str:
    """Distinct keywords of a path, as a list."""
    stem = rf"lower(regexp_replace(regexp_extract({path}, '[^/]*$'), '(.)\.[^.]+$', '\1'))"
    up = f"lower(regexp_extract(regexp_replace({path}, '/[^/]*$', ''), '[^/]*$'))"
    return f"list_distinct(list_filter(string_split_regex({stem}, '[-_./]'), lambda w: length(w) > 1) || CASE WHEN length({up}) > 1 AND {up} NOT IN ('.', 'src') THEN [{up}] ELSE [] END)"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) ELSE 0.0 END)"


def pattern(path: str) -> str:
    name = f"regexp_extract({path}, '[^/]*$')"
    up = f"CASE WHEN regexp_replace({path}, '/?[^/]*$', '') = '' THEN '.' ELSE regexp_replace({path}, '/?[^/]*$', '') END"
    stem = rf"regexp_replace({name}, '(.)\.[^.]+$', '\1')"
    ext = rf"regexp_extract({name}, '^.+(\.[^.]+)$', 1)"
    camel = f"regexp_extract({stem}, '^.*[a-z]([A-Z].*)$', 1)"
    return (
        f"CASE WHEN {camel} <> '' THEN ({up}) || '/*' || {camel} || {ext} WHEN contains({stem}, '-') THEN ({up}) || '/*-' || regexp_extract({stem}, '[^-]*$') || {ext} "
        f"WHEN contains({stem}, '_') THEN ({up}) || '/*_' || regexp_extract({stem}, '[^_]*$') || {ext} ELSE ({up}) || '/*' || {ext} END"
    )


PATHS = f"paths AS (SELECT event_id AS seq, {_list(FOLDERS)}[event_id % {len(FOLDERS)} + 1] || '/' || {_list(FILES)}[user_id % {len(FILES)} + 1] AS path FROM events)"
EVENTS = f"""{PATHS}, ev AS (SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'project' ELSE 'global' END AS scope, event_type AS type, path,
{pattern("path")} AS file_pattern, {domain("path")} AS domain, 'note ' || repeat('x', (event_id % 11)::INT) || ' ' || (event_id % 97) AS description,
CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 90 THEN 'high' ELSE 'critical' END AS severity,
CASE WHEN event_id % 3 = 0 THEN 'fix ' || (event_id % 13) ELSE '' END AS resolution, 'f' || (event_id % 17) AS related, ts AS seen
FROM events JOIN paths ON seq = event_id)"""
CATALOG = "catalog AS (SELECT 'm' || label AS mcp_name, 'tool_' || vec_id AS tool_name, left(text, 150) AS description, embedding, vec_id AS seq FROM embeddings JOIN documents ON vec_id = doc_id)"
NOTES = f"""lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
notes AS (SELECT d.doc_id AS id, 't' || (d.doc_id % 4) AS type,
list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\n]+'), lambda w: w <> '') AS words, [d.doc_id + 1, d.doc_id + 7] AS links,
CASE WHEN toxic = 1 THEN 'low' WHEN quality = 1 THEN 'high' ELSE 'normal' END AS priority,
CASE d.doc_id % 5 WHEN 1 THEN 90 * 86400 WHEN 2 THEN 4 * 604800 WHEN 3 THEN 48 * 3600 END AS ttl_s, text AS body,
d.doc_id * 3600 AS age_s FROM documents d LEFT JOIN lab USING (doc_id))"""
FINDINGS = """findings AS (SELECT CASE l_returnflag WHEN 'A' THEN 'orphan_file' WHEN 'R' THEN 'god_file' ELSE 'feature_envy' END AS type,
CASE WHEN l_quantity < 15 THEN 'low' WHEN l_quantity < 30 THEN 'medium' WHEN l_quantity < 45 THEN 'high' ELSE 'critical' END AS severity,
'f' || (l_partkey % 500) AS file, 'p' || l_partkey || '/s' || l_suppkey AS unit, 'line ' || l_linenumber AS description, l_shipdate >= TIMESTAMP '1997-01-01' AS current,
CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'resolved' END AS status, l_orderkey, l_linenumber FROM lineitem)"""
TRENDS = """trends AS (SELECT *, CASE WHEN smell_count < 10 THEN 'A' WHEN smell_count < 15 THEN 'B' WHEN smell_count < 18 THEN 'C' ELSE 'D' END AS risk_grade
FROM (SELECT user_id % 20 AS project, date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS smell_count, round(avg(value), 6) AS debt_score FROM events GROUP BY ALL))"""
GRAPH = """nodes AS (SELECT *, id = 'r0' AS is_start, regexp_matches(id, '^[cs]') AS is_end FROM (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier)),
links AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey::BIGINT AS seq FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey + 100 FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey + 100 FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'x' || n_nationkey, n_nationkey + 1000 FROM nation WHERE n_nationkey % 6 = 1),
edges AS (SELECT src, dst, seq, seq % 7 AS priority, CASE seq % 4 WHEN 0 THEN 'tool' WHEN 1 THEN 'phrase' WHEN 2 THEN 'default' ELSE 'always' END AS kind,
CASE WHEN seq % 8 <> 2 THEN 'tool_' || (seq % 5) END AS tool, CASE WHEN seq % 8 <> 2 THEN 'go ' || (seq % 3) END AS phrase FROM links)"""
TASKS = "tasks AS (SELECT l_orderkey AS node, l_linenumber::BIGINT AS task, l_linestatus = 'F' AS done FROM lineitem), deps AS (SELECT node, task, task - 1 AS needs FROM tasks WHERE task > 1)"
EDITS = "edits AS (SELECT user_id AS key, event_id AS seq, ts, 'f' || (event_id % 7) AS file FROM events)"
NOW = f"TIMESTAMP '{AS_OF}'"
