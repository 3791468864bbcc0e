"""The engine's operators as named queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scoring as S
from brindle.functions import text as X
from brindle.operators import events as E
from brindle.operators import findings as FI
from brindle.operators import graph as G
from brindle.operators import memory as M
from brindle.operators import merge as MG
from brindle.operators import scans as SC
from brindle.operators import search as SE
from brindle.operators import selection as SL
from brindle.operators import trends as TR
from brindle.plans import entities as Q
from brindle.plans.registry import query
from brindle.sources import formats as FM
from brindle.sources import tables as T

# ---------------------------------------------------------------- search


def _query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.load(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


@query("""SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.vector_topk(T.load(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, key="vec_id")


@query("""SELECT query, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM (
SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)) WHERE rank <= 10""")
def vector_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.load(spark, sf_dir, "embeddings")
    return SE.vector_topk_many(rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding"), 10, key="vec_id")


@query("""SELECT label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (
SELECT label, vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)) WHERE rank <= 3""")
def vector_topk_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.vector_topk_by_group(T.load(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 3, "label", key="vec_id")


@query(f"WITH {Q.CATALOG} SELECT mcp_name, tool_name, 1.0::DOUBLE AS score FROM catalog WHERE contains(lower(tool_name), 'the') OR contains(lower(description), 'the') ORDER BY mcp_name, tool_name LIMIT 50")
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.keyword_fallback(T.catalog(spark, sf_dir), "The", 50)


@query("""WITH sel AS (SELECT 'tool_' || (event_id % 400) AS tool, 'k' || (user_id % 6) AS keyword FROM events WHERE event_type = 'click'),
w AS (SELECT tool, keyword, round(least(2.0, 0.15 * count(*)), 6) AS weight FROM sel GROUP BY ALL), tools AS (SELECT DISTINCT 'tool_' || (event_id % 400) AS tool FROM events)
SELECT t.tool, round(coalesce(sum(weight), 0.0) / 3, 6) AS boost FROM tools t LEFT JOIN w ON w.tool = t.tool AND keyword IN ('k0', 'k1', 'k2') GROUP BY t.tool""")
def learned_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.load(spark, sf_dir, "events")
    tool = F.concat(F.lit("tool_"), (F.col("event_id") % 400).cast("string")).alias("tool")
    chosen = e.where("event_type = 'click'").select(tool, F.concat(F.lit("k"), (F.col("user_id") % 6).cast("string")).alias("keyword"))
    return SE.learned_boost(e.select(tool).distinct(), SE.learned_weights(chosen), ["k0", "k1", "k2"])


@query()
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.index_search(T.catalog(spark, sf_dir).withColumn("boost", F.lit(0.0)), "find the tool that erth", 10)


@query("""WITH s AS (SELECT user_id AS project, ts, event_id AS seq, CASE WHEN event_type = 'view' THEN event_id END AS search, event_id % 9 AS tool FROM events WHERE event_type IN ('view', 'click')),
l AS (SELECT *, last_value(search IGNORE NULLS) OVER (PARTITION BY project ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS search_seq FROM s)
SELECT project, seq, search_seq, coalesce(tool IN (search_seq % 9, (search_seq + 1) % 9, (search_seq + 4) % 9), false) AS hit FROM l WHERE search IS NULL""")
def asof_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.load(spark, sf_dir, "events").select(F.col("user_id").alias("project"), "ts", F.col("event_id").alias("seq"), "event_type")
    results = F.array(*[(F.col("seq") + k) % 9 for k in (0, 1, 4)])
    return SE.asof_selection(e.where("event_type = 'view'").withColumn("results", results), e.where("event_type = 'click'").withColumn("tool", F.col("seq") % 9))


@query(f"WITH {Q.CATALOG}, p AS (SELECT 'm' || i AS mcp_name FROM range(0, 15) t(i)) SELECT p.mcp_name, count(c.mcp_name) AS tool_count, 'subprocess' AS kind FROM p LEFT JOIN catalog c USING (mcp_name) GROUP BY p.mcp_name UNION ALL SELECT 'builtin', 26, 'internal'")
def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    builtin = spark.sql("select 'builtin' as mcp_name, 26L as tool_count")
    return SE.tool_counts(spark.range(15).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("mcp_name")), T.catalog(spark, sf_dir), builtin)


# ---------------------------------------------------------------- merging

# The old catalog's schemas have the same keys as the new one's in another order.
_HASH = """sha1(description || chr(10) || '{"properties":{"' || mcp_name || '":{"type":"string"},"z":{}},"type":"object"}')"""


def _hashes(catalog: DataFrame, turned: bool) -> DataFrame:
    own = F.concat(F.lit('"'), "mcp_name", F.lit('": {"type": "string"}'))
    parts = [F.lit('{"type": "object", "properties": {"z": {}, '), own, F.lit("}}")] if turned else [F.lit('{"properties": {'), own, F.lit(', "z": {}}, "type": "object"}')]
    return catalog.select("mcp_name", "tool_name", X.change_hash(F.col("description"), F.concat(*parts)).alias("text_hash"))


@query(f"""WITH {Q.CATALOG}, new AS (SELECT mcp_name, tool_name, CASE WHEN seq % 10 = 0 THEN description || '!' ELSE description END AS description FROM catalog),
h AS (SELECT mcp_name, tool_name, {_HASH} AS text_hash FROM new), old AS (SELECT mcp_name, tool_name, {_HASH} AS text_hash FROM catalog WHERE seq % 7 <> 0)
SELECT * FROM h ANTI JOIN old USING (mcp_name, tool_name, text_hash)""")
def hash_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.catalog(spark, sf_dir)
    new = c.withColumn("description", F.when(F.col("seq") % 10 == 0, F.concat("description", F.lit("!"))).otherwise(F.col("description")))
    return MG.hash_upsert(_hashes(c.where("seq % 7 <> 0"), True), _hashes(new, False), ["mcp_name", "tool_name"], "text_hash")


@query(f"""WITH {Q.EVENTS}, firsts AS (SELECT type, file_pattern, domain, related, min(seq) AS first_at FROM ev GROUP BY ALL),
files AS (SELECT type, file_pattern, domain, string_agg(related, ',' ORDER BY first_at) AS related_files FROM firsts GROUP BY ALL)
SELECT type, file_pattern, domain, count(*) AS occurrences, min(seen) AS first_seen, max(seen) AS last_seen, arg_max(description, length(description) * 1000000000 - seq) AS description,
coalesce((arg_min(resolution, (seen, seq)) FILTER (resolution <> '')), '') AS resolution, any_value(related_files) AS related_files, round(least(0.95, 0.95 * (1 - power(0.7, count(*)))), 6) AS confidence
FROM ev JOIN files USING (type, file_pattern, domain) GROUP BY type, file_pattern, domain""")
def experience_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MG.experience_merge(T.experience_events(spark, sf_dir))


@query(f"""WITH {Q.EVENTS} SELECT type, file_pattern, description, count(*) AS occurrences, arg_max(resolution, length(resolution) * 1000000000 - seq) AS resolution,
round(least(0.95, 0.5 + 0.1 * (count(*) - 1)), 6)::DOUBLE AS confidence FROM ev GROUP BY type, file_pattern, description""")
def commit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MG.commit_merge(T.experience_events(spark, sf_dir))


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of both stores in one aggregation."""
    return MG.entries(T.experience_events(spark, sf_dir), [*MG.KEY, "scope"]).drop("resolution", "description")


def _entries(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    return MG.entries(T.experience_events(spark, sf_dir).where(F.col("scope") == scope)).drop("resolution", "description")


_STORE = f"""WITH {Q.EVENTS}, entries AS (SELECT type, file_pattern, domain, scope, count(*) AS occurrences, min(seen) AS first_seen, max(seen) AS last_seen,
round(least(0.95, 0.95 * (1 - power(0.7, count(*)))), 6) AS confidence FROM ev GROUP BY type, file_pattern, domain, scope)"""


@query(f"""{_STORE} SELECT type, file_pattern, domain, occurrences, first_seen, last_seen, confidence, own FROM (SELECT *, (scope = 'project')::INT AS own,
row_number() OVER (PARTITION BY type, file_pattern, domain ORDER BY confidence DESC, scope = 'project' DESC) AS r FROM entries) WHERE r = 1""")
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MG.store_merge(_scopes(spark, sf_dir).withColumn("own", (F.col("scope") == "project").cast("int")).drop("scope"))


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.when(F.col("occurrences") < 20, "low").when(F.col("occurrences") < 60, "medium").otherwise("high")
    return _scopes(spark, sf_dir).withColumn("severity", sev)


@query(f"""{_STORE}, e AS (SELECT *, CASE WHEN occurrences < 20 THEN 'low' WHEN occurrences < 60 THEN 'medium' ELSE 'high' END AS severity FROM entries)
SELECT type, scope, severity, count(*) AS n, round(avg(confidence), 3) AS avg_confidence, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM e GROUP BY GROUPING SETS ((), (type), (scope), (severity))""")
def experience_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MG.stats(_scoped(spark, sf_dir))


@query(f"{_STORE} SELECT type, file_pattern, domain, confidence, last_seen FROM entries WHERE scope = 'project' ORDER BY confidence DESC, last_seen DESC, type, file_pattern, domain LIMIT 100")
def evict_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MG.evict(_entries(spark, sf_dir, "project"), 100).select(*MG.KEY, "confidence", "last_seen")


@query(f"{_STORE} SELECT type, file_pattern, domain, confidence, count(*) OVER () AS total FROM entries WHERE scope = 'global' AND type = 'click' AND confidence >= 0.5 ORDER BY confidence DESC, last_seen DESC, file_pattern, domain LIMIT 20")
def experience_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir, "global").where("type = 'click' and confidence >= 0.5")
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    return rows.orderBy(F.desc("confidence"), F.desc("last_seen"), "file_pattern", "domain").limit(20).join(total).select(*MG.KEY, "confidence", "total")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def retention_lastn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MG.retain(T.load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id", "ts")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MG.latest_slot(T.load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH o AS (SELECT o_custkey AS k, max(o_orderstatus) AS old FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL), n AS (SELECT o_custkey AS k, max(o_orderstatus) AS new FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY ALL)
SELECT * FROM (SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN old <> new THEN 'changed' END AS state FROM o FULL JOIN n ON o.k = n.k) WHERE state IS NOT NULL""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.load(spark, sf_dir, "orders")
    state = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderstatus").alias("status"))
    return MG.version_diff(state(o.where("o_orderkey % 3 <> 0")), state(o.where("o_orderkey % 3 <> 1")), "k", "status")


# ---------------------------------------------------------------- relevance

_TARGET = "src/services/tokenService.ts"


_SCORE = f"0.25 * path + 0.30 * {Q.jaccard(Q.keywords('file_pattern'), 'own')} + 0.20 * (domain = 'auth')::INT + 0.15 * confidence * greatest(0.3, 1 - days / 180) + 0.10 * greatest(0.0, 1 - days / 30)"


@query(f"""{_STORE}, s AS (SELECT type, file_pattern, domain, confidence, last_seen, floor(epoch({Q.NOW} - last_seen) / 86400) AS days, {Q.keywords(f"'{_TARGET}'")} AS own FROM entries WHERE scope = 'project'),
f AS (SELECT *, CASE WHEN regexp_full_match('{_TARGET}', replace(file_pattern, '*', '.*')) THEN 1.0 WHEN regexp_replace(file_pattern, '/[^/]*$', '') = 'src/services' THEN 0.7
WHEN regexp_replace(file_pattern, '/[^/]*/[^/]*$', '') = 'src' THEN 0.4 ELSE 0.0 END AS path FROM s)
SELECT type, file_pattern, domain, round({_SCORE}, 6) AS score FROM f WHERE round({_SCORE}, 6) > 0.05 ORDER BY score DESC, type, file_pattern, domain LIMIT 25""")
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir, "project")
    now, target = T.as_of(), F.lit(_TARGET)
    path = S.path_match(target, F.col("file_pattern"))
    semantic = S.jaccard(X.path_keywords(target), X.path_keywords(F.col("file_pattern")))
    score = S.relevance(path, semantic, (F.col("domain") == X.domain(target)).cast("int"), F.col("confidence"), S.decay(F.col("last_seen"), now), S.recency(F.col("last_seen"), now))
    rows = rows.withColumn("score", F.round(score, 6)).where("score > 0.05")
    return rows.orderBy(F.desc("score"), *MG.KEY).limit(25).select(*MG.KEY, "score")


_EDIT = f"round(0.30 * path + 0.25 * {Q.jaccard(Q.keywords('file_pattern'), 'own')} + 0.20 * (domain = other)::INT + 0.15 * confidence, 4)"


@query(f"""{_STORE}, t AS (SELECT target, {Q.keywords("target")} AS own, {Q.domain("target")} AS other FROM (SELECT unnest(['src/services/authService.ts', 'lib/utils/date-helper.js', 'src/api/handlers/router.go', 'src/pages/home.ts']) AS target)),
p AS (SELECT type, file_pattern, domain, confidence, target, own, other, regexp_replace(file_pattern, '/[^/]*$', '') AS a, regexp_replace(target, '/[^/]*$', '') AS b FROM entries, t WHERE scope = 'global'),
f AS (SELECT *, CASE WHEN regexp_full_match(target, replace(file_pattern, '*', '.*')) THEN 1.0 WHEN a = b THEN 0.7 ELSE 0.0 END AS path FROM p)
SELECT type, file_pattern, domain, max({_EDIT}) AS score FROM f GROUP BY type, file_pattern, domain HAVING max({_EDIT}) > 0.1""")
def max_score_over_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = ["src/services/authService.ts", "lib/utils/date-helper.js", "src/api/handlers/router.go", "src/pages/home.ts"]
    rows = _entries(spark, sf_dir, "global").withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    target, own = F.col("target"), F.col("file_pattern")
    overlap = S.jaccard(X.path_keywords(target), X.path_keywords(own))
    score = F.round(S.edit_relevance(S.path_match(target, own, far=False), overlap, (F.col("domain") == X.domain(target)).cast("int"), F.col("confidence")), 4)
    return rows.withColumn("score", score).groupBy(*MG.KEY).agg(F.max("score").alias("score")).where("score > 0.1")


# ---------------------------------------------------------------- texts and paths


@query(f"WITH {Q.PATHS} SELECT seq, {Q.pattern('path')} AS file_pattern FROM paths")
def path_generalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.paths(spark, sf_dir).select("seq", X.generalize(F.col("path")).alias("file_pattern"))


@query(f"WITH {Q.PATHS} SELECT {Q.domain('path')} AS domain, count(*) AS n FROM paths GROUP BY 1 UNION ALL SELECT 'url:' || {Q.domain('url')}, count(*) FROM pages GROUP BY 1")
def domain_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = T.paths(spark, sf_dir).groupBy(X.domain(F.col("path")).alias("domain")).agg(F.count("*").alias("n"))
    url = T.load(spark, sf_dir, "pages").groupBy(F.concat(F.lit("url:"), X.domain(F.col("url"))).alias("domain")).agg(F.count("*").alias("n"))
    return own.unionByName(url)


@query(rf"""WITH {Q.PATHS}, k AS (SELECT seq, path, list_filter(string_split_regex(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]+$', '\1')), '[-_./]'), lambda w: length(w) > 1) AS w,
lower(regexp_extract(regexp_replace(path, '/[^/]*$', ''), '[^/]*$')) AS up FROM paths)
SELECT seq, array_to_string(CASE WHEN length(up) > 1 AND up NOT IN ('.', 'src') AND NOT list_contains(w, up) THEN w || [up] ELSE w END, ',') AS keywords FROM k""")
def path_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.paths(spark, sf_dir).select("seq", F.array_join(X.path_keywords(F.col("path")), ",").alias("keywords"))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_NOTE_STOP = "[" + ", ".join(f"'{w}'" for w in X.NOTE_STOPWORDS) + "]"


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(lower(text), '[_\-\s]+', ' ', 'g')), ' ')), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))), ' ') AS keywords FROM documents""")
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.load(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(X.tokens(F.col("text"))), " ").alias("keywords"))


@query(f"""{_STORE}, e AS (SELECT regexp_replace(file_pattern, '(internal/)[^/]+(/.+)', '\\1{{name}}\\2') AS pattern, file_pattern, occurrences, hash, row_number() OVER () AS x FROM (SELECT *, 0 AS hash FROM entries WHERE scope = 'project')
WHERE regexp_matches(file_pattern, '(?i)internal/[^/]+/domain/'))
SELECT 'domain' AS layer, pattern, sum(occurrences)::BIGINT AS occurrences, array_to_string(list_sort(list_distinct(list(file_pattern)))[1:3], ',') AS examples FROM e GROUP BY pattern HAVING sum(occurrences) >= 3""")
def checklist_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir, "project").withColumn("seq", F.lit(0))
    return SC.checklist(rows, "bounded_context", 3)


@query(f"""WITH {Q.EVENTS}, e AS (SELECT domain, type, file_pattern, arg_max(description, length(description) * 1000000000 - seq) AS description, round(least(0.95, 0.95 * (1 - power(0.7, count(*)))), 6) AS confidence FROM ev GROUP BY domain, type, file_pattern),
n AS (SELECT domain, left(split_part(description, '.', 1), 120) AS note, max(confidence) AS confidence FROM e WHERE confidence >= 0.65 GROUP BY 1, 2)
SELECT domain, note, confidence, place FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, note) AS place FROM n) WHERE place <= 5""")
def notes_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.notes(MG.experience_merge(T.experience_events(spark, sf_dir)), "domain")


@query("""SELECT CASE WHEN regexp_matches(html, '(?i)<nav') THEN 'nav' ELSE 'none' END AS kind, regexp_extract(url, '\\.([a-z]+)/', 1) AS tld, count(*) AS n FROM pages GROUP BY ALL""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.load(spark, sf_dir, "pages")
    return p.groupBy(F.when(F.col("html").rlike("(?i)<nav"), "nav").otherwise("none").alias("kind"), F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("tld")).agg(F.count("*").alias("n"))


_PLAIN = {"apache": r"Apache License", "email": r"[a-z0-9.]+@[a-z0-9.]+\.com", "hash-run": r"###", "shout": r"[A-Z]{6,}!!"}


@query("WITH r AS (SELECT unnest(['apache', 'email', 'hash-run', 'shout']) AS rule, unnest(['Apache License', '[a-z0-9.]+@[a-z0-9.]+\\.com', '###', '[A-Z]{6,}!!']) AS re), "
       "m AS (SELECT doc_id, rule, text, re, len(regexp_extract_all(text, re)) AS n FROM documents, r WHERE regexp_matches(text, re)) "
       "SELECT doc_id, rule, n, length(regexp_extract(text, '(?s)^(.*?)(?:' || re || ')', 1)) - length(replace(regexp_extract(text, '(?s)^(.*?)(?:' || re || ')', 1), chr(10), '')) + 1 AS line FROM m")  # fmt: skip
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.rule_scan(T.load(spark, sf_dir, "documents"), "doc_id", "text", _PLAIN)


@query()
def style_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.rule_scan(T.load(spark, sf_dir, "pages"), "page_id", "html", SC.flat_rules())


@query("""WITH c AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'mcp_memory_set' WHEN 1 THEN 'Bash' ELSE 'Read' END AS name, CASE WHEN contains(text, 'the ') THEN 'git commit -m ' || text ELSE text END AS command FROM conversations)
SELECT conv_id, count(*) AS turns, count(*) FILTER (contains(name, 'memory_set')) AS memory_writes, count(*) FILTER (name = 'Bash' AND contains(coalesce(command, ''), 'git commit')) AS commits
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS r FROM c) WHERE r <= 4 GROUP BY conv_id""")
def transcript_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.load(spark, sf_dir, "conversations")
    name = F.when(F.col("turn") % 3 == 0, "mcp_memory_set").when(F.col("turn") % 3 == 1, "Bash").otherwise("Read")
    command = F.when(F.col("text").contains("the "), F.concat(F.lit("git commit -m "), F.col("text"))).otherwise(F.col("text"))
    return SC.transcript_tail(c.withColumn("content", F.array(F.struct(name.alias("name"), command.alias("command")))), 4)


@query(rf"""WITH {Q.PATHS}, x AS (SELECT lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ext FROM paths)
SELECT CASE ext WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' ELSE ltrim(ext, '.') END AS language, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, language LIMIT 3""")
def language_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.language_topk(T.paths(spark, sf_dir))


@query(r"""WITH v AS (SELECT lang, unnest(['string', 'uuid', 'int', 'custom']) AS kind, unnest([0, -1, -2, -3]) AS o, unnest([len(regexp_extract_all(text, '[a-z]{3,}')), len(regexp_extract_all(text, '[0-9a-f]{8}-[0-9a-f]{4}')), len(regexp_extract_all(text, '[0-9]+')), len(regexp_extract_all(text, '[A-Z]{2,}_[0-9]+'))]) AS n FROM documents),
s AS (SELECT lang, kind, o, sum(n)::BIGINT AS n FROM v GROUP BY ALL) SELECT lang, arg_max(kind, n * 10 + o) AS kind, max(n) AS votes FROM s GROUP BY lang""")
def id_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.id_vote(T.load(spark, sf_dir, "documents"), "lang", "text")


@query("""WITH f AS (SELECT 'd' || (l_suppkey % 9) AS dir, lpad((l_orderkey % 900)::VARCHAR, 6, '0') || '_x.sql' AS name FROM lineitem), n AS (SELECT dir, regexp_extract(name, '^([0-9]+)_', 1) AS d FROM f),
g AS (SELECT dir, max(d::BIGINT) AS v, max(length(d)) AS width, count(*) AS files FROM n WHERE d <> '' GROUP BY dir ORDER BY v DESC, dir LIMIT 1) SELECT dir, files, lpad((v + 1)::VARCHAR, greatest(6, width)::INT, '0') AS next FROM g""")
def migration_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.load(spark, sf_dir, "lineitem")
    name = F.concat(F.lpad((F.col("l_orderkey") % 900).cast("string"), 6, "0"), F.lit("_x.sql"))
    return SC.migration_max(rows.select(F.concat(F.lit("d"), (F.col("l_suppkey") % 9).cast("string")).alias("dir"), name.alias("name")))


@query("""WITH s AS (SELECT DISTINCT c_custkey % 50 AS project, c_mktsegment AS tech FROM customer), t AS (SELECT * FROM (VALUES ('BUILDING', 'dev'), ('BUILDING', 'qa'), ('MACHINERY', 'ops'), ('AUTOMOBILE', 'dev')) v(tech, name))
SELECT DISTINCT project, name FROM s JOIN t USING (tech) UNION SELECT project, unnest(['core', 'rules']) FROM s""")
def stack_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.load(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("project"), F.col("c_mktsegment").alias("tech")).distinct()
    return SC.stack_lookup(s, {"BUILDING": ["dev", "qa"], "MACHINERY": ["ops"], "AUTOMOBILE": ["dev"]}, ["core", "rules"])


@query()
def snippet_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.load(spark, sf_dir, "documents").select("doc_id", SC.snippet("text").alias("snippet"))


# ---------------------------------------------------------------- memory

_DEAD = "coalesce(age_s > ttl_s, false)"


@query(f"WITH {Q.NOTES} SELECT count(*) AS total, count(*) FILTER (NOT {_DEAD}) AS active, count(*) FILTER ({_DEAD}) AS expired, sum(length(coalesce(body, '')) // 4)::BIGINT AS tokens FROM notes")
def ttl_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ttl_stats(T.memory_nodes(spark, sf_dir), T.as_of())


_PICK = f"""WITH {Q.NOTES}, u AS (SELECT id, w, min(i) AS i FROM (SELECT id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM notes) GROUP BY id, w),
five AS (SELECT id, w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM u) WHERE r <= 5), hits AS (SELECT id, count(*) AS h FROM five WHERE w IN ('the', 'of', 'de') GROUP BY id),
s AS (SELECT n.*, round(0.6 * (coalesce(h, 0) / 4.0) + 0.1 / (1 + age_s / 86400.0) + CASE priority WHEN 'high' THEN 0.3 WHEN 'low' THEN -0.2 ELSE 0 END, 6) AS score FROM notes n LEFT JOIN hits USING (id) WHERE NOT {_DEAD}),
o AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM s WHERE priority <> 'high' AND score > 0),
chosen AS (SELECT id, score FROM s WHERE priority = 'high' UNION ALL SELECT id, score FROM o WHERE r <= (SELECT greatest(0, 400 - count(*)) FROM s WHERE priority = 'high'))"""
_WORDS = ["the", "of", "de"]


@query(f"{_PICK} SELECT id, score FROM chosen")
def memory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.select(T.memory_nodes(spark, sf_dir), _WORDS, 400, T.as_of())


@query(f"""{_PICK}, ends AS (SELECT DISTINCT unnest(links) AS id FROM notes SEMI JOIN chosen USING (id)) SELECT id, type FROM notes SEMI JOIN ends USING (id) ANTI JOIN chosen USING (id)""")
def link_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = T.memory_nodes(spark, sf_dir)
    return M.linked(notes, M.select(notes, _WORDS, 400, T.as_of())).select("id", "type")


@query(f"WITH {Q.NOTES}, r AS (SELECT type, id, sum(length(coalesce(body, ''))) OVER w + count(*) OVER w - 1 AS used FROM notes WINDOW w AS (PARTITION BY type ORDER BY id ROWS UNBOUNDED PRECEDING)) SELECT type, id, used::BIGINT AS used FROM r WHERE used <= 40000")
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.memory_nodes(spark, sf_dir).withColumn("size", F.length(F.coalesce("body", F.lit(""))))
    return M.pack_prefix(rows, "size", ["id"], ["type"], 40000).select("type", "id", "used")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k FROM conversations),
f AS (SELECT conv_id, k, turn, CASE WHEN size <= 600 THEN size ELSE 0 END AS used, size <= 600 AS took FROM t WHERE k = 1
UNION ALL SELECT t.conv_id, t.k, t.turn, CASE WHEN used + size <= 600 THEN used + size ELSE used END, used + size <= 600 FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1) SELECT conv_id, turn FROM f WHERE took""")
def budget_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return M.pack_skipping(rows, "size", ["turn", "role"], "conv_id", "turn", 600)


# ---------------------------------------------------------------- trends


@query(f"WITH {Q.TRENDS} SELECT project, ts, debt_score AS value FROM trends WHERE ts >= {Q.NOW} - INTERVAL 15 DAY")
def trend_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.window(T.trends(spark, sf_dir), "debt_score", 15, T.as_of())


@query(f"""WITH {Q.TRENDS}, g AS (SELECT project, count(*) AS n, arg_min(smell_count, ts) AS s0, arg_max(smell_count, ts) AS s1, arg_min(debt_score, ts) AS d0, arg_max(debt_score, ts) AS d1, arg_min(risk_grade, ts) AS g0, arg_max(risk_grade, ts) AS g1
FROM trends WHERE ts >= {Q.NOW} - INTERVAL 30 DAY GROUP BY project)
SELECT project, n, CASE WHEN n >= 2 THEN (s1 - s0)::DOUBLE END AS smell_count_delta, CASE WHEN n >= 2 THEN round(d1 - d0, 6) END AS debt_score_delta, CASE WHEN n >= 2 AND g0 <> g1 THEN g0 || ' -> ' || g1 END AS risk_grade_change FROM g""")
def trend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.summary(T.trends(spark, sf_dir), ["smell_count", "debt_score"], ["risk_grade"], 30, T.as_of())


# ---------------------------------------------------------------- findings


@query(f"WITH {Q.FINDINGS} SELECT severity, type, count(*) AS n FROM findings GROUP BY GROUPING SETS ((), (severity), (type))")
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.rollup(T.findings(spark, sf_dir))


@query(f"WITH {Q.FINDINGS} SELECT l_orderkey, l_linenumber, severity FROM findings WHERE severity IN ('high', 'critical')")
def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.at_least(T.findings(spark, sf_dir), "high").select("l_orderkey", "l_linenumber", "severity")


_BASE = f"WITH {Q.FINDINGS}, base AS (SELECT DISTINCT type, unit AS file FROM findings WHERE NOT current), fresh AS (SELECT * REPLACE (unit AS file) FROM findings f WHERE current AND NOT EXISTS (SELECT 1 FROM base b WHERE b.type = f.type AND b.file = f.unit))"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by part and supplier, so that many are known before and some are new."""
    return T.findings(spark, sf_dir).drop("file").withColumnRenamed("unit", "file")


@query(f"{_BASE} SELECT type, file, severity, l_orderkey, l_linenumber FROM fresh")
def baseline_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _units(spark, sf_dir)
    return FI.new_since(f.where("current"), f.where("not current")).select("type", "file", "severity", "l_orderkey", "l_linenumber")


@query(f"""{_BASE}, nf AS (SELECT DISTINCT unit AS file FROM findings WHERE l_linenumber = 7 UNION SELECT 'p' || p_partkey || '/s' || s FROM part, (SELECT unnest([1, 2, 3]) AS s) WHERE p_partkey * 7 % 3600 < 1800)
SELECT type, file, l_orderkey, l_linenumber FROM fresh WHERE NOT (type = 'orphan_file' AND file IN (SELECT file FROM nf))""")
def actionable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, now = _units(spark, sf_dir), T.as_of()
    parts = T.load(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("p"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("s"))
    ago = (F.unix_micros(now.cast("timestamp")) - F.col("p") * 7 % 3600 * 1_000_000).cast("bigint")
    touched = parts.select(F.concat(F.lit("p"), F.col("p").cast("string"), F.lit("/s"), F.col("s").cast("string")).alias("file"), F.timestamp_micros(ago).cast("timestamp_ntz").alias("mtime"))
    return FI.actionable(f.where("current"), f.where("not current"), f.where("l_linenumber = 7"), touched, now).select("type", "file", "l_orderkey", "l_linenumber")


@query(f"""WITH {Q.FINDINGS}, s AS (SELECT file, severity, count(*) AS n FROM findings GROUP BY ALL), t AS (SELECT file, type, count(*) AS n FROM findings GROUP BY ALL),
a AS (SELECT file, string_agg(n || ' ' || severity, ', ' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS x, sum(n)::BIGINT AS total FROM s GROUP BY file), b AS (SELECT file, string_agg(type || ':' || n, ', ' ORDER BY type) AS y FROM t GROUP BY file)
SELECT file, total || ' (' || x || '): ' || y AS line FROM a JOIN b USING (file)""")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.summary(T.findings(spark, sf_dir), "file")


@query(f"""WITH {Q.FINDINGS}, a AS (SELECT file, count(*) % 8 AS attempts, count(*) % 5 = 0 AS ack FROM findings GROUP BY file), b AS (SELECT file, count(*) AS blocking FROM findings WHERE severity = 'critical' AND current GROUP BY file)
SELECT a.file, coalesce(blocking, 0) AS blocking, CASE WHEN ack THEN 'acknowledged' WHEN attempts >= 5 THEN 'escaped' WHEN blocking IS NULL THEN 'open' ELSE 'blocked' END AS state FROM a LEFT JOIN b USING (file)""")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.findings(spark, sf_dir)
    attempts = f.groupBy("file").agg((F.count("*") % 8).alias("attempts"), (F.count("*") % 5 == 0).alias("acknowledged"))
    return FI.tension_gate(f.where("current"), "file", "critical", attempts)


@query(f"""WITH {Q.TRENDS}, g AS (SELECT project, ts, risk_grade AS grade, smell_count AS critical, smell_count // 12 AS open_criticals FROM trends)
SELECT *, (open_criticals > 1 OR grade = 'D' OR critical > 10) AS blocked, CASE WHEN open_criticals > 1 THEN 'security_gate_failed' ELSE concat_ws('; ', CASE WHEN grade = 'D' THEN 'debt grade D is worse than required C' END, CASE WHEN critical > 10 THEN critical || ' critical smells exceed limit of 10' END) END AS reason FROM g""")
def grade_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("smell_count")
    rows = T.trends(spark, sf_dir).select("project", "ts", F.col("risk_grade").alias("grade"), n.alias("critical"), F.floor(n / 12).alias("open_criticals"))
    return FI.grade_gate(rows, "C", open_criticals=1)


@query(f"""WITH {Q.FINDINGS}, c AS (SELECT severity, file, count(*) AS n FROM findings GROUP BY ALL) SELECT severity, count(*) AS files, least(count(*) FILTER (n >= 40), 10) AS details, max(n) AS most, coalesce(string_agg(file, ',' ORDER BY r) FILTER (n >= 40 AND r <= 10), '') AS worst
FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY n DESC, file) AS r FROM c) GROUP BY severity""")
def impact_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.impact(T.findings(spark, sf_dir), "severity", 40)


@query(f"WITH {Q.FINDINGS}, m AS (SELECT * FROM (VALUES ('god_file', 'dev-patterns design-patterns.md#single-responsibility'), ('feature_envy', 'dev-patterns design-patterns.md#encapsulation'), ('hub_overload', 'dev-patterns architecture.md#facade-pattern')) v(type, skill)) SELECT DISTINCT type, skill FROM (SELECT type FROM findings UNION SELECT 'hub_overload') JOIN m USING (type)")
def smell_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.skills(T.findings(spark, sf_dir), spark.sql("select 'hub_overload' as type union all select 'unmapped'"))


# ---------------------------------------------------------------- graph


@query(f"""WITH {Q.GRAPH} SELECT 'no_outgoing' AS error, id AS subject FROM nodes WHERE NOT is_end AND id NOT IN (SELECT src FROM edges) UNION ALL SELECT 'no_incoming', id FROM nodes WHERE NOT is_start AND id NOT IN (SELECT dst FROM edges)
UNION ALL SELECT 'dangling_to', dst FROM edges WHERE dst NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'dangling_from', src FROM edges WHERE src NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'start_count', n::VARCHAR FROM (SELECT count(*) FILTER (is_start) AS n FROM nodes) WHERE n <> 1""")
def graph_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.validate(*T.graph(spark, sf_dir))


@query(f"WITH {Q.GRAPH} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges)")
def terminal_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.terminal(*T.graph(spark, sf_dir))


@query(f"""WITH {Q.GRAPH}, h AS (SELECT 'tool' AS how, * FROM edges WHERE (kind IN ('tool', 'default') AND contains('my_tool_3_x', tool)) OR (kind = 'default' AND tool IS NULL)
UNION ALL SELECT 'phrase', * FROM edges WHERE (kind IN ('phrase', 'default') AND contains('please go 1 now', lower(phrase))) OR (kind = 'default' AND phrase IS NULL) UNION ALL SELECT 'none', * FROM edges WHERE kind IN ('default', 'always'))
SELECT how, src, dst, row_number() OVER (PARTITION BY how, src ORDER BY priority, seq, dst) AS place FROM h""")
def trigger_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = T.graph(spark, sf_dir)[1]
    parts = {"tool": G.triggered(edges, tool="my_tool_3_x"), "phrase": G.triggered(edges, phrase="Please GO 1 now"), "none": G.triggered(edges)}
    parts = [d.select(F.lit(how).alias("how"), "src", "dst", "place") for how, d in parts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {Q.TASKS} SELECT t.node, t.task FROM tasks t WHERE NOT done AND NOT EXISTS (SELECT 1 FROM deps d LEFT JOIN tasks n ON n.node = d.node AND n.task = d.needs AND n.done WHERE d.node = t.node AND d.task = t.task AND n.node IS NULL)")
def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ready(*T.tasks(spark, sf_dir))


@query(f"""WITH {Q.TASKS}, n AS (SELECT o_orderkey AS node, CASE o_orderkey % 9 WHEN 0 THEN 'wave' WHEN 1 THEN NULL ELSE 'dag' END AS node_type FROM orders), c AS (SELECT node, bool_and(done) AS complete FROM tasks GROUP BY node)
SELECT n.node, CASE WHEN node_type IS NULL THEN false WHEN node_type <> 'dag' THEN true ELSE coalesce(complete, true) END AS complete FROM n LEFT JOIN c USING (node)""")
def dag_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 9
    nodes = T.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.when(k == 0, "wave").when(k > 1, "dag").alias("node_type"))
    return G.complete(T.tasks(spark, sf_dir)[0], nodes)


@query("""WITH RECURSIVE rows AS (SELECT l_orderkey AS node, l_linenumber::BIGINT AS task FROM lineitem),
deps AS (SELECT node, task, task - 1 AS needs FROM rows WHERE task > 1 UNION SELECT node, 2, 3 FROM rows WHERE node % 5 = 0 AND task = 2),
reach AS (SELECT node, task, needs FROM deps UNION SELECT r.node, r.task, d.needs FROM reach r JOIN deps d ON d.node = r.node AND d.task = r.needs)
SELECT DISTINCT r.node, r.task FROM reach r JOIN reach c ON c.node = r.node AND c.task = c.needs AND (r.needs = c.task OR r.task = c.task)""")
def cycle_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cycle_residual(T.task_cycles(spark, sf_dir))


@query("SELECT user_id AS project, event_type AS to_node, count(*) AS visits, max(ts) AS last_ts, CASE WHEN count(*) >= 20 THEN 'limit' WHEN count(*) >= 16 THEN 'near' ELSE 'ok' END AS warning FROM events GROUP BY ALL")
def transition_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = G.visits(T.transitions(spark, sf_dir))
    return v.withColumn("warning", G.visit_warning(F.col("visits"), F.lit(20)))


@query("SELECT w, count(*) AS n FROM (SELECT CASE WHEN count(*) >= 10 THEN 'limit' WHEN count(*) >= 8 THEN 'near' ELSE 'ok' END AS w FROM events GROUP BY user_id, event_type) GROUP BY w")
def visit_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = G.visits(T.transitions(spark, sf_dir))
    return v.groupBy(G.visit_warning(F.col("visits"), F.lit(0)).alias("w")).agg(F.count("*").alias("n"))


@query("SELECT from_node, to_node, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_node, event_type AS to_node FROM events) GROUP BY ALL")
def transition_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.steps(T.transitions(spark, sf_dir)).groupBy("from_node", "to_node").agg(F.count("*").alias("n"))


_LINE = """WITH t AS (SELECT 'event' AS source, event_id AS ref, ts FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END FROM lineitem), s AS (SELECT * FROM t WHERE ts IS NULL OR ts >= TIMESTAMP '1996-01-01')"""


def _timeline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = T.load(spark, sf_dir, "events").select(F.lit("event").alias("source"), F.col("event_id").alias("ref"), "ts")
    o = T.load(spark, sf_dir, "orders").select(F.lit("order").alias("source"), F.col("o_orderkey").alias("ref"), F.col("o_orderdate").alias("ts"))
    li = T.load(spark, sf_dir, "lineitem").select(F.lit("line").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("ts"))
    return G.timeline([e, o, li], "1996-01-01 00:00:00", 200)


@query(f"{_LINE} SELECT * FROM s ORDER BY ts NULLS LAST, source, ref LIMIT 200")
def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)[0]


@query(f"{_LINE} SELECT source, count(*) AS n FROM s GROUP BY source")
def timeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)[1]


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '["a",' || user_id || ']' WHEN 1 THEN '["' || event_type || '"]' WHEN 2 THEN '{"k":' || (user_id % 9) || '}' ELSE '"' || event_type || '"' END AS argument FROM events""")
def coerced_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = T.load(spark, sf_dir, "events"), F.col("event_id") % 4
    array = F.concat(F.lit('[ "a", '), F.col("user_id").cast("string"), F.lit("]"))
    value = F.when(k == 0, array).when(k == 2, F.concat(F.lit('{"k": '), (F.col("user_id") % 9).cast("string"), F.lit(" }"))).otherwise(F.col("event_type"))
    schema = F.when(k == 0, '{"type": "array"}').when(k == 1, '{"anyOf": [{"type": "null"}, {"type": "array"}]}').when(k == 2, '{"oneOf": [{"type": "object"}, {"type": "array"}]}').otherwise('{"type": "object"}')
    return e.select("event_id", FM.coerce(value, schema).alias("argument"))


# ---------------------------------------------------------------- events

_FOLD = f"""WITH RECURSIVE {Q.EDITS}, o AS (SELECT *, epoch(ts) AS t, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS k FROM edits)"""


@query(f"""{_FOLD}, f AS (SELECT key, k, seq, t AS last, true AS took FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, o.seq, CASE WHEN o.t - last >= 21600 THEN o.t ELSE last END, o.t - last >= 21600 FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
SELECT key, seq FROM f WHERE took""")
def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.throttle(T.edits(spark, sf_dir), "key", 21600)


@query(f"""WITH RECURSIVE {Q.EDITS}, o AS (SELECT *, epoch(ts) AS t, row_number() OVER (PARTITION BY key, file ORDER BY ts, seq) AS k FROM edits),
f AS (SELECT key, file, k, seq, t AS last, true AS took FROM o WHERE k = 1 UNION ALL SELECT o.key, o.file, o.k, o.seq, CASE WHEN o.t - last > 86400 THEN o.t ELSE last END, o.t - last > 86400 FROM f JOIN o ON o.key = f.key AND o.file = f.file AND o.k = f.k + 1)
SELECT key, file, seq FROM f WHERE took""")
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cooldown(T.edits(spark, sf_dir), ["key", "file"], 86400)


@query(f"""{_FOLD}, f AS (SELECT key, k, seq, t AS first, [file] AS got, false AS fire, 1 AS n_files FROM o WHERE k = 1
UNION ALL SELECT key, k, seq, CASE WHEN fire THEN NULL ELSE first END, CASE WHEN fire THEN []::VARCHAR[] ELSE got END, fire, len(got) FROM (
SELECT o.key, o.k, o.seq, coalesce(f.first, o.t) AS first, list_distinct(list_append(f.got, o.file)) AS got, (o.t - coalesce(f.first, o.t) >= 28800 OR len(list_distinct(list_append(f.got, o.file))) >= 5) AS fire FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1))
SELECT key, seq, n_files::INTEGER AS n_files FROM f WHERE fire""")
def batch_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.batch_trigger(T.edits(spark, sf_dir), "key", 28800, 5)


@query(f"""WITH {Q.EDITS}, g AS (SELECT *, coalesce((epoch(ts) - lag(epoch(ts)) OVER w > 7200)::INT, 1) AS starts FROM edits WINDOW w AS (PARTITION BY key ORDER BY ts, seq)),
s AS (SELECT *, (sum(starts) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM g)
SELECT key, seq, session, starts = 1 AS first_of_session, row_number() OVER (PARTITION BY key, session, file ORDER BY ts, seq) = 1 AS first_of_file FROM s""")
def session_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(T.edits(spark, sf_dir), "key", 7200)




# ---------------------------------------------------------------- smaller selections


@query("SELECT doc_id, hits FROM (SELECT doc_id, (contains(lower(coalesce(text, '')), 'the ')::INT + contains(lower(coalesce(text, '')), 'license')::INT + contains(lower(coalesce(text, '')), 'token')::INT) AS hits FROM documents) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 10")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SL.keyword_search(T.load(spark, sf_dir, "documents"), "text", "doc_id", ["the ", "License", "token"])





@query(f"""WITH {Q.NOTES}, u AS (SELECT id, w, min(i) AS i FROM (SELECT id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM notes) GROUP BY id, w),
five AS (SELECT id, list(w) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM u) WHERE r <= 5 GROUP BY id),
b AS (SELECT id, list_filter(list_distinct(regexp_extract_all(lower(left(coalesce(body, ''), 800)), '[a-záéíóúñü_][a-záéíóúñü0-9_]*')), lambda w: length(w) > 2 AND NOT list_contains({_NOTE_STOP}, w)) AS bw FROM notes),
s AS (SELECT id, type, age_s, round(len(list_intersect(coalesce(tags, []), ['erth', 'the', 'enthat', 'ededre'])) / (len(coalesce(tags, [])) + 1) * 1.5 + len(list_intersect(bw, ['erth', 'the', 'enthat', 'ededre'])) / (len(bw) + 1) * 0.4, 6) AS overlap FROM notes LEFT JOIN five USING (id) JOIN b USING (id))
SELECT id, overlap, round(overlap + CASE type WHEN 't0' THEN 0.15 WHEN 't1' THEN 0.10 WHEN 't2' THEN 0.05 ELSE 0 END + 0.05 / (1 + age_s / 86400.0), 6) AS rank FROM s WHERE overlap >= 0.08 ORDER BY rank DESC, id LIMIT 20""")
def prompt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SL.prompt_rank(T.memory_nodes(spark, sf_dir), ["erth", "the", "enthat", "ededre"], S.age_days(F.col("mtime"), T.as_of()))


@query(rf"""WITH {Q.PATHS}, f AS (SELECT DISTINCT path AS file FROM paths), t AS (SELECT unnest(['src/services/authService.ts', 'lib/utils/router.js', 'src/api/handlers/theme.go', 'src/other/index.ts']) AS target),
p AS (SELECT target, file, lower(regexp_replace(regexp_extract(target, '[^/]*$'), '(.)\.[^.]+$', '\1')) AS ts, lower(regexp_replace(regexp_extract(file, '[^/]*$'), '(.)\.[^.]+$', '\1')) AS fs, lower(regexp_replace(target, '/[^/]*$', '')) AS tu, lower(regexp_replace(file, '/[^/]*$', '')) AS fu FROM t, f),
s AS (SELECT target, file, CASE WHEN ts = fs THEN 3.0 WHEN contains(ts, fs) OR contains(fs, ts) THEN 1.5 ELSE 0.0 END + 0.5 * n + CASE WHEN tu = fu THEN 1.0 ELSE 0.0 END AS score FROM (
SELECT *, len(list_intersect(list_distinct(string_split(tu, '/') || [ts]), list_distinct(string_split(fu, '/') || [fs]))) AS n FROM p) WHERE n > 0)
SELECT target, file, score::DOUBLE AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, file) AS place FROM s WHERE score >= CASE WHEN contains(target, 'index') THEN 0.5 ELSE 1.0 END) WHERE place <= 2""")
def similar_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.sql("select explode(array('src/services/authService.ts', 'lib/utils/router.js', 'src/api/handlers/theme.go', 'src/other/index.ts')) as path")
    return SL.similar_paths(T.paths(spark, sf_dir).select("path").distinct(), targets, generic=("index",))


@query("""WITH r AS (SELECT * FROM (VALUES (0, ['*']), (1, ['click', 'view']), (2, ['error'])) v(node, tools))
SELECT node, tool, n, (coalesce(list_contains(tools, '*') OR list_contains(tools, tool), false) AND tool NOT IN ('signup')) AS blocked FROM (SELECT user_id % 4 AS node, CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'error' ELSE event_type END AS tool, count(*) AS n FROM events GROUP BY ALL) LEFT JOIN r USING (node)""")
def blocked_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every second sign-up goes through a proxy to another tool.
    inner = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), "error")
    calls = T.load(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("node"), F.col("event_type").alias("tool"), inner.alias("inner"))
    rules = spark.sql("select * from values (0L, array('*')), (1L, array('click', 'view')), (2L, array('error')) as v(node, tools)")
    return SL.blocked(calls, rules, ["signup"]).groupBy("node", "tool", "blocked").agg(F.count("*").alias("n"))


@query(r"""SELECT needs, count(*) AS n FROM (SELECT regexp_extract(trim(lower(text)), '^[^ \t\n\x0B\f\r]*') NOT IN ('the', 'of', 'de', 'la') AS needs FROM documents WHERE text IS NOT NULL) GROUP BY needs""")
def snapshot_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.load(spark, sf_dir, "documents").where("text is not null")
    return rows.groupBy(SL.needs_snapshot(F.lower("text"), ["the", "of", "de", "la"]).alias("needs")).agg(F.count("*").alias("n"))


@query(f"""WITH {Q.FINDINGS}, r AS (SELECT *, greatest(count(*) OVER (PARTITION BY file) - 5, 0) AS more, row_number() OVER (PARTITION BY file ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, l_orderkey, l_linenumber) AS place FROM findings WHERE current)
SELECT file, place, severity, more, l_orderkey, l_linenumber FROM r WHERE place <= 5""")
def severity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SL.capped(T.findings(spark, sf_dir).where("current"), "file", ["l_orderkey", "l_linenumber"]).select("file", "place", "severity", "more", "l_orderkey", "l_linenumber")


@query(f"WITH {Q.PATHS}, f AS (SELECT DISTINCT path FROM paths) SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS files FROM f GROUP BY 1")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SL.fan_out(T.paths(spark, sf_dir))


@query(f"WITH {Q.PATHS} SELECT DISTINCT string_split(path, '/')[2] AS name FROM paths WHERE starts_with(path, 'internal/') ORDER BY name")
def bounded_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SL.contexts(T.paths(spark, sf_dir), ["contexts", "internal", "src"])


@query("WITH w AS (SELECT unnest(['click', 'view', 'refund', 'error']) AS event_type) SELECT event_type, event_type IN (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error') AS present FROM w")
def language_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.sql("select explode(array('click', 'view', 'refund', 'error')) as event_type")
    return SL.presence(wanted, T.load(spark, sf_dir, "events").where("event_type <> 'error'"), "event_type")


@query(f"WITH {Q.CATALOG} SELECT seq, sha1(tool_name || ': ' || coalesce(description, '') || chr(10) || 'Params: ' || CASE WHEN seq % 3 = 0 THEN '(no params)' WHEN seq % 3 = 1 THEN 'a: int' ELSE 'a: int, b: str' END) AS h FROM catalog")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.slice(F.expr("array(named_struct('name', 'a', 'type', 'int'), named_struct('name', 'b', 'type', 'str'))"), F.lit(1), (F.col("seq") % 3).cast("int"))
    return T.catalog(spark, sf_dir).select("seq", F.sha1(SL.embedding_text(F.col("tool_name"), F.col("description"), params)).alias("h"))


@query("SELECT l_shipmode, passed, total, round(passed / total, 6) AS score FROM (SELECT l_suppkey % 5 AS l_shipmode, count(*) FILTER (l_discount <= 0.05) AS passed, count(*) AS total FROM lineitem GROUP BY 1)")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("l_shipmode"), (F.col("l_discount") <= 0.05).alias("ok"))
    return SL.health(rows, "l_shipmode")


@query("SELECT user_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors FROM events GROUP BY ALL HAVING count(*) >= 3")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n")).where("n >= 3").drop("n")
