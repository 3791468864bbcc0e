"""Queries of reports, selections and workflow state over the driver's tables."""

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
from brindle.operators import reports as R
from brindle.operators import scans as SC
from brindle.operators import search as SE
from brindle.plans import entities as Q
from brindle.plans.registry import query
from brindle.sources import tables as T

# ---------------------------------------------------------------- reports


@query("""SELECT o_custkey, 'Files: ' || CASE WHEN max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) IS NOT NULL THEN max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END)::VARCHAR ELSE coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END)::VARCHAR, '?') END
|| ', Grade: ' || CASE WHEN count(*) > 12 THEN 'A' WHEN count(*) > 8 THEN 'B' ELSE '?' END || ', Score: ' || count(*)::VARCHAR || '/100' AS line FROM orders GROUP BY o_custkey""")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.load(spark, sf_dir, "orders")
    last = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    n = F.count("*")
    rows = o.groupBy("o_custkey").agg(last("O").alias("total_files"), last("F").alias("totalFiles"), F.when(n > 12, "A").when(n > 8, "B").alias("grade"), F.lit(None).cast("int").alias("codebase_score"), n.alias("score"))
    return rows.select("o_custkey", R.stats_line().alias("line"))


@query(f"""WITH {Q.FINDINGS}, s AS (SELECT l_orderkey % 50 AS project, file, count(*) * 3 AS score FROM findings GROUP BY ALL)
SELECT project, 'Grade: ' || CASE WHEN project % 7 = 0 THEN '?' ELSE 'C' END || ', Score: ' || project::VARCHAR || '/100, Hotspots: ' || count(*) FILTER (score > 60)::VARCHAR || ' files' AS line FROM s GROUP BY project""")
def debt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.findings(spark, sf_dir).groupBy((F.col("l_orderkey") % 50).alias("project"), "file").agg((F.count("*") * 3).alias("file_score"))
    return R.debt(n.withColumns({"grade": F.when(F.col("project") % 7 != 0, "C"), "codebase_score": F.col("project")}), "project")


@query(f"""WITH {Q.FINDINGS}, p AS (SELECT o_orderkey AS project FROM orders), g AS (SELECT project, count(severity) AS total, count(*) FILTER (status = 'open') AS o, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h,
count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM p LEFT JOIN findings ON l_orderkey = project GROUP BY project)
SELECT project, CASE WHEN total = 0 THEN 'No security findings' WHEN o = 0 THEN 'Security: ' || total || ' total findings (all resolved/suppressed)' ELSE 'Security: ' || o || ' open findings (' || array_to_string(list_filter(
[CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN h > 0 THEN h || ' high' END, CASE WHEN m > 0 THEN m || ' medium' END, CASE WHEN l > 0 THEN l || ' low' END], lambda x: x IS NOT NULL), ', ') || ')' END AS line FROM g""")
def security_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"))
    rows = orders.join(T.findings(spark, sf_dir), F.col("project") == F.col("l_orderkey"), "left")
    return R.security(rows, "project")


@query(f"""WITH {Q.FINDINGS}, n AS (SELECT file, CASE WHEN severity = 'low' THEN 'unknown' ELSE type END AS type, count(*) AS n FROM findings GROUP BY ALL)
SELECT file, sum(n)::BIGINT || ' tensions (' || string_agg(n || ' ' || type, ', ' ORDER BY type) || ')' AS line FROM n GROUP BY file""")
def tension_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.findings(spark, sf_dir)
    return R.tensions(f.select("file", F.when(F.col("severity") != "low", F.col("type")).alias("type")), "file")


@query(f"""WITH {Q.PATHS}, f AS (SELECT doc_id, text, [p1, p2, p3, p4][1:(doc_id % 5)::INT] AS files FROM documents, (SELECT 'a.py' AS p1, 'b.go' AS p2, 'c.ts' AS p3, 'd.rs' AS p4))
SELECT doc_id, left(text, 300) || CASE WHEN len(files) > 0 THEN ' (files: ' || array_to_string(files[1:3], ', ') || ')' ELSE '' END AS line FROM f WHERE coalesce(text, '') <> ''""")
def fix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.slice(F.array(*map(F.lit, ("a.py", "b.go", "c.ts", "d.rs"))), F.lit(1), (F.col("doc_id") % 5).cast("int"))
    return T.load(spark, sf_dir, "documents").select("doc_id", R.fix_line(F.col("text"), files).alias("line")).where("line is not null")


@query("""WITH t AS (SELECT conv_id, turn, role, text, length(text) AS n, sum(length(text)) OVER w AS used FROM conversations WHERE coalesce(text, '') <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, coalesce(max((used > 480)::INT) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM t WHERE used - n <= 480)
SELECT conv_id, turn, CASE WHEN used > 480 THEN left(text, greatest(50, 480 - (used - n))::INT) || '...' ELSE text END AS text FROM e WHERE ended = 0""")
def analysis_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return M.cut_to_budget(rows, "text", ["turn", "role"], "conv_id", 120).select("conv_id", "turn", "text")


_PHASE = "CASE l_orderkey % 4 WHEN 0 THEN 'Validate all' WHEN 1 THEN 'code review' ELSE 'build' END"


@query(f"""WITH {Q.FINDINGS}, f AS (SELECT type, unit, severity, l_orderkey % 40 AS project, l_orderkey % 4 < 2 AS whole FROM findings WHERE current), b AS (SELECT DISTINCT type, unit FROM findings WHERE NOT current),
k AS (SELECT f.*, whole OR b.unit IS NULL AS keep FROM f LEFT JOIN b USING (type, unit)), s AS (SELECT project, count(*) FILTER (keep) AS total, count(*) FILTER (NOT keep) AS noise, count(*) FILTER (keep AND severity = 'critical') AS c,
count(*) FILTER (keep AND severity = 'high') AS h, count(*) FILTER (keep AND severity = 'medium') AS m, count(*) FILTER (keep AND severity = 'low') AS l FROM k GROUP BY project),
t AS (SELECT project, string_agg(type || ': ' || n, ', ' ORDER BY type) AS types FROM (SELECT project, type, count(*) AS n FROM k WHERE keep GROUP BY ALL) GROUP BY project),
x AS (SELECT project, noise, CASE WHEN total = 0 THEN 'No actionable smells detected' ELSE total || ' smells (' || array_to_string(list_filter([CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN h > 0 THEN h || ' high' END,
CASE WHEN m > 0 THEN m || ' medium' END, CASE WHEN l > 0 THEN l || ' low' END], lambda v: v IS NOT NULL), ', ') || ') — ' || types END AS line FROM s LEFT JOIN t USING (project))
SELECT project, CASE WHEN length(line) > 80 THEN left(line, 80) || '...' ELSE line END AS smells_summary, noise AS noise_filtered FROM x""")
def mid_phase_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.findings(spark, sf_dir).drop("file").withColumnRenamed("unit", "file").withColumn("project", F.col("l_orderkey") % 40)
    node = F.when(F.col("l_orderkey") % 4 == 0, "Validate all").when(F.col("l_orderkey") % 4 == 1, "code review").otherwise("build")
    return R.mid_phase(f.where("current"), f.where("not current"), "project", node, 40)


_LINES = f"""WITH {Q.EVENTS}, e AS (SELECT seq, seq % 25 AS project, type, file_pattern, description, resolution, 1 + seq % 3 AS occurrences FROM ev)"""


@query(f"""{_LINES}, rich AS (SELECT project FROM e GROUP BY project HAVING count(*) >= 5), g AS (SELECT project, file_pattern, sum(occurrences)::BIGINT AS n, min(seq) AS first_at, arg_min(description, seq) AS d FROM e SEMI JOIN rich USING (project) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, first_at) AS place FROM g) SELECT project, place, '  - [ ] `' || file_pattern || '` (' || n || 'x) — ' || left(d, 60) AS line FROM r WHERE place <= 8 AND n >= 2""")
def hook_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.experience_events(spark, sf_dir).withColumns({"project": F.col("seq") % 25, "occurrences": 1 + F.col("seq") % 3})
    return R.hook_checklist(e, "project")


@query(f"""{_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY occurrences DESC, seq) AS place FROM e)
SELECT project, place, '- `' || file_pattern || '` (' || type || ', ×' || occurrences || '): ' || left(resolution, 80) AS line FROM r WHERE place <= 3""")
def recent_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.experience_events(spark, sf_dir).withColumns({"project": F.col("seq") % 25, "occurrences": 1 + F.col("seq") % 3})
    return R.recent_lines(e, "project")


@query("""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE '## Previous task summary (continuity context)' || chr(10) || CASE WHEN lang IS NOT NULL THEN '**Was:** ' || lang || chr(10) ELSE '' END || trim(text, E' \\n\\t\\r')
|| CASE WHEN doc_id % 14 > 0 THEN chr(10) || chr(10) || '**Files touched last time:** ' || array_to_string(list_transform(range(1, least(doc_id % 14, 10) + 1), lambda i: '`f' || i || '`'), ', ') || CASE WHEN doc_id % 14 > 10 THEN ' (+' || (doc_id % 14 - 10) || ' more)' ELSE '' END ELSE '' END
|| chr(10) || chr(10) || '_(saved 2024)_' END AS text FROM documents""")
def next_task_prelude(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 14
    files = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.concat(F.lit("f"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return T.load(spark, sf_dir, "documents").select("doc_id", R.next_task_text(F.col("text"), F.col("lang"), files, F.lit("2024")).alias("text"))


@query()
def checklist_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.experience_events(spark, sf_dir).groupBy("domain", "file_pattern").agg(F.count("*").alias("n"), F.min("description").alias("description"), F.sort_array(F.collect_set("path")).alias("paths"))
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "file_pattern", "description", "n", "paths"))), lambda x: F.struct(x["file_pattern"].alias("pattern"), x["description"].alias("description"), x["n"].alias("occurrences"), x["paths"].alias("examples")))
    notes = F.sort_array(F.collect_set("description"))
    return e.groupBy("domain").agg(F.sum("n").alias("total"), items.alias("items"), notes.alias("notes")).select("domain", R.checklist_text(F.col("domain"), F.col("total"), F.col("items"), F.col("notes")).alias("text"))


# ---------------------------------------------------------------- selections


@query(f"""WITH {Q.FINDINGS}, known AS (SELECT DISTINCT type, unit FROM findings WHERE NOT current), ed AS (SELECT DISTINCT 'f' || (event_id % 300) AS file FROM events)
SELECT type, unit, file, l_orderkey, l_linenumber FROM findings f WHERE current AND file IN (SELECT file FROM ed) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.type = f.type AND k.unit = f.unit)""")
def edited_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.findings(spark, sf_dir)
    edited = T.load(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 300).cast("string")).alias("file"))
    fresh = FI.new_since(f.where("current").withColumnRenamed("file", "own").withColumnRenamed("unit", "file"), f.where("not current").select("type", F.col("unit").alias("file")))
    fresh = fresh.withColumnRenamed("file", "unit").withColumnRenamed("own", "file")
    return FI.in_edited(fresh, edited).select("type", "unit", "file", "l_orderkey", "l_linenumber")


@query(f"""WITH {Q.FINDINGS}, f AS (SELECT l_orderkey % 60 AS node, file || '.py' AS file, severity, l_orderkey, l_linenumber, 'Look at src/f' || (l_orderkey % 60) || '.py and f1' || (l_orderkey % 10) || '.py first' AS prompt FROM findings WHERE status = 'open'),
m AS (SELECT *, len(list_filter(regexp_extract_all(prompt, '[\\w/.-]+\\.\\w+'), lambda p: contains(file, p))) > 0 AS in_prompt FROM f)
SELECT node, place, file, severity, in_prompt, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY in_prompt DESC, CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, l_orderkey, l_linenumber, file) AS place FROM m) WHERE place <= 5""")
def prompt_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.col("l_orderkey") % 60
    f = T.findings(spark, sf_dir).where("status = 'open'").withColumns({"node": node, "file": F.concat("file", F.lit(".py"))})
    prompt = F.concat(F.lit("Look at src/f"), node.cast("string"), F.lit(".py and f1"), (F.col("l_orderkey") % 10).cast("string"), F.lit(".py first"))
    rows = R.finding_lines(f.withColumn("prompt", prompt), "node", "prompt", ["l_orderkey", "l_linenumber", "file"])
    return rows.select("node", "place", "file", "severity", "in_prompt", "l_orderkey", "l_linenumber")


@query(f"""WITH {Q.FINDINGS}, n AS (SELECT c_custkey AS node, CASE c_custkey % 4 WHEN 0 THEN 'Review and test it' WHEN 1 THEN 'build' WHEN 2 THEN 'spec' ELSE 'plan' END AS text FROM customer),
a AS (SELECT node, 0 AS tier, 1::BIGINT AS nth, CASE WHEN node % 2 = 0 THEN 'go' ELSE 'python' END || '-patterns' AS skill, '' AS section FROM n UNION ALL SELECT node, 1, 0, 'dev-patterns', 'architecture.md' FROM n WHERE regexp_matches(lower(text), 'review|validate|audit|check')
UNION ALL SELECT node, 1, 1, 'qa-patterns', 'best-practices.md' FROM n WHERE regexp_matches(lower(text), 'test|verify|qa|spec') UNION ALL SELECT node, 1, 2, 'dev-patterns', 'design-patterns.md' FROM n WHERE regexp_matches(lower(text), 'implement|develop|build|create|code')
UNION ALL SELECT l_suppkey, 2, l_linenumber, 'dev-patterns', CASE type WHEN 'god_file' THEN 'design-patterns.md#single-responsibility' ELSE 'design-patterns.md#encapsulation' END FROM (SELECT DISTINCT l_suppkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'orphan_file' WHEN 'R' THEN 'god_file' ELSE 'feature_envy' END AS type FROM lineitem) WHERE type <> 'orphan_file'),
o AS (SELECT node, skill, section, min((tier, nth)) AS f FROM a GROUP BY ALL) SELECT node, place, skill, section FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY f, skill, section) AS place FROM o) WHERE place <= 5""")
def skill_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.col("c_custkey")
    text = F.when(node % 4 == 0, "Review and test it").when(node % 4 == 1, "build").when(node % 4 == 2, "spec").otherwise("plan")
    nodes = T.load(spark, sf_dir, "customer").select(node.alias("node"), text.alias("text"))
    languages = nodes.select("node", F.when(F.col("node") % 2 == 0, "go").otherwise("python").alias("language"), F.lit(1).alias("seq"))
    kind = F.when(F.col("l_returnflag") == "A", "orphan_file").when(F.col("l_returnflag") == "R", "god_file").otherwise("feature_envy")
    smells = T.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), kind.alias("type"), F.col("l_linenumber").alias("seq")).distinct()
    return FI.select_skills(nodes, languages, smells)


_CATALOG_KIND = "CASE WHEN contains(lower(description), 'run') OR contains(lower(description), 'start') OR contains(lower(description), 'stop') OR contains(lower(description), 'exec') OR contains(lower(description), 'container') OR contains(lower(description), 'docker') OR contains(lower(description), 'restart') THEN 'containers' END"


@query(f"WITH {Q.CATALOG} SELECT mcp_name, tool_name, description, seq FROM catalog WHERE {_CATALOG_KIND} = 'containers' ORDER BY seq LIMIT 20")
def tools_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.by_category(T.catalog(spark, sf_dir), "containers")


@query(f"WITH {Q.CATALOG} SELECT mcp_name, tool_name FROM catalog WHERE mcp_name <> 'm3'")
def drop_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MG.without(T.catalog(spark, sf_dir), "mcp_name", "m3").select("mcp_name", "tool_name")


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q)
SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY place > 10, CASE WHEN place <= 10 THEN -score END, place) AS rank FROM s""")
def rerank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = T.load(spark, sf_dir, "embeddings")
    placed = e.select("label", "vec_id", F.col("embedding").alias("vec"), F.row_number().over(W.partitionBy("label").orderBy("vec_id")).alias("place"))
    return SE.rerank_head(placed, e.where("vec_id = 0").select(F.col("embedding").alias("q")), "label").select("label", "vec_id", "rank")


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id % 9 AS pattern, CASE WHEN vec_id % 4 > 0 THEN round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) END AS sim FROM embeddings, q)
SELECT pattern, round(avg(coalesce(sim, 0.0)), 6) AS avg_score, count(*) AS n FROM s GROUP BY pattern""")
def pattern_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.load(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    sim = F.when(F.col("vec_id") % 4 > 0, F.round(S.cosine(F.col("embedding"), F.col("q")), 6))
    return SE.mean_similarity(e.join(q).select((F.col("vec_id") % 9).alias("pattern"), sim.alias("sim")), "pattern", "sim")


@query(f"""WITH {Q.NOTES}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT id, type, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS semantic FROM notes JOIN embeddings ON vec_id = id, q)
SELECT id, semantic, round(semantic + CASE type WHEN 't0' THEN 0.15 WHEN 't1' THEN 0.10 WHEN 't2' THEN 0.05 ELSE 0 END, 6) AS rank FROM s WHERE semantic >= 0.1 ORDER BY rank DESC, id LIMIT 20""")
def semantic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.load(spark, sf_dir, "embeddings")
    notes = T.memory_nodes(spark, sf_dir).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id")
    return M.semantic_gate(notes.select("id", "type", "vec"), e.where("vec_id = 0").select(F.col("embedding").alias("q")), 0.1)


@query(f"""WITH {Q.NOTES} SELECT id, type, 'n' || (id % 37) AS name, priority, row_number() OVER (ORDER BY priority <> 'high', type, 'n' || (id % 37), id) AS place FROM notes ORDER BY place LIMIT 50""")
def memory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.listing(T.memory_nodes(spark, sf_dir).withColumn("name", F.concat(F.lit("n"), (F.col("id") % 37).cast("string"))))


@query(f"WITH {Q.NOTES} SELECT id FROM notes WHERE id % 3 = 0 OR id % 3 = 1")
def uncached_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.memory_nodes(spark, sf_dir).select("id", "mtime")
    # A third is missing, a third is a second older, a third is as new.
    local = n.where("id % 3 > 0").withColumn("mtime", F.when(F.col("id") % 3 == 1, F.col("mtime") - F.expr("interval 1 second")).otherwise(F.col("mtime")))
    return M.uncached(n, local).select("id")


@query(f"""WITH {Q.NOTES} SELECT id, sha1('[' || type || '] n' || id || CASE WHEN id % 2 = 0 THEN chr(10) || 'about ' || type ELSE '' END || CASE WHEN trim(coalesce(body, ''), E' \\n\\t\\r') <> '' THEN chr(10) || trim(body, E' \\n\\t\\r') ELSE '' END) AS h FROM notes""")
def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = F.when(F.col("id") % 2 == 0, F.concat(F.lit("about "), F.col("type")))
    text = X.context_text(F.col("type"), F.concat(F.lit("n"), F.col("id").cast("string")), about, F.col("body"))
    return T.memory_nodes(spark, sf_dir).select("id", F.sha1(text).alias("h"))


@query(f"""WITH {Q.PATHS}, d AS (SELECT seq, CASE seq % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'x/dist/' WHEN 2 THEN 'tests/' ELSE '' END || path || CASE WHEN seq % 11 = 0 THEN '.lock' ELSE '' END AS path FROM paths)
SELECT regexp_matches(path, 'node_modules/|dist/|\\.lock$') AS skipped, regexp_matches(lower(path), 'test_|_test\\.|\\.test\\.|\\.spec\\.|tests/|test/') AS test, regexp_matches(regexp_extract(path, '[^/]*$'), '_test\\.go|\\.test\\.|\\.spec\\.|^test_|_test\\.py$') AS strict, count(*) AS n FROM d GROUP BY ALL""")
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("seq") % 6
    folder = F.when(k == 0, "node_modules/").when(k == 1, "x/dist/").when(k == 2, "tests/").otherwise("")
    path = F.concat(folder, F.col("path"), F.when(F.col("seq") % 11 == 0, ".lock").otherwise(""))
    rows = T.paths(spark, sf_dir).withColumn("path", path)
    return rows.groupBy(X.skipped(F.col("path")).alias("skipped"), X.is_test(F.col("path")).alias("test"), X.is_test_name(F.col("path")).alias("strict")).agg(F.count("*").alias("n"))


@query(f"""WITH {Q.PATHS}, f AS (SELECT DISTINCT seq % 20 AS project, path, CASE WHEN contains(path, 'theme') THEN 0 ELSE 100 END AS length FROM paths),
c AS (SELECT project, path, CASE WHEN regexp_matches(path, 'services/.*\\.ts$') THEN 0 WHEN regexp_matches(path, '\\.go$') THEN 1 WHEN regexp_matches(path, '\\.(ts|css|py)$') THEN 2 END AS nth FROM f WHERE length > 0 AND NOT contains(path, 'lib/') AND NOT contains(lower(path), 'login'))
SELECT project, row_number() OVER (PARTITION BY project ORDER BY nth, len(string_split(path, '/')), regexp_extract(path, '[^/]*$'), path) AS place, path FROM c WHERE nth IS NOT NULL""")
def representative_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.paths(spark, sf_dir).select((F.col("seq") % 20).alias("project"), "path", F.when(F.col("path").contains("theme"), 0).otherwise(100).alias("length"))
    return SC.representative(files, [r"services/.*\.ts$", r"\.go$", r"\.(ts|css|py)$"], "project", ["LOGIN"], ["lib/"])


@query("""WITH m AS (SELECT c_custkey % 300 AS project, CASE c_custkey % 5 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'Cargo.toml' WHEN 2 THEN 'pyproject.toml' WHEN 3 THEN 'setup.py' ELSE 'README' END AS name,
CASE c_mktsegment WHEN 'BUILDING' THEN 'x github.com/gin-gonic/gin axum FastAPI' WHEN 'MACHINERY' THEN 'tauri django flask google.golang.org/grpc' ELSE 'none' END AS text FROM customer),
r AS (SELECT project, CASE name WHEN 'go.mod' THEN 'go' WHEN 'Cargo.toml' THEN 'rust' ELSE 'python' END AS language, CASE WHEN name = 'go.mod' AND contains(text, 'gin') THEN ['gin'] WHEN name = 'go.mod' AND contains(text, 'grpc') THEN ['grpc'] WHEN name = 'Cargo.toml' AND contains(text, 'axum') THEN ['axum']
WHEN name = 'Cargo.toml' AND contains(text, 'tauri') THEN ['tauri'] WHEN name = 'pyproject.toml' AND contains(text, 'FastAPI') THEN ['fastapi'] WHEN name = 'pyproject.toml' AND contains(text, 'django') THEN ['django', 'flask'] ELSE [NULL] END AS found FROM m WHERE name <> 'README')
SELECT DISTINCT project, language, unnest(found) AS framework FROM r""")
def tech_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, seg = F.col("c_custkey") % 5, F.col("c_mktsegment")
    name = F.when(k == 0, "go.mod").when(k == 1, "Cargo.toml").when(k == 2, "pyproject.toml").when(k == 3, "setup.py").otherwise("README")
    text = F.when(seg == "BUILDING", "x github.com/gin-gonic/gin axum FastAPI").when(seg == "MACHINERY", "tauri django flask google.golang.org/grpc").otherwise("none")
    return SC.tech_stack(T.load(spark, sf_dir, "customer").select((F.col("c_custkey") % 300).alias("project"), name.alias("name"), text.alias("text")))


@query(f"""WITH {Q.CATALOG}, new AS (SELECT mcp_name, tool_name, sha1(coalesce(CASE WHEN seq % 10 = 0 THEN description || '!' ELSE description END, '') || chr(10) || '{{}}') AS text_hash FROM catalog), old AS (SELECT DISTINCT mcp_name, tool_name, sha1(coalesce(description, '') || chr(10) || '{{}}') AS text_hash, true AS hit FROM catalog WHERE seq % 7 <> 0)
SELECT coalesce(hit, false) AS hit, count(*) AS n FROM new LEFT JOIN old USING (mcp_name, tool_name, text_hash) GROUP BY 1""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.catalog(spark, sf_dir)
    new = c.withColumn("description", F.when(F.col("seq") % 10 == 0, F.concat("description", F.lit("!"))).otherwise(F.col("description")))
    hashed = lambda d: d.select("mcp_name", "tool_name", X.change_hash(F.col("description"), F.lit("{}")).alias("text_hash"))
    return MG.hits_and_misses(hashed(c.where("seq % 7 <> 0")), hashed(new), ["mcp_name", "tool_name"], "text_hash").groupBy("hit").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, 'R  a/b' || (event_id % 5) || '.py -> c/d' || (event_id % 3) || '.py' AS r, '?? "x y/' || event_type || '.ts"' AS n FROM events), l AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN r ELSE n END AS line FROM e)
SELECT left(line, 2) AS code, CASE WHEN contains(line, ' -> ') THEN regexp_extract(line, ' -> (.*)$', 1) ELSE trim(substring(line, 4), '" ') END AS path, count(*) AS n FROM l GROUP BY ALL""")
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = T.load(spark, sf_dir, "events"), F.col("event_id")
    moved = F.concat(F.lit("R  a/b"), (k % 5).cast("string"), F.lit(".py -> c/d"), (k % 3).cast("string"), F.lit(".py"))
    line = F.when(k % 2 == 0, moved).otherwise(F.concat(F.lit('?? "x y/'), F.col("event_type"), F.lit('.ts"')))
    rows = e.select(line.alias("line"))
    return rows.groupBy(X.status_code(F.col("line")).alias("code"), X.status_path(F.col("line")).alias("path")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id, 'see src/a' || doc_id || '.py, b.ts and b.ts: ' || doc_id || ' smells' AS t FROM documents)
SELECT doc_id, array_to_string(['src/a' || doc_id || '.py', 'b.ts'], ',') AS files, 'src/a' || doc_id || '.py' AS source, doc_id::INT AS smells FROM t""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    rows = T.load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see src/a"), k, F.lit(".py, b.ts and b.ts: "), k, F.lit(" smells")).alias("t"))
    return rows.select("doc_id", F.array_join(X.mentioned_files(F.col("t")), ",").alias("files"), X.mentioned_source(F.col("t")).alias("source"), X.said_smells(F.col("t")).alias("smells"))


# ---------------------------------------------------------------- gates

_GATE = f"WITH {Q.FINDINGS}, g AS (SELECT type, severity, description, unit AS file, l_orderkey % 100 AS node, l_orderkey, l_linenumber FROM findings WHERE current)"


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.findings(spark, sf_dir).where("current").drop("file").withColumnRenamed("unit", "file").withColumn("node", F.col("l_orderkey") % 100)


@query(f"""{_GATE} SELECT node, place, type, severity, description FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY l_orderkey, l_linenumber, file, type) AS place FROM g WHERE severity IN ('high', 'critical')) WHERE place <= 5""")
def gate_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.gate_details(_gate(spark, sf_dir), "node", "high", ["l_orderkey", "l_linenumber", "file", "type"])


@query(f"""{_GATE.replace("l_orderkey % 100 AS node", "l_orderkey AS node")}, b AS (SELECT * FROM g WHERE severity = 'critical'), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY l_orderkey, l_linenumber, file, type) AS r FROM b),
e AS (SELECT node, 'gate_blocked' AS type, {Q.pattern("file")} AS file_pattern, {Q.domain("file")} AS domain, 'critical' AS severity FROM r WHERE r <= 3
UNION ALL SELECT node, 'gate_resolved', 'workflow/' || node, 'config', 'low' FROM (SELECT DISTINCT node FROM g WHERE node % 3 > 0) ANTI JOIN b USING (node))
SELECT node, type, file_pattern, domain, severity, unnest(['project', 'global']) AS scope FROM e""")
def gate_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gate(spark, sf_dir).withColumn("node", F.col("l_orderkey"))
    attempts = g.select("node").distinct().withColumn("attempts", F.col("node") % 3)
    return FI.gate_experience(g, "node", "critical", ["l_orderkey", "l_linenumber", "file", "type"], attempts)


@query(f"""{_GATE}, s AS (SELECT node, count(*) FILTER (severity = 'critical' AND node % 2 = 0) AS critical, count(*) FILTER (severity = 'high' AND node % 3 = 0) AS high FROM g GROUP BY node)
SELECT node, critical, high, CASE WHEN node % 5 > 0 THEN 'C' END AS grade, 'Security: ' || concat_ws(', ', CASE WHEN critical > 0 THEN critical || ' CRITICAL' END, CASE WHEN high > 0 THEN high || ' high' END) || ' findings (grade ' || CASE WHEN node % 5 > 0 THEN 'C' ELSE '?' END || ')' AS line FROM s WHERE critical > 0 OR high > 0""")
def security_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.col("node")
    n = _gate(spark, sf_dir).groupBy("node").agg(F.count_if((F.col("severity") == "critical") & (node % 2 == 0)).alias("critical"), F.count_if((F.col("severity") == "high") & (node % 3 == 0)).alias("high"))
    return FI.security_counters(n.withColumn("grade", F.when(node % 5 > 0, "C")))


@query("""SELECT c_custkey AS node, r AS runs, CASE WHEN NOT r THEN '' WHEN c_custkey % 4 = 0 THEN 'debt' ELSE 'smells,tensions' END AS analyses, CASE WHEN NOT r THEN 0 WHEN c_custkey % 6 = 0 THEN 100 ELSE 400 END::INTEGER AS token_budget
FROM (SELECT c_custkey, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 5 <> 0 AS r FROM customer)""")
def analysis_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    yes = lambda c: F.when(c, False)
    nodes = T.load(spark, sf_dir, "customer").select(k.alias("node"), yes(k % 7 == 0).alias("available"), yes(k % 11 == 0).alias("switched_on"), yes(k % 5 == 0).alias("own_on"), F.when(k % 4 == 0, F.array(F.lit("debt"))).alias("analyses"), F.when(k % 6 == 0, 100).alias("token_budget"))
    return FI.analysis_plan(nodes, ["smells", "tensions"]).withColumn("analyses", F.array_join("analyses", ","))


@query("SELECT user_id % 40 AS project, count(DISTINCT event_id % 23) AS changed, CASE WHEN count(DISTINCT event_id % 23) <= 20 THEN 'incremental' ELSE 'full' END AS mode FROM events GROUP BY 1")
def reindex_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.load(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("project"), (F.col("event_id") % 23).alias("file"))
    return FI.reindex_plan(e, "project")


@query(f"""WITH {Q.EDITS}, g AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, seq) AS later FROM edits) SELECT key, seq, ts + INTERVAL 6 HOUR AS stopped_at FROM g WHERE later IS NULL OR later - ts >= INTERVAL 6 HOUR""")
def idle_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.idle_stops(T.edits(spark, sf_dir), "key", 21600)


@query(f"""WITH {Q.NOTES}, r AS (SELECT type, id, sum(length(coalesce(body, ''))) OVER (PARTITION BY type ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM notes) SELECT type, id FROM r WHERE used <= 20000""")
def section_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.memory_nodes(spark, sf_dir).withColumn("size", F.length(F.coalesce("body", F.lit(""))))
    return M.pack_prefix(rows, "size", ["id"], ["type"], 20000, separator=0).select("type", "id")


# ---------------------------------------------------------------- workflow state

_LOG = """log AS (SELECT user_id AS project, event_id AS seq, ts, event_type AS to_node, event_id % 40 = 0 AS reset FROM events), ep AS (SELECT *, count(*) FILTER (reset) OVER (PARTITION BY project ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS epoch FROM log),
att AS (SELECT *, row_number() OVER (PARTITION BY project, epoch, to_node ORDER BY ts, seq) AS visit FROM ep WHERE NOT reset),
st AS (SELECT project, epoch, arg_max(to_node, (ts, seq)) FILTER (visit <= 5) AS current_node, count(*) FILTER (visit <= 5) AS transitions, count(*) FILTER (visit > 5) AS refused, arg_max(visit, (ts, seq)) FILTER (visit <= 5) AS visits, max(ts) FILTER (visit <= 5) AS last_activity FROM att GROUP BY ALL),
states AS (SELECT project, current_node, transitions, refused, visits, last_activity FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY epoch DESC) AS r FROM st) WHERE r = 1)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.transitions(spark, sf_dir).withColumn("reset", F.col("seq") % 40 == 0)


@query(f"WITH {_LOG} SELECT project, seq, visit, visit <= 5 AS taken FROM att")
def transitions_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.taken(_log(spark, sf_dir), 5).select("project", "seq", "visit", "taken")


@query(f"WITH {_LOG} SELECT * FROM states")
def graph_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.states(_log(spark, sf_dir), 5)


@query(f"""WITH {_LOG}, kinds AS (SELECT DISTINCT event_type AS id FROM events), nodes AS (SELECT id, CASE WHEN id IN ('click', 'view', 'error') THEN 'dag' ELSE 'wave' END AS node_type, 6 AS max_visits FROM kinds),
edges AS (SELECT a.id AS src, b.id AS dst, length(b.id) AS priority, row_number() OVER (ORDER BY a.id, b.id) AS seq FROM kinds a, kinds b WHERE a.id < b.id), ways AS (SELECT src AS id, string_agg(dst, ',' ORDER BY priority, seq) AS ways FROM edges GROUP BY src),
tasks AS (SELECT id AS node, t AS task, t <= length(id) - 3 AS done FROM kinds, range(1, 6) r(t)), w AS (SELECT node AS id, count(*) AS tasks, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done AND task = greatest(length(node) - 3, 0) + 1) AS ready FROM tasks GROUP BY node)
SELECT project, current_node, coalesce(ways, '') AS ways, CASE WHEN visits >= 6 THEN 'limit' WHEN visits >= 4.8 THEN 'near' ELSE 'ok' END AS warning, CASE WHEN node_type = 'dag' THEN tasks END AS tasks, CASE WHEN node_type = 'dag' THEN completed END AS completed,
CASE WHEN node_type = 'dag' THEN ready END AS ready, CASE WHEN node_type = 'dag' THEN tasks - completed - ready END AS blocked FROM states LEFT JOIN nodes ON current_node = id LEFT JOIN ways USING (id) LEFT JOIN w USING (id)""")
def graph_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = T.load(spark, sf_dir, "events").select(F.col("event_type").alias("id")).distinct()
    nodes = kinds.select("id", F.when(F.col("id").isin("click", "view", "error"), "dag").otherwise("wave").alias("node_type"), F.lit(6).alias("max_visits"))
    edges = kinds.select(F.col("id").alias("src")).join(kinds.select(F.col("id").alias("dst")), F.col("src") < F.col("dst")).withColumns({"priority": F.length("dst"), "seq": F.col("dst")})
    tasks = kinds.select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("task")).withColumn("done", F.col("task") <= F.length("node") - 3)
    deps = tasks.where("task > 1").select("node", "task", (F.col("task") - 1).alias("needs"))
    return G.status(G.states(_log(spark, sf_dir), 5).select("project", "current_node", "visits"), nodes, edges, tasks, deps)


@query("""WITH l AS (SELECT DISTINCT user_id AS project, event_type AS node, 't:' || (event_id % 6) AS task, max(ts) AS ts FROM events GROUP BY 1, 2, 3) SELECT project, node, string_agg(task, ',' ORDER BY task) AS tasks, max(ts) AS last FROM l GROUP BY project, node""")
def completed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.load(spark, sf_dir, "events")
    return G.completed_tasks(e.select(F.col("user_id").alias("project"), F.concat("event_type", F.lit(":t:"), (F.col("event_id") % 6).cast("string")).alias("key"), "ts"))


@query(f"""WITH {Q.TASKS}, after AS (SELECT node, task, done OR task = 2 AS done FROM tasks), rb AS (SELECT t.node, t.task FROM tasks t WHERE NOT done AND NOT EXISTS (SELECT 1 FROM deps d LEFT JOIN tasks n ON n.node = d.node AND n.task = d.needs AND n.done WHERE d.node = t.node AND d.task = t.task AND n.node IS NULL)),
ra AS (SELECT t.node, t.task FROM after t WHERE NOT done AND NOT EXISTS (SELECT 1 FROM deps d LEFT JOIN after n ON n.node = d.node AND n.task = d.needs AND n.done WHERE d.node = t.node AND d.task = t.task AND n.node IS NULL))
SELECT DISTINCT a.node, a.task, CASE WHEN ra.node IS NULL THEN 'blocked' WHEN rb.node IS NULL THEN 'newly_ready' ELSE 'still_ready' END AS state FROM after a LEFT JOIN ra ON ra.node = a.node AND ra.task = a.task LEFT JOIN rb ON rb.node = a.node AND rb.task = a.task WHERE NOT done""")
def ready_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, deps = T.tasks(spark, sf_dir)
    return G.ready_delta(tasks, deps, tasks.where("task = 2"))


@query(f"WITH {Q.TASKS}, d AS (SELECT node, task, needs + CASE WHEN node % 11 = 0 THEN 100 ELSE 0 END AS needs FROM deps) SELECT d.node, d.task, d.needs FROM d WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.node = d.node AND t.task = d.needs)")
def unknown_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, deps = T.tasks(spark, sf_dir)
    return G.unknown_needs(tasks, deps.withColumn("needs", F.col("needs") + F.when(F.col("node") % 11 == 0, 100).otherwise(0))).select("node", "task", "needs")


@query("SELECT n_regionkey AS graph, coalesce(min(n_nationkey) FILTER (n_nationkey % 4 = 3), min(n_nationkey)) AS start FROM nation GROUP BY n_regionkey")
def start_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 4 == 3).alias("is_start"), F.col("n_nationkey").alias("seq"))
    return G.start_node(n, "graph")


@query("SELECT user_id, event_type, CASE event_type WHEN 'click' THEN 'bug_fix' WHEN 'view' THEN 'feature_pattern' WHEN 'purchase' THEN 'refactor_pattern' ELSE 'general' END AS kind, count(*) AS n FROM events GROUP BY ALL")
def commit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_type")
    message = F.concat(F.when(k == "click", "Fix: ").when(k == "view", "feat(x): ").when(k == "purchase", "REFACTOR ").otherwise("docs: perf "), k)
    return T.load(spark, sf_dir, "events").groupBy("user_id", "event_type", X.commit_type(message).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM b WHERE vec_id = 0) SELECT vec_id, round(0.60 * round(list_cosine_similarity(e, q), 6) + 0.40 * ((vec_id % 10) / 10.0), 5) AS score FROM b, q""")
def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.load(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    semantic = F.round(S.cosine(F.col("embedding"), F.col("q")), 6)
    return e.join(q).select("vec_id", F.round(S.blend(semantic, (F.col("vec_id") % 10) / F.lit(10.0)), 5).alias("score"))
