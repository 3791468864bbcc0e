"""Driver tables, and the engine's entities derived from them by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X

#: The time against which ages are taken.
AS_OF = "2024-02-01 00:00:00"

# Files that event rows speak of, by number modulo their count.
FOLDERS = ["src/services", "src/components", "lib/utils", "src/api/handlers", "internal/orders/domain", "src/features/cart/store"]
FILES = ["authService.ts", "LoginForm.tsx", "date-helper.js", "user_model.py", "router.go", "theme.css", "index.test.ts"]


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mcp_name, tool_name, description, embedding."""
    e, d = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "documents")
    return e.join(d, e["vec_id"] == d["doc_id"]).select(
        F.concat(F.lit("m"), e["label"].cast("string")).alias("mcp_name"), F.concat(F.lit("tool_"), e["vec_id"].cast("string")).alias("tool_name"),
        F.substring("text", 1, 150).alias("description"), "embedding", e["vec_id"].alias("seq"),
    )


def event_path() -> Column:
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("event_id") % len(FOLDERS) + 1).cast("int"))
    file = F.element_at(F.array(*map(F.lit, FILES)), (F.col("user_id") % len(FILES) + 1).cast("int"))
    return F.concat(folder, F.lit("/"), file)


def experience_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, scope, type, path, file_pattern, domain, description, severity, resolution, related, seen."""
    e = load(spark, sf_dir, "events").withColumn("path", event_path())
    # Paths repeat, so what follows from a path alone is worked out once a path.
    paths = e.select("path").distinct().select("path", X.generalize(F.col("path")).alias("file_pattern"), X.domain(F.col("path")).alias("domain"))
    e = e.join(paths, "path")
    sev = F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "medium").when(F.col("value") < 90, "high").otherwise("critical")
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "project").otherwise("global").alias("scope"), F.col("event_type").alias("type"), "path",
        "file_pattern", "domain",
        F.concat(F.lit("note "), F.repeat(F.lit("x"), (F.col("event_id") % 11).cast("int")), F.lit(" "), (F.col("event_id") % 97).cast("string")).alias("description"),
        sev.alias("severity"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("fix "), (F.col("event_id") % 13).cast("string"))).otherwise("").alias("resolution"),
        F.concat(F.lit("f"), (F.col("event_id") % 17).cast("string")).alias("related"), F.col("ts").alias("seen"),
    )


def memory_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, tags, links, priority, ttl, body, mtime."""
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    k = F.col("doc_id") % 5
    ttl = F.when(k == 1, "90d").when(k == 2, "4w").when(k == 3, "48h").when(k == 4, "soon")
    tags = F.slice(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \n]+"), lambda w: w != "")), 1, 5)
    priority = F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "high").otherwise("normal")
    hours = (F.unix_micros(as_of().cast("timestamp")) - F.col("doc_id") * 3_600_000_000).cast("bigint")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string")).alias("type"), tags.alias("tags"),
        F.array(F.col("doc_id") + 1, F.col("doc_id") + 7).alias("links"), priority.alias("priority"), ttl.alias("ttl"), F.col("text").alias("body"),
        F.timestamp_micros(hours).cast("timestamp_ntz").alias("mtime"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, severity, file, unit (part and supplier), description, current (baseline: false), status."""
    q = F.col("l_quantity")
    sev = F.when(q < 15, "low").when(q < 30, "medium").when(q < 45, "high").otherwise("critical")
    kind = F.when(F.col("l_returnflag") == "A", "orphan_file").when(F.col("l_returnflag") == "R", "god_file").otherwise("feature_envy")
    return load(spark, sf_dir, "lineitem").select(
        kind.alias("type"), sev.alias("severity"), F.concat(F.lit("f"), (F.col("l_partkey") % 500).cast("string")).alias("file"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("/s"), F.col("l_suppkey").cast("string")).alias("unit"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("description"), (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("current"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("resolved").alias("status"), "l_orderkey", "l_linenumber",
    )


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, ts (day), smell_count, debt_score, risk_grade."""
    e = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("project"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("ts"))
    out = e.agg(F.count("*").alias("smell_count"), F.round(F.avg("value"), 6).alias("debt_score"))
    n = F.col("smell_count")
    return out.withColumn("risk_grade", F.when(n < 10, "A").when(n < 15, "B").when(n < 18, "C").otherwise("D"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, seq, ts, to_node."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("to_node"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, is_start, is_end) and edges(src, dst, priority, seq, kind, tool, phrase) over nations, customers and suppliers."""
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = r.select(name("r", "r_regionkey").alias("id")).unionByName(n.select(name("n", "n_nationkey").alias("id")))
    nodes = nodes.unionByName(c.select(name("c", "c_custkey").alias("id"))).unionByName(s.select(name("s", "s_suppkey").alias("id")))
    nodes = nodes.withColumn("is_start", F.col("id") == "r0").withColumn("is_end", F.col("id").rlike("^[cs]"))
    kind = F.when(F.col("seq") % 4 == 0, "tool").when(F.col("seq") % 4 == 1, "phrase").when(F.col("seq") % 4 == 2, "default").otherwise("always")
    down = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.col("n_nationkey").cast("bigint").alias("seq"))
    leaf = c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"), (F.col("c_custkey") + 100).cast("bigint").alias("seq"))
    more = s.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst"), (F.col("s_suppkey") + 100).cast("bigint").alias("seq"))
    loop = n.where("n_nationkey % 6 = 1").select(name("n", "n_nationkey").alias("src"), name("x", "n_nationkey").alias("dst"), (F.col("n_nationkey") + 1000).cast("bigint").alias("seq"))
    edges = down.unionByName(leaf).unionByName(more).unionByName(loop)
    # Half of the default edges name no tool and no phrase.
    given = lambda c: F.when(F.col("seq") % 8 != 2, c)
    return nodes, edges.select(
        "src", "dst", "seq", (F.col("seq") % 7).alias("priority"), kind.alias("kind"),
        given(F.concat(F.lit("tool_"), (F.col("seq") % 5).cast("string"))).alias("tool"), given(F.concat(F.lit("go "), (F.col("seq") % 3).cast("string"))).alias("phrase"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """tasks(node, task, done) and deps(node, task, needs) over the lines of orders."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").cast("bigint").alias("task"), (F.col("l_linestatus") == "F").alias("done"))
    return rows, rows.where("task > 1").select("node", "task", (F.col("task") - 1).alias("needs"))


def task_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deps(node, task, needs) of all orders, with loops in every fifth."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").cast("bigint").alias("task"))
    back = rows.where("node % 5 = 0 and task = 2").select("node", F.lit(2).cast("bigint").alias("task"), F.lit(3).cast("bigint").alias("needs"))
    return rows.where("task > 1").select("node", "task", (F.col("task") - 1).alias("needs")).unionByName(back).distinct()


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, path of every event."""
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), event_path().alias("path"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (the user), seq, ts, file of edit events."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("file"))
