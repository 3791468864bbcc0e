"""Readers and writers of the stores' formats, as DataFrames."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import constants as C

ENTRY = (
    "id string, type string, file_pattern string, keywords array<string>, domain string, description string, severity string, confidence double, occurrences int, "
    "first_seen string, last_seen string, project_origin string, resolution string, related_files array<string>, scope string"
)


def read_experience(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON envelopes; unknown fields are dropped, missing ones null."""
    return spark.read.schema(f"entries array<struct<{ENTRY.replace(' string', ':string').replace(' array', ':array').replace(' double', ':double').replace(' int', ':int')}>>").json(path, multiLine=True).select(F.inline("entries"))


def write_experience(entries: DataFrame, path: str, most: int = C.STORE_ROWS) -> None:
    """A store as one JSON envelope: the ``most`` entries of greatest confidence, then latest sight."""
    kept = entries.orderBy(F.desc("confidence"), F.desc("last_seen")).limit(most)
    one = kept.agg(F.collect_list(F.struct(*entries.columns)).alias("entries"), F.count("*").alias("count"))  # at most ``most`` entries
    one.coalesce(1).write.mode("overwrite").json(path)


def write_catalog(tools: DataFrame, path: str) -> None:
    """Tools by server: a later write replaces only the servers that it holds."""
    tools.write.partitionBy("mcp_name").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_catalog(spark: SparkSession, path: str, mcp: str | None = None) -> DataFrame:
    """All tools, or those of one server, for which only its partition is read."""
    rows = spark.read.parquet(path)
    return rows if mcp is None else rows.where(F.col("mcp_name") == mcp)


def drop_from_catalog(spark: SparkSession, path: str, mcp: str) -> bool:
    """Delete a server's partition; whether there was one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/mcp_name={mcp}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes with frontmatter: path, mtime, fields (map), lists (map), body."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    rows = rows.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), text.alias("t"))
    head = F.regexp_extract("t", r"(?s)^---\n(.*?)\n---\n?", 1)
    body = F.regexp_replace("t", r"(?s)^---\n.*?\n---\n?", "")
    return rows.select("path", "mtime", frontmatter(head).alias("fields"), frontmatter_lists(head).alias("lists"), F.btrim(body, F.lit(" \n\t\r")).alias("body"))


def frontmatter(head: Column) -> Column:
    """Scalars ``key: value`` of a frontmatter block."""
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1), F.btrim(F.regexp_extract(x, r"^[\w-]+:\s*(.*)$", 1), F.lit("\"' "))))
    return F.map_from_entries(pairs)


def frontmatter_lists(head: Column) -> Column:
    """Block lists: ``key:`` followed by ``- item`` lines."""
    blocks = F.regexp_extract_all(head, F.lit(r"(?m)^([\w-]+):[ \t]*\n(?:[ \t]*- .*(?:\n|$))+"), 0)
    names = F.transform(blocks, lambda b: F.regexp_extract(b, r"^([\w-]+):", 1))
    items = F.transform(blocks, lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"(?m)^[ \t]*- (.*)$"), 1), lambda x: F.btrim(x, F.lit("\"' "))))
    return F.map_from_arrays(names, items)


def note_text() -> Column:
    """A note (id, type, priority, tags, body) as Markdown with frontmatter."""
    tags = F.concat_ws("\n", F.transform("tags", lambda t: F.concat(F.lit("- "), t)))
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), F.col("id").cast("string")), F.concat(F.lit("type: "), "type"), F.concat(F.lit("priority: "), "priority"), F.lit("tags:"), tags, F.lit("---"), "body")


def write_notes(notes: DataFrame, path: str) -> None:
    """Each note in a folder of its own, ``note=<id>``, as a text file."""
    notes.select(F.col("id").cast("string").alias("note"), note_text().alias("value")).write.partitionBy("note").mode("overwrite").text(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (id, ref, commit, tree, label, phase, created_at); broken or incomplete lines drop out."""
    rows = spark.read.schema("id string, ref string, commit string, tree string, label string, phase string, created_at double").option("mode", "DROPMALFORMED").json(path)
    return rows.where("id is not null and ref is not null and commit is not null")


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_trends(old: DataFrame, new: DataFrame, by: str, order: list[str], most: int = C.TREND_ROWS) -> DataFrame:
    """Trend rows with new ones at the end, of each group the last ``most``; metrics that a side lacks are null."""
    w = W.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def read_transcripts(spark: SparkSession, path: str, n: int = 30, most: int = 10 << 20) -> DataFrame:
    """(path, line, turn) of the last n lines of each file; files beyond ``most`` bytes and lines that are no JSON objects drop out."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    lines = F.split(F.rtrim(F.col("content").cast("string"), F.lit("\n")), "\n")
    last = files.select("path", F.size(lines).alias("n"), lines.alias("x")).select("path", F.posexplode(F.slice("x", F.greatest(F.lit(1), F.col("n") - n + 1), n)).alias("line", "text"))
    turn = "struct<type:string,role:string,name:string,content:array<struct<type:string,name:string,input:struct<command:string>>>>"
    return last.select("path", "line", F.try_parse_json("text").alias("v"), F.from_json("text", turn).alias("turn")).where(F.schema_of_variant("v").startswith("OBJECT")).drop("v")


def pack_floats(vec: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(vec)


def unpack_floats(blob: Column) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.frombuffer(v, "<f4"))

    return unpack(blob)


def read_agents(spark: SparkSession, path: str) -> DataFrame:
    """(path, fields, lists, body) of Markdown files whose frontmatter has scalars, ``|`` and ``>`` blocks, inline and block lists."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    rows = rows.select("path", F.col("content").cast("string").alias("t"))
    head = F.regexp_extract("t", r"(?s)^---\n(.*?)\n---\n?", 1)
    block = r"(?m)^([\w-]+):[ \t]*[|>]-?[ \t]*\n((?:(?:[ \t]+.*)?(?:\n|$))+)"
    whole = F.regexp_extract_all(head, F.lit(block), 0)
    folded = lambda b: F.regexp_replace(F.btrim(F.regexp_replace(F.regexp_replace(b, r"^[^\n]*\n", ""), r"(?m)^[ \t]+", ""), F.lit("\n")), "\n", " ")
    kept = lambda b: F.btrim(F.regexp_replace(F.regexp_replace(b, r"^[^\n]*\n", ""), r"(?m)^[ \t]+", ""), F.lit("\n"))
    long = F.map_from_entries(F.transform(whole, lambda b: F.struct(F.regexp_extract(b, r"^([\w-]+):", 1), F.when(b.rlike(r"^[\w-]+:[ \t]*>"), folded(b)).otherwise(kept(b)))))
    plain = F.regexp_replace(head, block, "")
    inline = F.regexp_extract_all(plain, F.lit(r"(?m)^[\w-]+:[ \t]*\[.*\][ \t]*$"), 0)
    item = lambda x: F.btrim(x, F.lit("\"' "))
    short = F.map_from_entries(F.transform(inline, lambda b: F.struct(F.regexp_extract(b, r"^([\w-]+):", 1), F.filter(F.transform(F.split(F.regexp_extract(b, r"\[(.*)\]", 1), ","), item), lambda x: x != ""))))
    scalars = F.map_filter(frontmatter(plain), lambda _, v: ~v.startswith("["))
    return rows.select("path", F.map_concat(scalars, long).alias("fields"), F.map_concat(frontmatter_lists(plain), short).alias("lists"), F.btrim(F.regexp_replace("t", r"(?s)^---\n.*?\n---\n?", ""), F.lit(" \n\t\r")).alias("body"))


def blocked_tools(spark: SparkSession, text: str) -> DataFrame:
    """(node, tools) of a workflow text: what each node blocks."""
    rows = [(str(n["id"]), [str(t) for t in n.get("tools_blocked") or []]) for n in parse_graph(text).get("nodes") or []]
    return spark.createDataFrame(rows, "node string, tools array<string>")


def workflow_steps(spark: SparkSession, text: str) -> DataFrame:
    """(place, id, name, tools) of an old workflow text, a list of ``steps``."""
    rows = [(k, str(x.get("id", k)), x.get("name"), [str(t) for t in x.get("tools_blocked") or []]) for k, x in enumerate(parse_graph(text).get("steps") or [])]
    return spark.createDataFrame(rows, "place int, id string, name string, tools array<string>")


def graph_text(nodes: DataFrame, edges: DataFrame) -> str:
    """A workflow (id, name, ...; id, src, dst, kind, priority, in order of seq) in the subset that ``parse_graph`` reads."""
    out = ["nodes:"]
    for r in nodes.orderBy("seq").collect():  # workflows are small by nature
        out += [f"  - id: {r['id']}"] + [f"    {k}: {json.dumps(r[k])}" for k in ("name", "is_start", "is_end", "max_visits") if k in nodes.columns and r[k] is not None]
    out.append("edges:")
    for r in edges.orderBy("seq").collect():
        out += [f"  - id: {r['id']}", f"    from: {r['src']}", f"    to: {r['dst']}", "    condition:", f"      type: {r['kind']}", f"    priority: {r['priority']}"]
    return "\n".join(out) + "\n"


def mermaid(nodes: DataFrame, edges: DataFrame, current: str | None = None) -> str:
    """A workflow as a Mermaid flow chart, the current node marked."""
    out = ["graph TD"]
    for r in nodes.orderBy("seq").collect():
        left, right = ("([", "])") if r["is_start"] or r["is_end"] else ("[", "]")
        out.append(f"    {r['id']}{left}{r['name'] or r['id']}{right}")
    out += [f"    {r['src']} -->|{r['kind']}| {r['dst']}" for r in edges.orderBy("seq").collect()]
    return "\n".join(out + ([f"    style {current} fill:#90EE90"] if current else []))


def is_workflow(text: Column) -> Column:
    """Whether a file's text is a workflow: it has nodes and edges."""
    return text.rlike(r"(?m)^nodes:") & text.rlike(r"(?m)^edges:")


def list_workflows(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size) of the files under a folder that hold a workflow; the name is the text's own, else the file's."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    own = F.regexp_extract(text, r"(?m)^(?:metadata:[ \t]*\n[ \t]+)?name:[ \t]*[\"']?([^\"'\n]+)", 1)
    file = F.regexp_replace(F.substring_index("path", "/", -1), r"\.ya?ml$", "")
    return files.where(is_workflow(text)).select("path", F.when(own != "", F.btrim(own)).otherwise(file).alias("name"), F.col("length").alias("size"))


def prune_journal(journal: DataFrame, by: str, most: int = 100) -> DataFrame:
    """The newest snapshots of each group, and ``place`` from the newest on."""
    w = W.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id"))
    return journal.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most)


def read_trends(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of trend rows; metrics that a row lacks are null, unreadable times drop the row."""
    rows = spark.read.schema("timestamp string, project string, smell_count bigint, tension_count bigint, debt_score double, findings_count bigint, risk_grade string").json(path, multiLine=True)
    return rows.withColumn("ts", F.try_to_timestamp("timestamp").cast("timestamp_ntz")).where("ts is not null").drop("timestamp")


def envelope_text(content: Column) -> Column:
    """The text of the first ``text`` item of a reply's content, an array of (type, text)."""
    return F.try_element_at(F.filter(content, lambda c: c["type"] == "text"), F.lit(1))["text"]


def fresh(mtime: Column, as_of: Column, seconds: int) -> Column:
    """Whether a cache is not older than so long (the bound included)."""
    return F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(mtime.cast("timestamp")) <= seconds * 1_000_000


def tail(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).where(F.col("r") <= n).drop("r")


def representative_files(spark: SparkSession, path: str, suffixes: list[str], skip: list[str], most: int) -> DataFrame:
    """Files by suffix under a folder, without skipped folders, empty and large files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("mtime"))
    keep = F.col("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$") & (F.col("length") > 0) & (F.col("length") <= most)
    for s in skip:
        keep = keep & ~F.col("path").contains(f"/{s}/")
    return rows.where(keep)


def scoped_count(rows: DataFrame, column: str, prefix: str) -> int:
    return rows.where(F.col(column).startswith(prefix)).count()


def coerce_array(text: Column) -> Column:
    """A JSON array of strings, or the text itself as the only item."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array(text))


def coerce_object(text: Column) -> Column:
    """A JSON object as it is; other texts are null (callers keep them as texts)."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def declared_type(schema: Column) -> Column:
    """The type that a JSON schema asks for; of ``anyOf`` or ``oneOf`` the first alternative's that isn't ``null``."""
    every = F.coalesce(F.get_json_object(schema, "$.anyOf"), F.get_json_object(schema, "$.oneOf"))
    other = F.filter(F.from_json(every, "array<struct<type:string>>"), lambda x: F.coalesce(x["type"], F.lit("")) != "null")
    return F.when(F.size(other) > 0, F.element_at(other, 1)["type"]).otherwise(F.get_json_object(schema, "$.type"))


def coerce(value: Column, schema: Column) -> Column:
    """A text argument as JSON: arrays and objects that were sent as text where the schema wants them, other texts as JSON strings.

    A text that is no array becomes the only item where an array is wanted; one that is no object stays a text.
    """
    kind, parsed = declared_type(schema), F.try_parse_json(value)
    is_a = lambda name: F.coalesce(F.schema_of_variant(parsed).startswith(name), F.lit(False))
    text = F.to_json(F.struct(value.alias("v")))
    plain = F.substring(text, 6, F.length(text) - 6)
    wanted = F.when((kind == "array") & is_a("ARRAY"), F.to_json(parsed)).when(kind == "array", F.to_json(F.array(value))).when((kind == "object") & is_a("OBJECT"), F.to_json(parsed)).otherwise(plain)
    return F.when(value.isNotNull(), wanted)


def _scalar(v: str):
    if v[:1] in ("'", '"') and v[-1:] == v[:1] and len(v) > 1:
        return v[1:-1]
    if v.startswith("[") and v.endswith("]"):
        return [_scalar(x.strip()) for x in v[1:-1].split(",") if x.strip()]
    if v in ("true", "false"):
        return v == "true"
    if v in ("null", "~", ""):
        return None
    return int(v) if re.fullmatch(r"-?\d+", v) else v


class _Lines:
    """The lines of a text, with a place among them; blank lines and comments count only inside text blocks."""

    def __init__(self, text: str) -> None:
        self.lines = [[len(x) - len(x.lstrip(" ")), x.strip()] for x in text.expandtabs().split("\n")]
        self.raw = text.expandtabs().split("\n")
        self.at = 0

    def now(self) -> tuple[int, str] | None:
        while self.at < len(self.lines) and (not self.lines[self.at][1] or self.lines[self.at][1].startswith("#")):
            self.at += 1
        return tuple(self.lines[self.at]) if self.at < len(self.lines) else None

    def split_item(self, depth: int, rest: str) -> None:
        """``- key: value``: the rest of the line stands where its key does."""
        self.lines[self.at] = [depth, rest]

    def text_block(self, depth: int, folded: bool) -> str:
        """Lines deeper than ``depth``, without the first one's indent; ``folded``: joined by spaces within paragraphs."""
        got = []
        while self.at < len(self.lines) and (not self.lines[self.at][1] or self.lines[self.at][0] > depth):
            got.append(self.raw[self.at])
            self.at += 1
        base = next((len(x) - len(x.lstrip(" ")) for x in got if x.strip()), 0)
        text = "\n".join(x[base:].rstrip() for x in got).rstrip()
        return re.sub(r"(?<!\n)\n(?!\n)", " ", text) if folded else text


BLOCK = re.compile(r"[|>][+-]?")
KEY = re.compile(r"[\w.-]+:(\s|$)")


def _block(lines: _Lines, indent: int):
    out: dict | list | None = None
    while (now := lines.now()) is not None and now[0] >= indent:
        depth, line = now
        if depth > indent:
            raise ValueError(f"unexpected indent before {line!r}")
        if line == "-" or line.startswith("- "):
            if isinstance(out, dict):
                break
            out = [] if out is None else out
            rest = line[1:].strip()
            if KEY.match(rest):
                lines.split_item(depth + len(line) - len(rest), rest)
                out.append(_block(lines, depth + len(line) - len(rest)))
            else:
                lines.at += 1
                out.append(_value(lines, depth, rest))
            continue
        if isinstance(out, list):  # the list has ended; its parent goes on at this depth
            break
        out = {} if out is None else out
        key, colon, rest = line.partition(":")
        if not colon:
            raise ValueError(f"neither a key nor an item: {line!r}")
        lines.at += 1
        out[_scalar(key.strip())] = _value(lines, depth, rest.strip())
    return out


def _value(lines: _Lines, depth: int, rest: str):
    """What follows a key or a dash at ``depth``: the rest of its line, a text block or a deeper block."""
    if BLOCK.fullmatch(rest):
        return lines.text_block(depth, rest[0] == ">")
    if rest:
        return _scalar(rest)
    following = lines.now()
    if following and (following[0] > depth or following[0] == depth and following[1].startswith("- ") and not lines.lines[lines.at - 1][1].startswith("-")):
        return _block(lines, following[0])
    return None


def parse_graph(text: str) -> dict:
    """The YAML subset of workflow files: nested maps, lists, strings, text blocks, integers, booleans and null."""
    lines = _Lines(text)
    first = lines.now()
    return (_block(lines, first[0]) or {}) if first else {}


def graph_frames(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and tasks of a workflow text."""
    doc = parse_graph(text)
    nodes = [(str(n["id"]), n.get("name") or str(n["id"]), n.get("node_type") or "wave", bool(n.get("is_start")), bool(n.get("is_end")), n.get("max_visits") or 10, k) for k, n in enumerate(doc.get("nodes") or [])]
    edges = [(str(e["id"]), str(e["from"]), str(e["to"]), (e.get("condition") or {}).get("type") or "always", json.dumps(e.get("condition") or {}), 1 if e.get("priority") is None else e["priority"], k) for k, e in enumerate(doc.get("edges") or [])]
    tasks = [(str(n["id"]), str(t["id"]), [str(x) for x in t.get("dependencies") or []]) for n in doc.get("nodes") or [] for t in n.get("tasks") or []]
    return (
        spark.createDataFrame(nodes, "id string, name string, node_type string, is_start boolean, is_end boolean, max_visits int, seq int"),
        spark.createDataFrame(edges, "id string, src string, dst string, kind string, condition string, priority int, seq int"),
        spark.createDataFrame(tasks, "node string, task string, needs array<string>"),
    )
