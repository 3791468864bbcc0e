"""Scans of texts, paths and transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions import constants as C
from brindle.functions import text as X
from brindle.operators import patterns


def rule_scan(rows: DataFrame, key: str, text: str, rules: dict[str, str]) -> DataFrame:
    """Per text and rule with a match: how many, and the line of the first."""
    return patterns.scan(rows, key, text, rules)


def checklist(entries: DataFrame, task: str, least: int) -> DataFrame:
    """Occurrences by layer and generalised pattern, with up to three examples in order."""
    rows = entries.withColumn("layer", X.layer(F.col("file_pattern"), task)).where("layer is not null")
    rows = rows.withColumn("pattern", X.context_name(F.col("file_pattern"), task))
    firsts = rows.groupBy("layer", "pattern", "file_pattern").agg(F.min("seq").alias("at"), F.sum("occurrences").alias("n"))
    w = W.partitionBy("layer", "pattern").orderBy("at", "file_pattern")
    few = firsts.withColumn("r", F.row_number().over(w))
    got = few.groupBy("layer", "pattern").agg(F.sum("n").alias("occurrences"), F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "file_pattern")))).alias("x"))
    return got.where(F.col("occurrences") >= least).select("layer", "pattern", "occurrences", F.array_join(F.transform("x", lambda v: v["file_pattern"]), ",").alias("examples"))


def notes(entries: DataFrame, by: str, least: float = 0.65, most: int = 5) -> DataFrame:
    """First sentences (120 characters) of confident entries, distinct, best first."""
    said = F.substring(F.substring_index("description", ".", 1), 1, 120)
    rows = entries.where(F.col("confidence") >= least).select(by, said.alias("note"), "confidence").groupBy(by, "note").agg(F.max("confidence").alias("confidence"))
    w = W.partitionBy(by).orderBy(F.desc("confidence"), "note")
    return rows.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most)


def transcript_tail(turns: DataFrame, n: int = 30) -> DataFrame:
    """Of the last n turns of each conversation: how many, and their memory writes and commits.

    Input: conv_id, turn, role and ``content``, an array of blocks (name, command). A block whose
    name holds memory_set is a memory write, a Bash block whose command holds git commit is a commit.
    """
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))
    last = turns.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    writes = F.size(F.filter("content", lambda b: b["name"].contains("memory_set")))
    commits = F.size(F.filter("content", lambda b: (b["name"] == "Bash") & b["command"].contains("git commit")))
    many = lambda c: F.sum(F.greatest(c, F.lit(0))).cast("bigint")
    return last.groupBy("conv_id").agg(F.count("*").alias("turns"), many(writes).alias("memory_writes"), many(commits).alias("commits"))


def language_topk(files: DataFrame, k: int = 3) -> DataFrame:
    return files.groupBy(X.language(F.col("path")).alias("language")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(k)


def id_vote(rows: DataFrame, by: str, text: str) -> DataFrame:
    """The kind of identifier most often seen; of equals string, uuid, int, custom in this order."""
    kinds = [("string", r"[a-z]{3,}"), ("uuid", r"[0-9a-f]{8}-[0-9a-f]{4}"), ("int", r"[0-9]+"), ("custom", r"[A-Z]{2,}_[0-9]+")]
    each = F.array(*[F.struct(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, (k, r) in enumerate(kinds)])
    votes = rows.select(by, F.explode(each).alias("x")).groupBy(by, "x.kind", "x.o").agg(F.sum("x.n").alias("n"))
    return votes.groupBy(by).agg(F.max_by("kind", F.struct("n", "o")).alias("kind"), F.max("n").alias("votes"))


def migration_max(files: DataFrame) -> DataFrame:
    """The directory with the greatest number and the next one, padded to its width or six."""
    number = F.regexp_extract("name", r"^([0-9]+)_", 1)
    rows = files.select("dir", number.alias("d")).where("d <> ''").withColumn("v", F.col("d").cast("bigint"))
    got = rows.groupBy("dir").agg(F.max("v").alias("v"), F.max(F.length("d")).alias("width"), F.count("*").alias("files"))
    best = got.orderBy(F.desc("v"), "dir").limit(1)
    width = F.greatest(F.lit(6), F.col("width"))
    return best.select("dir", "files", F.lpad((F.col("v") + 1).cast("string"), width, F.lit("0")).alias("next"))


def stack_lookup(stack: DataFrame, table: dict[str, list[str]], core: list[str]) -> DataFrame:
    """What a tech stack (project, tech) calls for: looked-up names and the core ones, distinct."""
    known = F.create_map(*[x for tech, names in table.items() for x in (F.lit(tech), F.array(*map(F.lit, names)))])
    names = F.concat(F.coalesce(F.try_element_at(known, F.col("tech")), F.array().cast("array<string>")), F.array(*map(F.lit, core)))
    return stack.select("project", F.explode(names).alias("name")).distinct()


def tech_stack(files: DataFrame) -> DataFrame:
    """(project, language, framework) of manifests (project, name, text), without a framework where none shows."""
    low = F.lower(F.coalesce("text", F.lit("")))
    language = F.try_element_at(F.create_map(*[F.lit(x) for pair in C.MANIFESTS.items() for x in pair]), F.col("name"))
    probes = {n: F.array_compact(F.array(*[F.when(low.contains(probe.lower()), f) for f, probe in table.items()])) for n, table in C.FRAMEWORKS.items()}
    found = F.array().cast("array<string>")
    for n, hits in probes.items():
        found = F.when(F.col("name") == n, hits).otherwise(found)
    rows = files.select("project", language.alias("language"), found.alias("found")).where("language is not null")
    return rows.select("project", "language", F.explode_outer("found").alias("framework")).distinct()


def representative(files: DataFrame, patterns: list[str], by: str, exclude: list[str], skip: list[str], tests: bool = False, most: int = 50_000) -> DataFrame:
    """Per group its candidates in order: by pattern, then depth, then name; a file counts once.

    Input: by, path, length. Patterns are regular expressions over paths.
    """
    path, low = F.col("path"), F.lower("path")
    at = F.array_min(F.array_compact(F.array(*[F.when(path.rlike(p), F.lit(i)) for i, p in enumerate(patterns)])))
    keep = (F.col("length") > 0) & (F.col("length") <= most)
    for s in skip:
        keep = keep & ~path.contains(s)
    for s in exclude:
        keep = keep & ~low.contains(s.lower())
    if tests:
        keep = keep & X.is_test_name(path)
    rows = files.where(keep).select(by, "path", at.alias("at")).where("at is not null").distinct()
    w = W.partitionBy(by).orderBy("at", F.size(F.split("path", "/")), X.basename(F.col("path")), "path")
    return rows.withColumn("place", F.row_number().over(w).cast("bigint")).select(by, "place", "path")


@F.pandas_udf(StringType())
def snippet(texts: pd.Series) -> pd.Series:
    """Imports, type definitions and the first two functions (to their closing brace), 2000 characters."""
    import re

    head = re.compile(r"^\s*(import\b|from\b|package\b|use\b|#include\b|require\b)")
    kind = re.compile(r"^\s*(?:export\s+)?(?:type|interface|struct|class|enum)\b")
    func = re.compile(r"^\s*(?:export\s+)?(?:async\s+)?(?:def|func|function|fn)\b")

    def cut(t: str | None) -> str:
        out, depth, inside, functions = [], 0, False, 0
        for line in (t or "").split("\n"):
            if inside:
                out.append(line)
                depth += line.count("{") - line.count("}")
                inside = depth > 0
            elif head.match(line):
                out.append(line)
            elif kind.match(line) or (func.match(line) and functions < 2):
                functions += bool(func.match(line))
                out.append(line)
                depth = line.count("{") - line.count("}")
                inside = depth > 0
        return "\n".join(out)[:2000]

    return texts.map(cut)


def flat_rules() -> dict[str, str]:
    return {f"{lang}/{name}": rule for lang, rules in C.RULES.items() for name, rule in rules}
