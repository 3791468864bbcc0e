"""Smaller selections: word counts, prompts, paths, blocked tools, caps, project facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import constants as C
from brindle.functions import scoring as S
from brindle.functions import text as X


def keyword_search(rows: DataFrame, text: str, key: str, words: list[str], k: int = 10) -> DataFrame:
    """Rows that hold most of the words, ignoring case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = reduce(lambda a, b: a + b, [low.contains(w.lower()).cast("int") for w in words])
    return rows.select(key, n.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), key).limit(k)


def prompt_rank(notes: DataFrame, prompt: list[str], age: Column, least: float = 0.08, k: int = 20) -> DataFrame:
    """Notes by overlap with a prompt's words, with a bonus by type and age; overlap must reach ``least``."""
    words = F.array(*map(F.lit, prompt))
    over = S.prompt_overlap(words, [(F.col("tags"), 1.5), (X.note_tokens(F.substring(F.coalesce("body", F.lit("")), 1, 800)), 0.4)])
    rows = notes.withColumn("overlap", F.round(over, 6)).where(F.col("overlap") >= least)
    return rows.select("id", "overlap", F.round(F.col("overlap") + S.type_boost(F.col("type")) + 0.05 / (1 + age), 6).alias("rank")).orderBy(F.desc("rank"), "id").limit(k)


def similar_paths(files: DataFrame, targets: DataFrame, least: float = 1.0, k: int = 2, generic: tuple[str, ...] = (), generic_least: float = 0.5) -> DataFrame:
    """Per target the k known files of most similar path that share a folder name or a stem with it.

    The join runs on shared path parts, so it never pairs all files with all targets. Targets with a
    ``generic`` stem, which says little, need ``generic_least`` only.
    """
    def parts(d: DataFrame, name: str) -> DataFrame:
        low = F.lower(F.col("path"))
        all_parts = F.array_distinct(F.filter(F.concat(F.split(X.parent(low), "/"), F.array(X.stem(low))), lambda p: p != ""))
        return d.select(F.col("path").alias(name), X.stem(low).alias(f"{name}_stem"), X.parent(low).alias(f"{name}_up"), F.explode(all_parts).alias("part"))

    a, b = parts(targets, "target"), parts(files, "file")
    shared = a.join(b, "part").groupBy("target", "file", "target_stem", "file_stem", "target_up", "file_up").agg(F.count("*").alias("n"))
    stem = F.when(F.col("target_stem") == F.col("file_stem"), 3.0).when(F.col("target_stem").contains(F.col("file_stem")) | F.col("file_stem").contains(F.col("target_stem")), 1.5).otherwise(0.0)
    rows = shared.select("target", "file", (stem + 0.5 * F.col("n") + F.when(F.col("target_up") == F.col("file_up"), 1.0).otherwise(0.0)).alias("score"), F.when(F.col("target_stem").isin(*generic), generic_least).otherwise(least).alias("least")).where(F.col("score") >= F.col("least")).drop("least")
    w = W.partitionBy("target").orderBy(F.desc("score"), "file")
    return rows.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def blocked(calls: DataFrame, rules: DataFrame, allowed: list[str]) -> DataFrame:
    """Calls (node, tool) that a node's list (array ``tools``) blocks by name or by *; some are always allowed.

    A call that goes through a proxy (``inner``, where calls have it) is judged by the tool behind it.
    """
    if "inner" in calls.columns:
        calls = calls.withColumn("tool", F.coalesce("inner", "tool")).drop("inner")
    rows = calls.join(rules, "node", "left")
    hit = F.coalesce(F.array_contains("tools", "*") | F.array_contains("tools", F.col("tool")), F.lit(False))
    return rows.withColumn("blocked", hit & ~F.col("tool").isin(allowed)).drop("tools")


def needs_snapshot(command: Column, reading: list[str]) -> Column:
    """Whether a command's first word is none of those that only read."""
    return ~F.split(F.trim(command), r"\s+")[0].isin(reading)


def capped(rows: DataFrame, by: str, order: list, k: int = 5) -> DataFrame:
    """The first k of each group, worst severity first, and how many more there are."""
    w = W.partitionBy(by)
    ranked = rows.withColumn("more", F.greatest(F.count("*").over(w) - k, F.lit(0))).withColumn("place", F.row_number().over(w.orderBy(F.desc(S.rank_of(F.col("severity"), C.SEVERITY, 0)), *order)).cast("bigint"))
    return ranked.where(F.col("place") <= k)


def fan_out(paths: DataFrame) -> DataFrame:
    """Distinct files by folder."""
    return paths.select("path").distinct().groupBy(X.parent(F.col("path")).alias("dir")).agg(F.count("*").alias("files"))


def contexts(paths: DataFrame, roots: list[str]) -> DataFrame:
    """Names below the first of the roots that has any, sorted."""
    found = [paths.where(F.col("path").startswith(f"{r}/")).select(F.lit(i).alias("o"), F.split(F.col("path"), "/")[r.count("/") + 1].alias("name")) for i, r in enumerate(roots)]
    every = reduce(lambda a, b: a.unionByName(b), found).distinct()
    first = every.agg(F.min("o").alias("o"))
    return every.join(F.broadcast(first), "o").select("name").orderBy("name")


def presence(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Which wanted keys are there."""
    return wanted.join(have.select(key).distinct().withColumn("_h", F.lit(True)), key, "left").select(key, F.coalesce("_h", F.lit(False)).alias("present"))


def embedding_text(name: Column, description: Column, params: Column) -> Column:
    """``name: description`` and a line with the parameters (array of name, type), or (no params)."""
    listed = F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.lit(": "), p["type"])), ", ")
    return F.concat(name, F.lit(": "), F.coalesce(description, F.lit("")), F.lit("\nParams: "), F.when(F.size(params) > 0, listed).otherwise("(no params)"))


def health(checks: DataFrame, by: str) -> DataFrame:
    """Passed and all checks, and their share."""
    got = checks.groupBy(by).agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))
    return got.withColumn("score", F.round(F.col("passed") / F.col("total"), 6))
