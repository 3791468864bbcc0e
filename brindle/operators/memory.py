"""Memory notes: expiry, scored selection, links, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import constants as C
from brindle.functions import scoring as S
from brindle.functions import text as X
from brindle.operators import segmented


def expired(ttl: Column, mtime: Column, as_of: Column) -> Column:
    """Older than its time to live; without a readable one, never."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(mtime.cast("timestamp"))) / F.lit(1e6)
    return F.coalesce(age > X.duration_seconds(ttl), F.lit(False))


def ttl_stats(notes: DataFrame, as_of: Column) -> DataFrame:
    """total, active, expired and the estimated tokens of all bodies."""
    dead = expired(F.col("ttl"), F.col("mtime"), as_of)
    return notes.agg(F.count("*").alias("total"), F.count_if(~dead).alias("active"), F.count_if(dead).alias("expired"), F.sum(X.estimate_tokens(F.coalesce("body", F.lit("")))).cast("bigint").alias("tokens"))


def select(notes: DataFrame, query: list[str], n: int, as_of: Column) -> DataFrame:
    """All high-priority notes, then the best others with a positive score up to n in all."""
    live = notes.where(~expired(F.col("ttl"), F.col("mtime"), as_of))
    tags = F.array(*map(F.lit, query)) if query else F.array().cast("array<string>")
    score = F.round(S.note_score(F.col("tags"), tags, S.age_days(F.col("mtime"), as_of), F.col("priority")), 6)
    scored = live.withColumn("score", score)
    high = scored.where("priority = 'high'")
    room = F.greatest(F.lit(0).cast("bigint"), F.lit(n) - F.count("*"))
    others = scored.where("priority <> 'high' and score > 0").orderBy(F.desc("score"), "id").limit(n)
    others = others.withColumn("r", F.row_number().over(W.orderBy(F.desc("score"), "id")))  # at most n rows
    rest = others.join(F.broadcast(high.agg(room.alias("room")))).where(F.col("r") <= F.col("room"))
    return high.select("id", "score").unionByName(rest.select("id", "score"))


def linked(notes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Notes one link away from the chosen ones, without those."""
    ends = notes.join(chosen.select("id"), "id", "left_semi").select(F.explode("links").alias("id")).distinct()
    return notes.join(ends, "id", "left_semi").join(chosen.select("id"), "id", "left_anti")


def pack_prefix(rows: DataFrame, size: str, order: list, by: list[str], budget: int = C.PROMPT_CHARS, separator: int = 1) -> DataFrame:
    """Leading rows of each group that fit a budget, separators counted; the first overflow ends it."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(size).over(w) + (F.count("*").over(w) - 1) * separator
    return rows.withColumn("used", total).where(F.col("used") <= budget)


def pack_skipping(rows: DataFrame, size: str, order: list[str], by: str, key: str, budget: int) -> DataFrame:
    """Rows that fit one after the other, those that don't fit skipped; a group's state is one number."""
    sized = rows.withColumn("_size", F.col(size).cast("bigint"))
    return segmented.fold(sized, [by], order, "_size", [by, key], segmented.Budget(budget))


def cut_to_budget(rows: DataFrame, text: str, order: list[str], by: str, tokens: int, least: int = 50) -> DataFrame:
    """Texts of each group up to four characters a token; the first overflow is cut to the rest (``least`` at least) and ends it."""
    w = W.partitionBy(by).orderBy(*order)
    most = 4 * tokens
    filled = rows.where(F.coalesce(F.length(text), F.lit(0)) > 0)
    got = filled.withColumn("used", F.sum(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    got = got.withColumn("before", F.col("used") - F.length(text)).where(F.col("before") <= most)
    over = F.col("used") > most
    # Only the first overflow counts: later rows begin behind it.
    got = got.withColumn("ended", F.coalesce(F.max(over.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("ended = 0")
    room = F.greatest(F.lit(least), most - F.col("before")).cast("int")
    return got.withColumn(text, F.when(over, F.concat(F.substring(F.col(text), F.lit(1), room), F.lit("..."))).otherwise(F.col(text))).drop("used", "before", "ended")


def semantic_gate(notes: DataFrame, prompt: DataFrame, least: float = C.SEMANTIC_LEAST, k: int = 20) -> DataFrame:
    """Notes (id, type, vec) whose cosine to the prompt's vector (one row, ``q``) reaches ``least``, by cosine and type."""
    scored = notes.join(F.broadcast(prompt)).withColumn("semantic", F.round(S.cosine(F.col("vec"), F.col("q")), 6))  # the prompt is one row
    rank = F.round(F.col("semantic") + S.type_boost(F.col("type")), 6)
    return scored.where(F.col("semantic") >= least).select("id", "semantic", rank.alias("rank")).orderBy(F.desc("rank"), "id").limit(k)


def listing(notes: DataFrame, most: int = 50) -> DataFrame:
    """The first notes in listing order: high priority first, then by type and name."""
    order = [(F.col("priority") != "high").cast("int"), F.col("type"), F.col("name"), F.col("id")]
    few = notes.select("id", "type", "name", "priority").orderBy(*order).limit(most)
    return few.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("bigint"))  # at most ``most`` rows


def uncached(everywhere: DataFrame, local: DataFrame) -> DataFrame:
    """Notes (id, mtime) that the project's cache lacks or holds in an older state."""
    own = local.select("id", F.col("mtime").alias("cached"))
    return everywhere.join(own, "id", "left").where(F.col("cached").isNull() | (F.col("cached") < F.col("mtime"))).drop("cached")
