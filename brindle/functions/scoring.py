"""Scores as column expressions. Time is always passed in; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import constants as C
from brindle.functions.text import parent


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def confidence(n: Column) -> Column:
    return F.least(F.lit(C.CONFIDENCE_MOST), F.lit(C.CONFIDENCE_MOST) * (1 - F.pow(F.lit(C.CONFIDENCE_BASE), n)))


def whole_days(since: Column, as_of: Column) -> Column:
    """Elapsed days, rounded down (calendar days would differ around midnight)."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000))


def age_days(since: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(86_400_000_000)


def recency(since: Column, as_of: Column) -> Column:
    days = whole_days(since, as_of)
    return F.when(days.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - days / C.RECENCY_DAYS))


def decay(since: Column, as_of: Column) -> Column:
    days = whole_days(since, as_of)
    return F.when(days.isNull(), 1.0).otherwise(F.greatest(F.lit(C.DECAY_LEAST), 1 - days / C.DECAY_DAYS))


def path_match(target: Column, pattern: Column, far: bool = True) -> Column:
    """1 if the pattern (* is any run, the rest a regular expression) matches, .7 in one directory, .4 under one grandparent (if ``far``)."""
    rule = F.concat(F.lit("^(?:"), F.regexp_replace(pattern, r"\*", ".*"), F.lit(")$"))
    a, b = parent(target), parent(pattern)
    near = F.when(F.rlike(target, rule), 1.0).when(a == b, 0.7)
    return (near.when((parent(a) == parent(b)) & (parent(a) != "."), 0.4) if far else near).otherwise(0.0)


def relevance(path: Column, semantic: Column, same_domain: Column, conf: Column, decayed: Column, recent: Column) -> Column:
    return 0.25 * path + 0.30 * semantic + 0.20 * same_domain + 0.15 * conf * decayed + 0.10 * recent


def edit_relevance(path: Column, overlap: Column, same_domain: Column, conf: Column) -> Column:
    return 0.30 * path + 0.25 * overlap + 0.20 * same_domain + 0.15 * conf


def blend(semantic: Column, base: Column) -> Column:
    return 0.60 * semantic + 0.40 * base


def type_boost(kind: Column) -> Column:
    """What a note's type adds to its rank; the derived types t0 to t2 stand for feedback, user and project."""
    return F.when(kind.isin("feedback", "t0"), 0.15).when(kind.isin("user", "t1"), 0.10).when(kind.isin("project", "t2"), 0.05).otherwise(0.0)


def note_score(tags: Column, query: Column, age: Column, priority: Column) -> Column:
    bonus = F.when(priority == "high", 0.3).when(priority == "low", -0.2).otherwise(0.0)
    hits = F.size(F.array_intersect(tags, query)) / (F.size(query) + 1)
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(0.6 * hits + 0.1 / (1 + age) + bonus)


def prompt_overlap(prompt: Column, parts: list[tuple[Column, float]]) -> Column:
    """Weighted shares of each part's words that the prompt has, each over its size plus one."""
    total = F.lit(0.0)
    for words, weight in parts:
        total = total + F.size(F.array_intersect(prompt, words)) / (F.size(words) + 1) * weight
    return total


def rank_of(value: Column, table: dict[str, int], other: int | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(known, value)
    return found if other is None else F.coalesce(found, F.lit(other))
