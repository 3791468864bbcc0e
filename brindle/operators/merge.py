"""Experience store: merging, upserts, eviction, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import constants as C
from brindle.functions import scoring as S

KEY = ["type", "file_pattern", "domain"]


def entries(events: DataFrame, by: list[str] = KEY) -> DataFrame:
    """One entry a key: occurrences, first and last seen, confidence, longest description, first resolution."""
    order = F.struct("seen", "seq")
    got = events.groupBy(*by).agg(
        F.count("*").alias("occurrences"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"),
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
        F.coalesce(F.min_by("resolution", F.when(F.col("resolution") != "", order)), F.lit("")).alias("resolution"),
    )
    return got.withColumn("confidence", F.round(S.confidence(F.col("occurrences")), 6))


def experience_merge(events: DataFrame) -> DataFrame:
    """``entries`` with each key's related files in order of first mention, in one pass.

    Events are first gathered by key and related file, so a key's list is as long as its distinct files, not its events.
    """
    said = F.struct(F.length("description").alias("n"), (-F.col("seq")).alias("at"), "description")
    solved = F.when(F.col("resolution") != "", F.struct("seen", "seq", "resolution"))
    some = events.groupBy(*KEY, "related").agg(F.count("*").alias("n"), F.min("seen").alias("first"), F.max("seen").alias("last"), F.max(said).alias("said"), F.min(solved).alias("solved"), F.min("seq").alias("at"))
    got = some.groupBy(*KEY).agg(
        F.sum("n").alias("occurrences"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.max("said")["description"].alias("description"),
        F.coalesce(F.min("solved")["resolution"], F.lit("")).alias("resolution"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "related"))), lambda x: x["related"]), ",").alias("related_files"),
    )
    return got.withColumn("confidence", F.round(S.confidence(F.col("occurrences")), 6))


def commit_merge(events: DataFrame) -> DataFrame:
    """The commit hook's variant: key with the description, linear confidence, longest resolution."""
    got = events.groupBy("type", "file_pattern", "description").agg(F.count("*").alias("occurrences"), F.max_by("resolution", F.struct(F.length("resolution"), -F.col("seq"))).alias("resolution"))
    return got.withColumn("confidence", F.round(F.least(F.lit(C.CONFIDENCE_MOST), 0.5 + 0.1 * (F.col("occurrences") - 1)), 6))


def store_merge(both: DataFrame) -> DataFrame:
    """Union of stores told apart by ``own`` (1: the project's); on equal keys the project's entry stays if its confidence is not less."""
    rest = [c for c in both.columns if c not in KEY]
    best = both.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("confidence", "own")).alias("x"))
    return best.select(*KEY, *[F.col(f"x.{c}").alias(c) for c in rest])


def stats(entries: DataFrame) -> DataFrame:
    """Counts by each of type, scope and severity, and in total, with mean confidence."""
    sets = entries.groupingSets([[], [F.col("type")], [F.col("scope")], [F.col("severity")]], "type", "scope", "severity")
    return sets.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def evict(entries: DataFrame, most: int = C.STORE_ROWS) -> DataFrame:
    """The entries of greatest confidence, then latest sight."""
    return entries.orderBy(F.desc("confidence"), F.desc("last_seen"), *KEY).limit(most)


def retain(rows: DataFrame, by: str, order: list[str], most: int = C.TREND_ROWS) -> DataFrame:
    """The last ``most`` rows of each group."""
    w = W.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def hash_upsert(old: DataFrame, new: DataFrame, key: list[str], hash_col: str) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``old`` or whose hash differs there."""
    return new.join(old.select(*key, hash_col), [*key, hash_col], "left_anti")


def hits_and_misses(old: DataFrame, new: DataFrame, key: list[str], hash_col: str) -> DataFrame:
    """Rows of ``new`` with ``hit``: whether ``old`` holds their key with the same hash."""
    known = old.select(*key, hash_col).distinct().withColumn("hit", F.lit(True))
    return new.join(known, [*key, hash_col], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def without(rows: DataFrame, column: str, value: str) -> DataFrame:
    """A store without one partition; rows without a value stay."""
    return rows.where(~F.col(column).eqNullSafe(value))


def overridden(base: Column, own: Column) -> Column:
    """Two maps as one: where both have a key, the second one's value counts."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


def apply_upsert(old: DataFrame, new: DataFrame, key: list[str], hash_col: str) -> DataFrame:
    """``old`` with the changed rows of ``new`` in place; unchanged rows are not written again."""
    changed = hash_upsert(old, new, key, hash_col)
    return old.join(changed.select(*key), key, "left_anti").unionByName(changed)


def latest_slot(rows: DataFrame, by: str, at: list[str]) -> DataFrame:
    """The last row of each group: a store with one slot, last write wins."""
    return rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), F.struct(*at)).alias("x")).select(by, "x.*")


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed and changed keys."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(F.col(key).alias("_k"), F.col(value).alias("new"))
    both = a.join(b, a[key] == b["_k"], "full_outer")
    state = F.when(F.col(key).isNull(), "added").when(F.col("_k").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(F.coalesce(key, "_k").alias(key), state.alias("state")).where(F.col("state").isNotNull())
