"""The engine's stores as versioned tables: experience, tool catalog, workflow states, slots.

Each change reads the newest version, works out the next one as a DataFrame and publishes it; a writer
that was overtaken begins again (``Store.update``), so no change is lost and no store is ever half written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import constants as C
from brindle.functions import scoring as S
from brindle.operators import graph as G
from brindle.operators import merge as MG
from brindle.sources.store import Store


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Two tables of entries (as ``merge.entries`` makes them) as one: occurrences add up, the longest description and the older resolution stay."""
    if old is None:
        return new
    both = old.select(*new.columns).withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    got = both.groupBy(*MG.KEY).agg(
        F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max_by("description", F.struct(F.length("description"), -F.col("age"))).alias("description"),
        F.coalesce(F.min_by("resolution", F.when(F.col("resolution") != "", F.col("age"))), F.lit("")).alias("resolution"),
    )
    return got.withColumn("confidence", F.round(S.confidence(F.col("occurrences")), 6)).select(*new.columns)


def learn(store: Store, events: DataFrame, most: int = C.STORE_ROWS) -> int:
    """Merge what events teach into a store of entries, of which the ``most`` of greatest confidence stay."""
    new = MG.entries(events)
    return store.update(lambda old: MG.evict(merged(old, new), most))


def upsert_tools(store: Store, tools: DataFrame, key: list[str] | None = None, text_hash: str = "text_hash") -> int:
    """Put tools into the catalog; those whose hash is unchanged are not touched, and without a change no version is made."""
    key = key or ["mcp_name", "tool_name"]
    for _ in range(5):
        seen = store.version()
        old = store.read(seen) if seen else None
        fresh = tools if old is None else MG.hash_upsert(old, tools, key, text_hash)
        if old is not None and fresh.isEmpty():
            return seen
        name = store.stage(fresh if old is None else old.join(fresh.select(*key), key, "left_anti").unionByName(fresh.select(*old.columns)))
        if (now := store.try_publish(name, seen)) is not None:
            return now
    raise RuntimeError(f"{store.path}: other writers were faster five times")


def drop_server(store: Store, mcp: str) -> int:
    """Take a server's tools out of the catalog."""
    return store.update(lambda old: old.where(F.col("mcp_name") != mcp))


def record(store: Store, log: DataFrame) -> int:
    """Add transitions (project, seq, ts, to_node, reset) to the stored log; those it has already are not added twice."""
    key = ["project", "seq"]
    return store.update(lambda old: log if old is None else old.unionByName(log.join(old.select(*key), key, "left_anti").select(*old.columns)))


def load_states(store: Store, most: int = 10) -> DataFrame | None:
    """Where each project stands, from the stored log."""
    log = store.read()
    return None if log is None else G.states(log, most)


def put_slots(store: Store, rows: DataFrame, by: str, order: list[str]) -> int:
    """Keep the last row of each key, whichever version it came with."""
    return store.update(lambda old: MG.latest_slot(rows if old is None else old.unionByName(rows.select(*old.columns)), by, order))
