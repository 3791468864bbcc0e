"""Changes to many workflows at once (frames of ``sources.workflows``), and saving that only lets valid ones in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.store import Store


class Invalid(ValueError):
    """What is wrong with the workflows that were to be saved: (path, error, subject)."""

    def __init__(self, problems: list[tuple]) -> None:
        super().__init__("; ".join(f"{p}: {e} {s}" for p, e, s in problems[:20]))
        self.problems = problems


def put(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows keyed by (path, id) with changes laid over them: fields that a change leaves null stay, new ids are added behind the others."""
    keep = [c for c in rows.columns if c not in ("path", "id", "seq")]
    new = changes.select("path", "id", *[(F.col(c) if c in changes.columns else F.lit(None)).cast(rows.schema[c].dataType).alias(f"_{c}") for c in [*keep, "seq"]], F.lit(True).alias("_new"))
    last = rows.groupBy("path").agg(F.max("seq").alias("_last"))
    both = rows.join(new, ["path", "id"], "full").join(last, "path", "left")
    seq = F.coalesce("seq", F.coalesce("_last", F.lit(-1)) + 1 + F.coalesce("_seq", F.lit(0))).cast(rows.schema["seq"].dataType)
    return both.select(*[{"path": F.col("path"), "id": F.col("id"), "seq": seq.alias("seq")}.get(c, F.coalesce(f"_{c}", c).alias(c)) for c in rows.columns])


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes (path, id) of ``gone`` and the edges that touch them."""
    gone = gone.select("path", "id")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), ["path", end], "left_anti")
    return nodes.join(gone, ["path", "id"], "left_anti"), edges


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, error, subject) of every fault of every workflow."""
    say = lambda d, error, subject: d.select("path", F.lit(error).alias("error"), F.col(subject).cast("string").alias("subject"))
    key = ["path", "id"]
    ends = nodes.select("path", F.col("id"))
    starts = nodes.groupBy("path").agg(F.count_if("is_start").alias("n")).where("n <> 1")
    stuck = nodes.where("not is_end").join(edges.select("path", F.col("src").alias("id")), key, "left_anti")
    unreached = nodes.where("not is_start").join(edges.select("path", F.col("dst").alias("id")), key, "left_anti")
    out = say(starts, "start_count", "n").unionByName(say(stuck, "no_outgoing", "id")).unionByName(say(unreached, "no_incoming", "id"))
    for end, error in (("src", "dangling_from"), ("dst", "dangling_to")):
        out = out.unionByName(say(edges.join(ends.withColumnRenamed("id", end), ["path", end], "left_anti"), error, end))
    twice = nodes.select(*key).unionByName(edges.select(*key).withColumn("id", F.concat(F.lit("edge "), "id"))).groupBy(*key).count().where("count > 1")
    bare = ((F.col("kind") == "tool") & (F.coalesce("tool", F.lit("")) == "")) | ((F.col("kind") == "phrase") & (F.coalesce(F.size("phrases"), F.lit(0)) < 1))
    unknown = ~F.col("kind").isin("always", "tool", "phrase", "default")
    return out.unionByName(say(twice, "repeated_id", "id")).unionByName(say(edges.where(bare), "empty_trigger", "id")).unionByName(say(edges.where(unknown), "unknown_trigger", "id"))


def save(store: Store, nodes: DataFrame, edges: DataFrame, seen: int) -> int:
    """Write the version after ``seen``; nothing is written, and Invalid raised, where a workflow has faults."""
    found = [tuple(r) for r in problems(nodes, edges).orderBy("path", "error", "subject").limit(1000).collect()]  # as many as an error shows
    if found:
        raise Invalid(found)
    rows = nodes.withColumn("what", F.lit("node")).unionByName(edges.withColumn("what", F.lit("edge")), allowMissingColumns=True)
    return store.write(rows, seen)


def load(store: Store, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a stored version."""
    rows = store.read(version)
    node = ["path", "id", "name", "node_type", "is_start", "is_end", "max_visits", "prompt", "mcps", "tools", "extra", "seq"]
    edge = ["path", "id", "src", "dst", "kind", "tool", "phrases", "priority", "seq"]
    return rows.where("what = 'node'").select(*[c for c in node if c in rows.columns]), rows.where("what = 'edge'").select(*[c for c in edge if c in rows.columns])
