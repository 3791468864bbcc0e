"""Workflow graphs: validation, triggers, ready tasks, cycles, visits, timelines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType

from brindle.operators import segmented
from brindle.operators.ordered import ordered
from brindle.session import spill

#: Dependencies of a graph up to which one task peels it.
GROUP = 100_000


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(error, subject) rows: starts, nodes without ways out or in, edges to nowhere."""
    starts = nodes.agg(F.count_if("is_start").alias("n")).where("n <> 1").select(F.lit("start_count").alias("error"), F.col("n").cast("string").alias("subject"))
    ids = nodes.select(F.col("id").alias("end"))
    out = nodes.where("not is_end").join(edges, F.col("id") == F.col("src"), "left_anti").select(F.lit("no_outgoing").alias("error"), F.col("id").alias("subject"))
    back = nodes.where("not is_start").join(edges, F.col("id") == F.col("dst"), "left_anti").select(F.lit("no_incoming").alias("error"), F.col("id").alias("subject"))
    bad_to = edges.join(ids, F.col("dst") == F.col("end"), "left_anti").select(F.lit("dangling_to").alias("error"), F.col("dst").alias("subject"))
    bad_from = edges.join(ids, F.col("src") == F.col("end"), "left_anti").select(F.lit("dangling_from").alias("error"), F.col("src").alias("subject"))
    return starts.unionByName(out).unionByName(back).unionByName(bad_to).unionByName(bad_from)


def terminal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges, F.col("id") == F.col("src"), "left_anti").select("id")


def triggered(edges: DataFrame, tool: str | None = None, phrase: str | None = None) -> DataFrame:
    """Edges that a tool or a phrase sets off, lower priority numbers first in each node.

    An edge has one ``phrase`` or any of several (an array ``phrases``). Tools match as part of the called tool's name, phrases as part of the text, ignoring case.
    ``default`` edges fire on any tool (phrase) unless they name one, which must then match.
    Without a trigger ``always`` and ``default`` edges are open.
    """
    kind = F.col("kind")
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    if tool is not None:
        hit = kind.isin("tool", "default") & F.when(named("tool"), F.lit(tool).contains(F.col("tool"))).otherwise(kind == "default")
    elif phrase is not None and "phrases" in edges.columns:
        some = F.filter(F.coalesce("phrases", F.array().cast("array<string>")), lambda p: p != "")
        hit = kind.isin("phrase", "default") & F.when(F.size(some) > 0, F.exists(some, lambda p: F.lit(phrase.lower()).contains(F.lower(p)))).otherwise(kind == "default")
    elif phrase is not None:
        hit = kind.isin("phrase", "default") & F.when(named("phrase"), F.lit(phrase.lower()).contains(F.lower("phrase"))).otherwise(kind == "default")
    else:
        hit = kind.isin("default", "always")
    place = F.row_number().over(W.partitionBy("src").orderBy("priority", "seq", "dst"))
    return edges.where(hit).withColumn("place", place.cast("bigint"))


def start_node(nodes: DataFrame, by: str) -> DataFrame:
    """Per graph its start: the first node with the flag, else the first node."""
    return nodes.groupBy(by).agg(F.min_by("id", F.struct(~F.col("is_start"), F.col("seq"))).alias("start"))


def ready(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Open tasks all of whose needs are done."""
    done = tasks.where("done").select("node", F.col("task").alias("needs"))
    waiting = deps.join(done, ["node", "needs"], "left_anti").select("node", "task").distinct()
    return tasks.where("not done").join(waiting, ["node", "task"], "left_anti").select("node", "task")


def ready_delta(tasks: DataFrame, deps: DataFrame, finished: DataFrame) -> DataFrame:
    """(node, task, state) after further tasks (``finished``) are done: newly_ready, still_ready or blocked."""
    before = ready(tasks, deps).withColumn("was", F.lit(True))
    more = finished.select("node", "task").distinct().withColumn("now", F.lit(True))
    after = tasks.join(more, ["node", "task"], "left").withColumn("done", F.col("done") | F.coalesce("now", F.lit(False))).drop("now")
    open_ones = ready(after, deps).withColumn("is", F.lit(True))
    rest = after.where("not done").select("node", "task").join(open_ones, ["node", "task"], "left").join(before, ["node", "task"], "left")
    state = F.when(F.col("is").isNull(), "blocked").when(F.col("was").isNull(), "newly_ready").otherwise("still_ready")
    return rest.select("node", "task", state.alias("state")).distinct()


def complete(tasks: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Whether all tasks of a node are done.

    With ``nodes`` (node, node_type; null type: no such node) nodes that are no dag or have no tasks are complete, unknown ones are not.
    """
    done = tasks.groupBy("node").agg(F.bool_and("done").alias("complete"))
    if nodes is None:
        return done
    kind = F.col("node_type")
    return nodes.join(done, "node", "left").select("node", F.when(kind.isNull(), False).when(kind != "dag", True).otherwise(F.coalesce("complete", F.lit(True))).alias("complete"))


def unknown_needs(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    known = tasks.select("node", F.col("task").alias("needs"))
    return deps.join(known, ["node", "needs"], "left_anti")


def cycle_residual(deps: DataFrame) -> DataFrame:
    """Tasks that can't be put in order: those on cycles and all that need them.

    Graphs whose dependencies all lead to lower (or all to higher) tasks have an order and go no further.
    The others are peeled by tasks that hold many whole graphs at once; graphs of more than ``GROUP``
    dependencies are contracted by joins instead.
    """
    rows = deps.select("node", "task", "needs").distinct()
    per = rows.groupBy("node").agg(F.count("*").alias("n"), F.bool_or(F.col("needs") >= F.col("task")).alias("up"), F.bool_or(F.col("needs") <= F.col("task")).alias("down"))
    mixed = spill(per.where("up and down").select("node", (F.col("n") > GROUP).alias("large")), "graph-mixed")
    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    small = rows.join(mixed.where("not large"), "node", "left_semi").repartition("node").sortWithinPartitions("node")
    arrow = to_arrow_schema(rows.select("node", "task").schema)

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in segmented.whole_groups(batches, ["node"]):
            graph = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            left = t.select(["node", "task"]).take(pa.array(_unordered(graph, t["task"], t["needs"])))
            yield left.cast(arrow).combine_chunks().to_batches()[0] if left.num_rows else pa.RecordBatch.from_pylist([], schema=arrow)

    out = small.mapInArrow(peel, f"node {kind['node']}, task {kind['task']}")
    large = mixed.where("large")
    return out if large.isEmpty() else out.unionByName(contract(rows.join(large, "node", "left_semi")).rows)


def _unordered(graph: np.ndarray, task: pa.ChunkedArray, needs: pa.ChunkedArray) -> np.ndarray:
    """One row of each task that can't be put in order, in many graphs at once: rounds over the tasks without open needs."""
    n = len(graph)
    names = pa.chunked_array([*task.chunks, *needs.chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    _, ids = np.unique(np.concatenate([graph, graph]) * (int(names.max(initial=0)) + 1) + names, return_inverse=True)
    user, need = ids[:n], ids[n:]
    open_needs = np.bincount(user, minlength=ids.max(initial=-1) + 1)
    by_need = np.argsort(need, kind="stable")
    first = np.searchsorted(need[by_need], np.arange(len(open_needs) + 1))
    free = np.flatnonzero(open_needs == 0)
    while len(free):
        size = first[free + 1] - first[free]
        at = np.repeat(first[free] - np.cumsum(size) + size, size) + np.arange(size.sum())
        hit, times = np.unique(user[by_need[at]], return_counts=True)
        open_needs[hit] -= times
        free = hit[open_needs[hit] == 0]
    stuck, row = np.unique(user, return_index=True)
    return row[open_needs[stuck] > 0]


class Contracted(NamedTuple):
    rows: DataFrame
    rounds: int


def contract(deps: DataFrame) -> Contracted:
    """The residual of large graphs by joins alone, and how many tables were written one after the other.

    A task with one need is in the residual just if that need is. So all tasks of one need are taken
    out at once: pointers along their needs are followed, each round four times as far, to a task with
    several needs, to a task without any, or for ever, which is a cycle. Dependencies then lead to where
    the pointers end; those on tasks without needs go. Tasks that are left with one need are taken out
    in the next phase. When nothing changes any more, every task needs one that is left: all are in the residual.
    A chain takes a logarithmic number of rounds; in other graphs a phase is at least a round of peeling.
    """
    left, rounds, phases = spill(deps.select("node", "task", "needs").distinct(), "graph-left"), 1, []
    while True:
        degree = spill(left.groupBy("node", "task").agg(F.count("*").alias("n"), F.min("needs").alias("at")), "graph-degrees")
        n_tasks, n_deps, n_single = degree.agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") == 1)).first()
        rounds += 1
        if not n_tasks:
            stuck = left.select("node", "task")
            break
        several = degree.where("n > 1").select("node", F.col("task").alias("at"), F.lit(True).alias("several"))
        ends, reached = degree.where("n = 1").select("node", "task", "at"), 1
        if n_single:
            moved = True
            while moved and reached <= 2 * n_single:
                ends = spill(_further(_further(ends.select("node", "task", "at"))), "graph-pointers")
                moved, reached, rounds = not ends.where("moved").isEmpty(), 4 * reached, rounds + 1
            # Pointers that still move after more steps than there are tasks go round.
            ends = ends.join(several, ["node", "at"], "left").select("node", "task", "at", F.col("moved").alias("cycle"), F.coalesce("several", F.lit(False)).alias("several"))
            phases.append(ends)
        else:
            ends = ends.select("node", "task", "at", F.lit(False).alias("cycle"), F.lit(False).alias("several"))
        to = ends.select("node", F.col("task").alias("needs"), F.col("at").alias("end"), "cycle", F.col("several").alias("goes_on"))
        kept = left.join(degree.where("n > 1").select("node", "task"), ["node", "task"], "left_semi")
        kept = kept.join(to, ["node", "needs"], "left").join(several.withColumnRenamed("at", "needs"), ["node", "needs"], "left")
        # A need on a cycle becomes a need of oneself.
        need = F.when(F.col("cycle"), F.col("task")).when(F.col("goes_on"), F.col("end")).when(F.col("several"), F.col("needs"))
        left = spill(kept.select("node", "task", need.alias("needs")).where("needs is not null").distinct(), "graph-left")
        rounds += 1
        if not n_single and left.count() == n_deps:
            stuck = left.select("node", "task").distinct()
            break
    for ends in reversed(phases):
        later = stuck.select("node", F.col("task").alias("at"))
        stuck = stuck.unionByName(ends.where("cycle").select("node", "task")).unionByName(ends.where("several and not cycle").join(later, ["node", "at"], "left_semi").select("node", "task"))
        stuck = spill(stuck, "graph-stuck")
        rounds += 1
    return Contracted(stuck, rounds)


def _further(pointers: DataFrame) -> DataFrame:
    """Each pointer goes on to where the pointer of its end leads; ``moved``: there was one."""
    next_ = pointers.select("node", F.col("task").alias("at"), F.col("at").alias("next"))
    return pointers.select("node", "task", "at").join(next_, ["node", "at"], "left").select("node", "task", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved"))


def visits(log: DataFrame) -> DataFrame:
    """Per project and node the visits and the last one."""
    return log.groupBy("project", "to_node").agg(F.count("*").alias("visits"), F.max("ts").alias("last_ts"))


def visit_warning(n: Column, most: Column) -> Column:
    """``limit`` at the cap, ``near`` from 80 % of it; a cap of 0 or less means 10."""
    cap = F.when(most <= 0, 10).otherwise(most)
    return F.when(n >= cap, "limit").when(n >= 0.8 * cap, "near").otherwise("ok")


def taken(log: DataFrame, most: int = 10) -> DataFrame:
    """Attempted transitions (project, seq, ts, to_node; ``reset`` rows start anew) with ``taken``: False beyond a node's visits.

    A node's visits since the last reset are its earlier attempts, up to the cap, so no state is folded. Rows with
    ``jump`` (if there is such a column) are taken whatever the cap.
    """
    cap = most if most > 0 else 10
    cold, hot = segmented.split(log, ["project"])
    reset = F.coalesce("reset", F.lit(False))
    w = W.partitionBy("project").orderBy("ts", "seq")
    rows = cold.withColumn("epoch", F.count_if(reset).over(w.rowsBetween(W.unboundedPreceding, 0))).where(~reset)
    n = F.row_number().over(W.partitionBy("project", "epoch", "to_node").orderBy("ts", "seq"))
    rows = rows.withColumn("visit", n.cast("bigint"))
    if hot is not None:
        rows = rows.unionByName(_hot_visits(hot, reset))
    jumps = F.coalesce("jump", F.lit(False)) if "jump" in log.columns else F.lit(False)
    return rows.withColumn("taken", (F.col("visit") <= cap) | jumps)


def _hot_visits(log: DataFrame, reset: Column) -> DataFrame:
    """Epochs and visits of projects with very many rows, by scans in one order."""
    sums = ordered(log.withColumn("_reset", reset.cast("bigint")), ["project"], ["ts", "seq"], sums=("_reset",)).rows
    first = sums.where("at = 0").select(F.col("project").alias("_project"), (F.col("sum__reset") - F.col("_reset")).alias("_before"))  # a row a hot project
    epochs = sums.join(F.broadcast(first), F.col("project").eqNullSafe(F.col("_project"))).withColumn("epoch", F.col("sum__reset") - F.col("_before")).where(~reset).select(*log.columns, "epoch")
    visits = ordered(epochs, ["project", "epoch", "to_node"], ["ts", "seq"]).rows
    return visits.select(*log.columns, "epoch", (F.col("at") + 1).alias("visit"))


def known_jumps(log: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log without jumps to nodes (id) that there are none of, and those jumps."""
    wrong = log.where(F.coalesce("jump", F.lit(False))).join(nodes.select(F.col("id").alias("to_node")), "to_node", "left_anti").select(*log.columns)
    return log.join(wrong.select("project", "seq"), ["project", "seq"], "left_anti").select(*log.columns), wrong


def states(log: DataFrame, most: int = 10) -> DataFrame:
    """Per project where it stands since its last reset: current node, transitions, its visits there, refusals, last activity."""
    rows = taken(log, most)
    at = F.struct("ts", "seq")
    per = rows.groupBy("project", "epoch").agg(
        F.max_by("to_node", F.when(F.col("taken"), at)).alias("current_node"), F.count_if("taken").alias("transitions"), F.count_if(~F.col("taken")).alias("refused"),
        F.max_by("visit", F.when(F.col("taken"), at)).alias("visits"), F.max(F.when(F.col("taken"), F.col("ts"))).alias("last_activity"),
    )
    return per.groupBy("project").agg(F.max_by(F.struct("current_node", "transitions", "refused", "visits", "last_activity"), "epoch").alias("x")).select("project", "x.*")


def status(state: DataFrame, nodes: DataFrame, edges: DataFrame, tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Per project its node with its ways out in order, the visit warning and the node's tasks by state.

    state: project, current_node, visits; nodes: id, node_type, max_visits; tasks and deps by node.
    """
    ways = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("priority", "seq", "dst"))).alias("x")).select(F.col("src").alias("id"), F.transform("x", lambda e: e["dst"]).alias("ways"))
    open_ones = ready(tasks, deps).groupBy("node").agg(F.count("*").alias("ready"))
    work = tasks.groupBy("node").agg(F.count("*").alias("tasks"), F.count_if("done").alias("completed")).join(open_ones, "node", "left").na.fill(0, ["ready"])
    work = work.withColumnRenamed("node", "id")
    rows = state.join(nodes, F.col("current_node") == F.col("id"), "left").join(ways, "id", "left").join(work, "id", "left")
    dag = lambda c: F.when(F.col("node_type") == "dag", F.col(c))
    return rows.select(
        "project", "current_node", F.array_join(F.coalesce("ways", F.array().cast("array<string>")), ",").alias("ways"), visit_warning(F.col("visits"), F.coalesce("max_visits", F.lit(0))).alias("warning"),
        dag("tasks").alias("tasks"), dag("completed").alias("completed"), dag("ready").alias("ready"), (dag("tasks") - dag("completed") - dag("ready")).alias("blocked"),
    )


def completed_tasks(log: DataFrame) -> DataFrame:
    """From a log of keys ``node:task`` (project, key, ts): each node's completed tasks and when the last was done."""
    node, task = F.substring_index("key", ":", 1), F.regexp_replace("key", "^[^:]*:", "")
    once = log.groupBy("project", node.alias("node"), task.alias("task")).agg(F.max("ts").alias("ts"))
    got = once.groupBy("project", "node").agg(F.array_join(F.array_sort(F.collect_list("task")), ",").alias("tasks"), F.max("ts").alias("last"))
    return got


def steps(log: DataFrame) -> DataFrame:
    """Each transition with the node before it."""
    cold, hot = segmented.split(log, ["project"])
    w = W.partitionBy("project").orderBy("ts", "seq")
    out = cold.withColumn("from_node", F.lag("to_node").over(w))
    if hot is None:
        return out
    return out.unionByName(ordered(hot, ["project"], ["ts", "seq"], previous="to_node").rows.select(*log.columns, F.col("before").alias("from_node")))


def timeline(parts: list[DataFrame], since: str | None, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` events in order of time, those without one last, and counts of all.

    Times may be timestamps or ISO texts; texts are compared as such, and empty ones count as missing.
    """
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    as_text = isinstance(every.schema["ts"].dataType, StringType)
    at = F.nullif("ts", F.lit("")) if as_text else F.col("ts")
    if since:
        every = every.where(at.isNull() | (at >= (F.lit(since) if as_text else F.lit(since).cast("timestamp_ntz"))))
    return every.orderBy(at.asc_nulls_last(), "source", "ref").limit(most), every.groupBy("source").agg(F.count("*").alias("n"))
