"""Whole folders of workflow texts as one DataFrame of nodes, edges, tasks and old steps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.formats import parse_graph

ROW = (
    "kind string, seq int, id string, name string, src string, dst string, node_type string, is_start boolean, is_end boolean, max_visits int, prompt string, mcps array<string>, tools array<string>, "
    "trigger string, tool string, phrases array<string>, priority int, node string, needs array<string>, extra string, error string"
)
NAMES = [c.strip().split()[0] for c in ROW.split(", ")]
#: Keys of a node that have columns of their own; others are kept as JSON in ``extra``.
OWN = {"id", "name", "node_type", "is_start", "is_end", "max_visits", "prompt_injection", "mcps_enabled", "tools_blocked", "tasks"}


def _row(kind: str, seq: int, **more) -> tuple:
    return tuple(({"kind": kind, "seq": seq} | more).get(n) for n in NAMES)


def _texts(values) -> list[str]:
    """A list of texts; a single value is a list of one."""
    return [str(v) for v in (values if isinstance(values, list) else [] if values is None else [values])]


def _servers(x: dict) -> list[str]:
    return _texts(x["mcps_enabled"]) if x.get("mcps_enabled") is not None else ["*"]


def _needs(x: dict, *names: str) -> list[str]:
    missing = [n for n in names if x.get(n) is None]
    if missing:
        raise ValueError(f"{x.get('id', 'an item')}: no {', '.join(missing)}")
    return [str(x[n]) for n in names]


def _node(k: int, n: dict) -> list[tuple]:
    (own,) = _needs(n, "id")
    kind = str(n.get("node_type") or "wave")
    if kind not in ("wave", "dag", "milestone"):
        raise ValueError(f"{own}: no such node_type: {kind}")
    extra = {key: v for key, v in n.items() if key not in OWN}
    out = [_row(
        "node", k, id=own, name=str(n.get("name") or own), node_type=kind, is_start=bool(n.get("is_start")), is_end=bool(n.get("is_end")), max_visits=int(n.get("max_visits") or 10),
        prompt=n.get("prompt_injection"), mcps=_servers(n), tools=_texts(n.get("tools_blocked")), extra=json.dumps(extra, sort_keys=True) if extra else None,
    )]
    for i, t in enumerate(n.get("tasks") or []):
        (task,) = _needs(t, "id")
        out.append(_row("task", i, id=task, node=own, name=str(t.get("name") or task), needs=_texts(t.get("dependencies")), prompt=t.get("prompt"), mcps=_servers(t), tools=_texts(t.get("tools_blocked"))))
    return out


def _edge(k: int, e: dict) -> tuple:
    own, src, dst = _needs(e, "id", "from", "to")
    on = e.get("condition") or {}
    return _row("edge", k, id=own, src=src, dst=dst, trigger=str(on.get("type") or "always"), tool=on.get("tool"), phrases=_texts(on.get("phrases")), priority=1 if e.get("priority") is None else int(e["priority"]))


def rows_of(text: str | None) -> list[tuple]:
    """Rows of one text: ``node``, ``edge``, ``task`` and ``step``, or one row of kind ``error`` if it can't be read."""
    try:
        doc = parse_graph(text or "")
        if not isinstance(doc, dict) or not any(doc.get(k) for k in ("nodes", "steps")):
            raise ValueError("neither nodes nor steps")
        out = [r for k, n in enumerate(doc.get("nodes") or []) for r in _node(k, n)]
        out += [_edge(k, e) for k, e in enumerate(doc.get("edges") or [])]
        out += [_row("step", k, id=str(x.get("id", k)), name=x.get("name"), tools=_texts(x.get("tools_blocked"))) for k, x in enumerate(doc.get("steps") or [])]
    except (ValueError, KeyError, TypeError, AttributeError, IndexError, RecursionError) as e:
        return [_row("error", 0, error=f"{type(e).__name__}: {e}")]
    return out


@F.udtf(returnType=ROW, useArrow=True)
class ParseWorkflow:
    """Table function of a text; also by name in SQL once ``register`` has been called."""

    def eval(self, text: str):
        yield from rows_of(text)


def register(spark: SparkSession, name: str = "parse_workflow") -> None:
    spark.udtf.register(name, ParseWorkflow)


def read_workflows(spark: SparkSession, path: str, pattern: str = "*.y*ml") -> DataFrame:
    """(path, then the columns of ROW) of every workflow text below a folder; broken ones are rows with an error (files of no bytes, which Spark skips, have none)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    files = files.select("path", F.col("content").cast("string").alias("text"))
    return files.lateralJoin(ParseWorkflow(F.col("text").outer())).drop("text")


def frames(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and task needs of many workflows, keyed by path, in the form that ``operators.graph`` takes.

    Nodes without a way out are ends, whatever their text says.
    """
    edges = rows.where("kind = 'edge'").select("path", "id", "src", "dst", F.col("trigger").alias("kind"), "tool", "phrases", "priority", "seq")
    ways = edges.select("path", F.col("src").alias("id"), F.lit(True).alias("_out")).distinct()
    nodes = rows.where("kind = 'node'").select("path", "id", "name", "node_type", "is_start", "is_end", "max_visits", "prompt", "mcps", "tools", "extra", "seq")
    nodes = nodes.join(ways, ["path", "id"], "left").withColumn("is_end", F.col("is_end") | F.col("_out").isNull()).drop("_out")
    needs = rows.where("kind = 'task'").select(F.struct("path", "node").alias("node"), F.col("id").alias("task"), F.explode("needs").alias("needs"))
    return nodes, edges, needs
