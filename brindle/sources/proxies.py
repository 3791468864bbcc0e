"""Configurations of tool servers (TOML tables ``[proxies.<name>]``), read from whole folders and written back."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: seconds without use after which a server is stopped.
IDLE_S = 600.0
ROW = "name string, command string, args array<string>, env map<string,string>, idle_timeout_seconds double, error string"


def rows_of(text: str | None) -> Iterator[tuple]:
    """One row a server; one row with an error for a text that is no TOML or a server whose values have the wrong types."""
    try:
        servers = tomllib.loads(text or "").get("proxies", {})
    except tomllib.TOMLDecodeError as e:
        yield None, None, None, None, None, str(e)
        return
    for name, spec in servers.items() if isinstance(servers, dict) else ():
        if not isinstance(spec, dict):
            continue
        try:
            env = {str(k): str(v) for k, v in dict(spec.get("env", {})).items()}
            yield name, str(spec.get("command", "")), [str(a) for a in spec.get("args", [])], env, float(spec.get("idle_timeout_seconds", IDLE_S)), None
        except (TypeError, ValueError) as e:
            yield name, None, None, None, None, f"{type(e).__name__}: {e}"


@F.udtf(returnType=ROW, useArrow=True)
class ParseProxies:
    def eval(self, text: str):
        yield from rows_of(text)


def read_proxies(spark: SparkSession, path: str, pattern: str = "*.toml") -> DataFrame:
    """(path, then the columns of ROW) of every configuration below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("content").cast("string").alias("text")).lateralJoin(ParseProxies(F.col("text").outer())).drop("text")


def write_proxies(servers: DataFrame, path: str, by: str = "path") -> None:
    """Each configuration (the servers of one value of ``by``) as a TOML text in a folder of its own, servers by name."""

    @F.udf("string")
    def table(name, command, args, env, idle) -> str:
        lines = [f"[proxies.{json.dumps(name)}]", f"command = {json.dumps(command or '')}"]
        if args:
            lines.append(f"args = [{', '.join(map(json.dumps, args))}]")
        if env:
            lines.append("env = {" + ", ".join(f"{json.dumps(k)} = {json.dumps(v)}" for k, v in sorted(env.items())) + "}")
        if idle is not None and idle != IDLE_S:
            lines.append(f"idle_timeout_seconds = {float(idle)}")
        return "\n".join(lines)

    texts = servers.where(F.col("name").isNotNull()).select(F.element_at(F.split(by, "/"), -1).alias("config"), "name", table("name", "command", "args", "env", "idle_timeout_seconds").alias("text"))
    one = texts.groupBy("config").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: x["text"]), "\n\n").alias("value"))  # a configuration is small
    one.write.partitionBy("config").mode("overwrite").text(path)
