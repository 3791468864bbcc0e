"""Scans over all rows in one order, dealt to tasks by ranges: numbers, runs and running sums.

Rows are range-partitioned and sorted, so a key with any share of the rows is split among
tasks. Each task numbers its own rows; the ends of the tasks (one row a task) are folded into
what each task must add, and that small table, as long as there are tasks, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from brindle.session import spill


@dataclass
class Ordered:
    """The numbered rows, and how many rows and runs there are."""

    rows: DataFrame
    n_rows: int
    n_runs: int


def changes(batch: pa.RecordBatch, key: list[str], before: tuple | None) -> np.ndarray:
    """Whether each row's key differs from the row before (``before`` for the first one); null equals null."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    for c in key:
        col = batch[c]
        if n > 1:
            a, b = col.slice(0, n - 1), col.slice(1)
            differ = pc.fill_null(pc.not_equal(a, b), False)
            out[1:] |= pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    if n:
        out[0] = before is None or before != tuple(batch[c][0].as_py() for c in key)
    return out


def sorted_by_range(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def ordered(rows: DataFrame, key: list[str], by: list[str | Column], *, head: str | None = None, sums: tuple[str, ...] = (), previous: str | None = None) -> Ordered:
    """All rows in order of (key, by), with

    ``row`` (place among all rows, from 0), ``run`` (number of the row's key, from 0), ``at``
    (place among the key's rows), ``head_of`` (the bigint column ``head`` of the key's first row),
    ``sum_c`` (the sum of the bigint column c up to this row) for each c of ``sums``, and ``before`` (the
    column ``previous`` of the key's row before; null for its first row).

    The rows should be cheap to read twice, since range bounds are sampled. The result is a table
    in the shared folder. Key and order columns of bounded width keep what the driver sees small.
    """
    own = rows.columns
    schema = StructType(list(rows.schema.toNullable().fields))
    schema.add("pid", IntegerType()).add("row", LongType()).add("run", LongType()).add("at", LongType()).add("first", BooleanType())
    if head:
        schema.add("head_of", LongType())
    for c in sums:
        schema.add(f"sum_{c}", LongType())
    if previous:
        schema.add("before", rows.schema[previous].dataType)
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        n_rows, run, began, first_value, before = 0, -1, 0, None, None
        totals = [0] * len(sums)
        earlier = pa.nulls(1, arrow.field("before").type) if previous else None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = changes(b, key, before)
            place = np.arange(n_rows, n_rows + n)
            starts = np.maximum.accumulate(np.where(new, place, began))
            runs = run + np.cumsum(new)
            cols = [b[c] for c in own] + [pa.array(np.full(n, pid, np.int32)), pa.array(place), pa.array(runs), pa.array(place - starts), pa.array(runs == 0)]
            if head:
                values = b[head].to_numpy(zero_copy_only=False)
                heads = np.where(starts >= n_rows, values[np.maximum(starts - n_rows, 0)], values[0] if first_value is None else first_value)
                first_value = int(heads[-1])
                cols.append(pa.array(heads.astype(np.int64)))
            for i, c in enumerate(sums):
                total = totals[i] + np.cumsum(pc.fill_null(b[c], 0).to_numpy(zero_copy_only=False).astype(np.int64))
                totals[i] = int(total[-1])
                cols.append(pa.array(total))
            if previous:
                own_values = b[previous].cast(earlier.type)
                shifted = pa.concat_arrays([earlier, own_values.slice(0, n - 1)])
                cols.append(pc.if_else(pa.array(new), pa.scalar(None, earlier.type), shifted))
                earlier = own_values.slice(n - 1)
            before = tuple(b[c][n - 1].as_py() for c in key)
            n_rows, run, began = n_rows + n, int(runs[-1]), int(starts[-1])
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    got = spill(sorted_by_range(rows, [*key, *by]).mapInArrow(scan, schema), "ordered")
    last = [F.max_by(f"sum_{c}", "row").alias(f"sum_{c}") for c in sums] + ([F.max_by("head_of", "row").alias("head_of")] if head else [])
    last += [F.max_by(previous, "row").alias("last_value")] if previous else []
    ends = got.groupBy("pid").agg(
        F.count("*").alias("n"), (F.max("run") + 1).alias("runs"), F.max_by("at", "row").alias("at"),
        F.min_by(F.struct(*key), "row").alias("low"), F.max_by(F.struct(*key), "row").alias("high"), *last,
    )
    before, carried, n_rows, n_runs, at, head_of, totals, value = None, [], 0, 0, 0, None, [0] * len(sums), None
    for e in sorted(ends.collect(), key=lambda r: r["pid"]):  # one row a task
        goes_on = before is not None and before == e["low"]
        carried.append((e["pid"], n_rows, n_runs - goes_on, at + 1 if goes_on else 0, head_of if goes_on else None, goes_on, value if goes_on else None, *totals))
        value = e["last_value"] if previous else None
        at = e["at"] + (at + 1 if goes_on and e["runs"] == 1 else 0)
        head_of = (head_of if goes_on and e["runs"] == 1 else e["head_of"]) if head else None
        before, n_rows, n_runs = e["high"], n_rows + e["n"], n_runs - goes_on + e["runs"]
        totals = [t + e[f"sum_{c}"] for t, c in zip(totals, sums, strict=True)]
    if len(carried) < 2:  # one task, which began with nothing
        return Ordered(got.drop("pid", "first"), n_rows, n_runs)
    more = "pid int, row_0 bigint, run_0 bigint, at_0 bigint, head_0 bigint, goes_on boolean, value_0 " + (rows.schema[previous].dataType.simpleString() if previous else "int") + "".join(f", total_{i} bigint" for i in range(len(sums)))
    small = F.broadcast(rows.sparkSession.createDataFrame(carried, more))  # one row a task
    on = F.col("first") & F.col("goes_on")
    out = got.join(small, "pid").select(
        *own, (F.col("row") + F.col("row_0")).alias("row"), (F.col("run") + F.col("run_0")).alias("run"), (F.col("at") + F.when(on, F.col("at_0")).otherwise(0)).alias("at"),
        *([F.when(on, F.col("head_0")).otherwise(F.col("head_of")).alias("head_of")] if head else []),
        *[(F.col(f"sum_{c}") + F.col(f"total_{i}")).alias(f"sum_{c}") for i, c in enumerate(sums)],
        *([F.when(F.col("row") == 0, F.col("value_0")).otherwise(F.col("before")).alias("before")] if previous else []),
    )
    return Ordered(out, n_rows, n_runs)
