"""Search and top-k over a capability catalog."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brindle.functions import constants as C
from brindle.functions import scoring as S
from brindle.functions import text as X
from brindle.operators import segmented
from brindle.operators.ordered import ordered
from brindle.session import spill

#: Bytes of query vectors that a pass over the rows serves; scores that a task computes at a time.
QUERY_BYTES, CELLS = 4 << 20, 1 << 20


def vector_topk(rows: DataFrame, query: DataFrame, k: int = 10, *, key: str = "seq", vec: str = "embedding") -> DataFrame:
    """The k rows of largest cosine to one query vector (a one-row DataFrame ``q``)."""
    scored = rows.join(F.broadcast(query)).select(F.col(key), F.round(S.cosine(F.col(vec), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


class _Best:
    """The k best rows of each of many queries so far, ties to smaller keys."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.key, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: queries by rows."""
        q, i = np.nonzero(scores >= self.least[:, None])
        query, key, score = np.concatenate([self.query, q]), np.concatenate([self.key, keys[i]]), np.concatenate([self.score, scores[q, i]])
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        start = np.searchsorted(query, np.arange(len(self.least)))
        kept = np.arange(len(query)) - start[query] < self.k
        self.query, self.key, self.score = query[kept], key[kept], score[kept]
        full = start + self.k <= np.append(start[1:], len(query))
        self.least[full] = score[start[full] + self.k - 1]


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length 1; those of another size, of norm 0 or with parts that are missing or not finite are 0."""
    out = np.zeros((len(vectors), dim))
    whole = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(zero_copy_only=False)
    out[whole] = vectors.filter(pa.array(whole)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    size = np.sqrt((out * out).sum(1))
    good = np.isfinite(size) & (size > 0)
    out[~good] = 0
    out[good] /= size[good, None]
    return out


def vector_topk_many(rows: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "seq", vec: str = "embedding", query_key: str = "query", block: int = QUERY_BYTES) -> DataFrame:
    """(query, rank, key, score): the k rows of largest cosine to every one of many query vectors (columns query_key and vec).

    Blocks of queries, ``block`` bytes at most, meet all rows in passes: each task keeps the k best of every query of the
    block, whatever the number of rows, and Spark merges the tasks. Beyond one block, each pass ends in a shared table.
    """
    spark = rows.sparkSession
    dim = (queries.agg(F.max(F.size(vec))).first()[0] or 0) or 1
    out = f"`{query_key}` bigint, `{key}` bigint, score double"

    def one(ids: list[int], q: np.ndarray) -> DataFrame:
        ids_ = np.array(ids, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, step = _Best(len(ids_), k), max(1, CELLS // len(ids_))
            for b in batches:
                for a in range(0, b.num_rows, step):
                    part = b.slice(a, step)
                    best.add(part[key].to_numpy(zero_copy_only=False).astype(np.int64), np.round(q @ _units(part[vec], dim).T, 6) + 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids_[best.query]), pa.array(best.key), pa.array(best.score)], names=[query_key, key, "score"])

        found = rows.select(key, vec).mapInArrow(run, out)
        w = W.partitionBy(query_key).orderBy(F.desc("score"), key)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_key, "rank", key, "score")

    size = max(1, block // (8 * dim))
    ids, vectors, parts = [], [], []
    for r in queries.where(F.col(query_key).isNotNull()).select(query_key, vec).toLocalIterator():  # one block at a time
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == size:
            parts.append(spill(one(ids, _units(pa.array(vectors, pa.list_(pa.float64())), dim)), "topk"))
            ids, vectors = [], []
    if ids or not parts:
        last = one(ids or [0], _units(pa.array(vectors or [None], pa.list_(pa.float64())), dim))
        parts.append(last if ids else last.limit(0))
    return reduce(DataFrame.unionByName, parts)


def vector_topk_by_group(rows: DataFrame, query: DataFrame, k: int, group: str, *, key: str = "seq", vec: str = "embedding") -> DataFrame:
    scored = rows.join(F.broadcast(query)).select(F.col(group), F.col(key), F.round(S.cosine(F.col(vec), F.col("q")), 6).alias("score"))
    best = W.partitionBy(group).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def keyword_fallback(rows: DataFrame, query: str, k: int) -> DataFrame:
    """Substring matches in name or description, ignoring case, all with score 1."""
    low = query.lower()
    hit = F.lower("tool_name").contains(low) | F.lower("description").contains(low)
    return rows.where(hit).select("mcp_name", "tool_name", F.lit(1.0).alias("score")).orderBy("mcp_name", "tool_name").limit(k)


def learned_weights(selections: DataFrame) -> DataFrame:
    """(tool, keyword, weight): a step for each selection, up to a cap. Input: tool, keyword."""
    return selections.groupBy("tool", "keyword").agg(F.round(F.least(F.lit(C.WEIGHT_MOST), C.WEIGHT_STEP * F.count("*")), 6).alias("weight"))


def learned_boost(tools: DataFrame, weights: DataFrame, query: list[str]) -> DataFrame:
    """Per tool the sum of its weights for the query's keywords over their number."""
    hits = weights.where(F.col("keyword").isin(query)).groupBy("tool").agg(F.sum("weight").alias("w"))
    return tools.join(hits, "tool", "left").select("tool", F.round(F.coalesce("w", F.lit(0.0)) / max(len(query), 1), 6).alias("boost"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which edit distances don't give."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def letters_shared(text: Column, query: str) -> Column:
    """Letters that a text and the query have in common, counted with repeats: no alignment can match more."""
    many = [F.least(F.lit(n), F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) for c, n in sorted(Counter(query).items())]
    return reduce(lambda a, b: a + b, many, F.lit(0))


def ratio_bound(text: Column, query: str) -> Column:
    """At least the sequence ratio, from lengths and letters alone."""
    total = F.length(text) + len(query)
    return F.when(total > 0, 2.0 * letters_shared(text, query) / total).otherwise(1.0)


def index_bounds(tools: DataFrame, query: str) -> DataFrame:
    """Tools with ``known`` (keyword share and learned boost of the score) and ``bound``, which the score can't exceed."""
    words = X.query_tokens(F.lit(query))
    own = X.index_tokens(F.col("tool_name"), F.col("description"))
    share = F.size(F.array_intersect(words, own)) / F.greatest(F.size(words), F.lit(1))
    low = query.lower()
    name, said = F.lower(F.coalesce("tool_name", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    rows = tools.withColumn("known", share * 0.5 + F.coalesce("boost", F.lit(0.0)))
    return rows.withColumn("bound", F.col("known") + ratio_bound(name, low) * 0.3 + ratio_bound(said, low) * 0.2 + 1e-9)


def index_candidates(tools: DataFrame, query: str, k: int = 10, least: float = 0.15) -> DataFrame:
    """Tools whose exact score can still be among the k best: those of bounds up to the k-th score of the best bounds."""
    rows = spill(index_bounds(tools, query).where(F.col("bound") > least), "index-bounds")  # read twice
    first = _index_scores(rows.orderBy(F.desc("bound"), "seq").limit(4 * k), query, least)
    best = [r["score"] for r in first.orderBy(F.desc("score"), "seq").limit(k).select("score").collect()]
    return rows if len(best) < k else rows.where(F.round("bound", 2) >= best[-1])


def _index_scores(rows: DataFrame, query: str, least: float) -> DataFrame:
    low = F.lit(query.lower())
    score = F.col("known") + sequence_ratio(low, F.lower("tool_name")) * 0.3 + sequence_ratio(low, F.lower("description")) * 0.2
    return rows.withColumn("raw", score).where(F.col("raw") > least).withColumn("score", F.round("raw", 2))


def index_search(tools: DataFrame, query: str, k: int = 10, least: float = 0.15) -> DataFrame:
    """Keyword share, name and description similarity and learned boost (column ``boost``): filtered by bounds, then verified."""
    tools = tools.select("mcp_name", "tool_name", "description", "seq", "boost")
    rows = _index_scores(index_candidates(tools, query, k, least), query, least)
    return rows.select("mcp_name", "tool_name", X.category(F.col("tool_name"), F.col("description")).alias("category"), "score", "seq").orderBy(F.desc("score"), "seq").limit(k)


def by_category(tools: DataFrame, category: str, mcp: str | None = None, k: int = 20) -> DataFrame:
    """Tools of one category, of one server if it is given, in the catalog's order up to k."""
    rows = tools if mcp is None else tools.where(F.col("mcp_name") == mcp)
    rows = rows.where(X.category(F.col("tool_name"), F.col("description")) == category)
    return rows.select("mcp_name", "tool_name", "description", "seq").orderBy("seq").limit(k)


def rerank_head(rows: DataFrame, query: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The first n rows of each group (in order of ``place``) by cosine to the query, the others after them as they were."""
    scored = rows.join(F.broadcast(query)).withColumn("score", F.round(S.cosine(F.col("vec"), F.col("q")), 6))  # the query is one row
    head = F.when(F.col("place") <= n, -F.col("score"))
    w = W.partitionBy(by).orderBy(F.col("place") > n, head, "place")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).drop("q", "vec")


def mean_similarity(rows: DataFrame, by: str, score: str) -> DataFrame:
    """The mean score of each group, where a missing one counts as 0."""
    return rows.groupBy(by).agg(F.round(F.avg(F.coalesce(score, F.lit(0.0))), 6).alias("avg_score"), F.count("*").alias("n"))


def asof_selection(searches: DataFrame, selections: DataFrame) -> DataFrame:
    """Each selection with the last search before it (by project); both: project, seq, ts.

    Where searches have ``results`` and selections a ``tool``, ``hit`` says whether the tool is among them.
    """
    listed = "results" in searches.columns and "tool" in selections.columns
    held = F.struct(F.col("seq").alias("search_seq"), *(["results"] if listed else []))
    both = searches.select("project", "ts", "seq", held.alias("s")).unionByName(selections.select("project", "ts", "seq", *(["tool"] if listed else [])), allowMissingColumns=True)
    hit = [F.coalesce(F.array_contains("last.results", F.col("tool")), F.lit(False)).alias("hit")] if listed else []
    cold, hot = segmented.split(both, ["project"])
    last = F.last("s", ignorenulls=True).over(W.partitionBy("project").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = cold.withColumn("last", last).where(F.col("s").isNull())
    if hot is not None:
        # Searches are counted through; a selection belongs to the search of its number, if that is the project's own.
        counted = ordered(hot.withColumn("_search", F.col("s").isNotNull().cast("bigint")), ["project"], ["ts", "seq"], sums=("_search",)).rows
        own = counted.where(F.col("s").isNotNull()).select(F.col("project").alias("_project"), F.col("sum__search").alias("_n"), F.col("s").alias("last"))
        chosen = counted.where(F.col("s").isNull()).join(own, F.col("project").eqNullSafe(F.col("_project")) & (F.col("sum__search") == F.col("_n")), "left")
        rows = rows.unionByName(chosen.select(*both.columns, "last"))
    return rows.select("project", "seq", F.col("last.search_seq").alias("search_seq"), *hit)


def tool_counts(proxies: DataFrame, tools: DataFrame, internal: DataFrame | None = None) -> DataFrame:
    """Tools of every proxy, those with none included; ``internal`` (mcp_name, tool_count) adds built-in ones, told apart by ``kind``."""
    n = tools.groupBy("mcp_name").agg(F.count("*").alias("tool_count"))
    got = proxies.join(n, "mcp_name", "left").select("mcp_name", F.coalesce("tool_count", F.lit(0)).alias("tool_count"))
    if internal is None:
        return got
    return got.withColumn("kind", F.lit("subprocess")).unionByName(internal.select("mcp_name", "tool_count").withColumn("kind", F.lit("internal")))
