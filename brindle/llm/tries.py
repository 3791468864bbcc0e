"""A prefix trie of conversations by prefix-doubling names.

Turns are named densely; in each round two neighbouring blocks of equal length give a block of
twice the length, named by the pair of names (a missing right half is 0). Prefixes are composed by
binary decomposition: the prefix of length d is the one without d's lowest set bit, followed by
one block, and is named by that pair. Rows of one name are the members of one node.

Every naming is a scan over rows in order of (pair, conversation), which splits a pair that many
conversations share among tasks; names rise with their pairs, so the names of whole conversations put
them in the order of a walk through the trie. A node's members are then neighbours in that order,
and sums over subtrees are differences of running sums. Rounds: twice the logarithm of the longest
conversation; rows of all rounds: about twice the turns, and one a conversation and round.

Rows without a conversation id belong to none and are left out. Null roles and texts are empty. Turns
stand in order of ``turn``, null first, those of one number in order of the SHA-256 of role and text, so
repeated rows are turns of their own. An empty table has no nodes. Texts are used whole, as
SHA-256 values and counts of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_rows, pick
from brindle.operators.ordered import ordered, sorted_by_range
from brindle.session import spill

#: Turns of a conversation that one row of the conversations' table serves in joins.
SALT = 4096
#: Ids of ends that are handed on as one row.
ENDS = 1 << 15
#: What separates words.
WORD = r"[^\x20\x09-\x0D]+"


def places(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, digest, words) of every turn, its place counted from 0."""
    rows = pick(rows, conv, turn, role, text).toDF("conv_id", "turn", "role", "text").where("conv_id is not null")
    role_, text_ = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    base = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text_, F.lit(WORD)).cast("bigint").alias("words"))
    got = ordered(spill(base, "turns"), ["conv_id"], [F.asc_nulls_first("turn"), "digest"])
    return got.rows.select("conv_id", F.col("at").alias("place"), "digest", "words")


def rebuilt(turns: DataFrame, group: Column, lead: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another one's first turns, as (all conversations, turns).

    ``group`` is the conversation that a conversation's first ``lead`` turns (``most`` at most) come
    from, both computed from conv_id; of its own turns those after its first ``lead`` follow.
    """
    convs = turns.where("place = 0").select("conv_id", group.alias("from"), lead.alias("lead"))
    heads = turns.where((F.col("place") < most) & (F.col("conv_id") == group)).groupBy(F.col("conv_id").alias("from"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))  # ``most`` turns at most
    given = convs.join(heads, "from").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("lead").cast("int"))).alias("t")).select("conv_id", F.lit(0).alias("own"), "t.*")
    own = turns.where(F.col("place") >= lead).select("conv_id", F.lit(1).alias("own"), "place", "digest", "words")
    # Gaps between lead and own turns close by counting once more.
    rows = ordered(spill(given.unionByName(own), "rebuilt"), ["conv_id"], ["own", "place"]).rows
    return convs.select("conv_id"), rows.select("conv_id", F.col("at").alias("place"), "digest", "words")


def _blocks(turns: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Named blocks (conv_id, idx, name, n, words) of 1, 2, 4 ... turns, and (conv_id, r, n): conversations in the trie's order."""
    got = ordered(turns, ["digest"], ["conv_id", "place"])
    now = got.rows.select("conv_id", F.col("place").alias("idx"), (F.col("run") + 1).alias("name"), F.lit(1).cast("bigint").alias("n"), "words", "row")
    out = [now]
    while (now.agg(F.max("idx")).first()[0] or 0) > 0:
        left, right = F.col("idx") % 2 == 0, F.col("idx") % 2 == 1
        pairs = now.groupBy("conv_id", F.shiftright("idx", 1).alias("idx")).agg(
            F.max(F.when(left, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(0)).cast("bigint").alias("r"),
            F.sum("n").alias("n"), F.max_by("words", "idx").alias("words"),
        )
        now = ordered(pairs, ["l", "r"], ["conv_id", "idx"]).rows.select("conv_id", "idx", (F.col("run") + 1).alias("name"), "n", "words", "row")
        out.append(now)
    return out, now.select("conv_id", F.col("row").alias("r"), "n")


def prefixes(blocks: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, name, least, words) of every prefix: its name, the least conversation that has it, the words of its last turn."""
    done, named = None, 0
    for j in reversed(range(len(blocks))):
        size = 1 << j
        full = blocks[j].where((F.col("idx") % 2 == 0) & (F.col("n") == size)).select("conv_id", (F.col("idx") * size).alias("start"), F.col("name").alias("b"), "words")
        pairs = full.where("start = 0").withColumn("p", F.lit(0).cast("bigint"))
        if done is not None:
            before = done.where(F.col("depth") % (2 * size) == 0).select("conv_id", F.col("depth").alias("start"), F.col("name").alias("p"))
            pairs = pairs.unionByName(full.where("start > 0").join(before, ["conv_id", "start"]))
        got = ordered(pairs, ["p", "b"], ["conv_id"], head="conv_id")
        rows = got.rows.select("conv_id", (F.col("start") + size).alias("depth"), (F.col("run") + 1 + named).alias("name"), F.col("head_of").alias("least"), "words")
        named += got.n_runs
        done = rows if done is None else done.unionByName(rows)
    return done


def _ends(rows: DataFrame) -> DataFrame:
    """(least, depth, ends_sha256) of (least, depth, conv_id): ids in order, joined by commas, hashed.

    Tasks join the ids of their ranges to long strings; one task a node then feeds a node's strings
    to the hash, one at a time, since SHA-256 takes its input in order.
    """

    def join(batches):
        held, low, ids = None, None, []
        for b in batches:
            rows_, least, depth, first, text = zip(b["least"].to_pylist(), b["depth"].to_pylist(), b["conv_id"].to_pylist(), strict=True), [], [], [], []
            for k, d, c in rows_:
                if held != (k, d) or len(ids) == ENDS:
                    if ids:
                        least.append(held[0]), depth.append(held[1]), first.append(low), text.append(",".join(ids))
                    held, low, ids = (k, d), c, []
                ids.append(str(c))
            yield {"least": least, "depth": depth, "first": first, "ids": text}
        if ids:
            yield {"least": [held[0]], "depth": [held[1]], "first": [low], "ids": [",".join(ids)]}

    def digest(batches):
        held, state = None, None
        for b in batches:
            least, depth, out = [], [], []
            for k, d, ids in zip(b["least"].to_pylist(), b["depth"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if held != (k, d):
                    if held:
                        least.append(held[0]), depth.append(held[1]), out.append(state.hexdigest())
                    held, state = (k, d), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield {"least": least, "depth": depth, "ends_sha256": out}
        if held:
            yield {"least": [held[0]], "depth": [held[1]], "ends_sha256": [state.hexdigest()]}

    packed = map_rows(sorted_by_range(rows, ["least", "depth", "conv_id"]), "least bigint, depth bigint, first bigint, ids string", join)
    dealt = packed.repartition("least", "depth").sortWithinPartitions("least", "depth", "first")
    return map_rows(dealt, "least bigint, depth bigint, ends_sha256 string", digest)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations (conv_id) with turns (conv_id, place, digest, words).

    Per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    spark = convs.sparkSession
    convs = spill(convs.select("conv_id"), "conversations")
    root, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    blocks, order = _blocks(turns)
    walk = order.select("conv_id", "r", "n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / SALT))).alias("part"))
    rows = prefixes(blocks).withColumn("part", F.floor(F.col("depth") / SALT)).join(walk, ["conv_id", "part"])
    rows = spill(rows.select("conv_id", "depth", "least", "words", "r", (F.col("depth") == F.col("n")).alias("ends")), "prefixes")

    nodes = rows.groupBy("least", "depth").agg(F.count("*").alias("n_convs"), F.min("r").alias("lo"), F.max("words").alias("words"))
    above = rows.select(F.col("conv_id").alias("least"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent"))
    nodes = nodes.join(above, ["least", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(root).cast("bigint")))
    if n_convs:
        top = spark.createDataFrame([(root, 0, n_convs, 0, 0, None)], "least bigint, depth bigint, n_convs bigint, lo bigint, words bigint, parent bigint")
        nodes = nodes.unionByName(top)
    nodes = spill(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("least"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["least", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    nodes = spill(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("bigint")), "nodes")

    # A node opens at its first member, outer nodes first, and closes at its last one.
    last = F.when(F.col("depth") == 0, F.lit(max(n_convs, 1) - 1)).otherwise(F.col("lo") + F.col("n_convs") - 1)
    none = F.lit(0).cast("bigint")
    opens = nodes.select(F.col("lo").alias("pos"), F.lit(0).alias("closes"), "depth", "least", "own", "leaf")
    closes = nodes.select(last.alias("pos"), F.lit(1).alias("closes"), "depth", "least", none.alias("own"), none.alias("leaf"))
    events = ordered(opens.unionByName(closes), ["pos", "closes", "depth"], ["least"], sums=("own", "leaf")).rows
    sign = F.when(F.col("closes") == 1, 1).otherwise(-1)
    sums = events.groupBy("least", "depth").agg(
        F.sum(sign * F.col("sum_own") + F.col("own")).cast("bigint").alias("saved_tokens"), F.sum(sign * F.col("sum_leaf") + F.col("leaf")).cast("bigint").alias("n_leaves")
    )

    bare = convs.join(turns.where("place = 0").select("conv_id"), "conv_id", "left_anti")
    ends = rows.where("ends").select("least", "depth", "conv_id").unionByName(bare.select(F.lit(root).cast("bigint").alias("least"), F.lit(0).cast("bigint").alias("depth"), "conv_id"))
    hashed = _ends(spill(ends, "ends"))
    out = nodes.join(sums, ["least", "depth"]).join(hashed, ["least", "depth"], "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


__all__ = ["places", "prefixes", "rebuilt", "trie"]
