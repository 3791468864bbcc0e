"""Importance resampling towards a target text: n-gram buckets by external sort-count.

The features of a text are its runs of 1 to 3 words, hashed into ``BUCKETS`` buckets. A first pass
writes them down as packed uint16 streams, many documents a row, with the documents' offsets. The
streams, not the texts, are then read twice: sorted and run-length encoded for the corpus' counts,
and gathered through the table of gains, summed by document with ``np.add.reduceat``. A text of
more than ``LONG`` words is written as its sorted runs at once (bucket and count: at most
``BUCKETS`` of each), so no row grows beyond a bound.

What the driver sees is one number a bucket and, for the ranks, one row a task. Ranks come from one
scan in order of score over the documents that can be drawn.

Null texts have no features: weight 0, never drawn. Rows without an id count in the corpus and get a
weight, but no score and no rank, and are not among the documents to draw from. Repeated rows are documents of their
own; those of equal score and id are ranked next to one another. An empty table gives no rows; an empty
target has no counts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks, map_rows, pick, texts_of
from brindle.operators.ordered import ordered
from brindle.session import spill

BUCKETS = 10_000
#: Characters of texts whose streams make a row.
ROW_CHARS = 100_000
#: Words of a text that are hashed at a time; a longer text is written as runs.
LONG = 50_000

# Letters are lowered, digits, small letters and all of UTF-8's longer sequences make words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split()


def features(own: list[bytes], first: np.ndarray, carry: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Buckets of the runs that end at each word, word by word; which of its three runs exist; CRCs that go on.

    ``first`` is each word's place in its text; runs that would begin before it don't exist. A run's
    CRC goes on from that of the run one word shorter that ends at the word before.
    """
    n = len(own)
    spaced = [b" " + w for w in own]
    one = np.fromiter(map(zlib.crc32, own), np.uint32, n)
    two = np.fromiter(map(zlib.crc32, spaced, chain([carry[0]], one[:-1].tolist())), np.uint32, n)
    three = np.fromiter(map(zlib.crc32, spaced, chain([carry[1]], two[:-1].tolist())), np.uint32, n)
    every = (np.stack([one, two, three], axis=1) % np.uint32(BUCKETS)).astype("<u2")
    there = first[:, None] >= np.arange(3)
    return every, there, (int(one[-1]), int(two[-1])) if n else carry


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets and how often each occurs."""
    s = np.sort(stream)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    return s[at], np.diff(np.append(at, len(s)))


def long_runs(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a long text's whole stream, ``LONG`` words at a time."""
    total, carry = np.zeros(BUCKETS, np.int64), (0, 0)
    for a in range(0, len(own), LONG):
        part = own[a : a + LONG]
        every, there, carry = features(part, np.arange(a, a + len(part)), carry)
        bucket, n = run_lengths(every[there])
        total[bucket] += n
    bucket = np.flatnonzero(total)
    return bucket.astype("<u2"), total[bucket]


STREAMS = "ids array<bigint>, n_words array<bigint>, n_features array<bigint>, offsets array<bigint>, stream binary, counts binary"


def streams(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed streams of many documents a row: ids, words and features of each, where each one's stream begins; counts only for runs."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids, texts = b[id_col].to_pylist(), texts_of(b[text_col])
            for lo, hi in chunks([len(t) for t in texts], ROW_CHARS):
                own = [words(t) for t in texts[lo:hi]]
                n = np.array([len(w) for w in own], np.int64)
                made = np.where(n > 1, 3 * n - 3, n)
                if hi - lo == 1 and n[0] > LONG:
                    bucket, count = long_runs(own[0])
                    offsets, stream, counts = [0], bucket.tobytes(), count.astype("<i8").tobytes()
                else:
                    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    every, there, _ = features(list(chain.from_iterable(own)), first)
                    offsets, stream, counts = np.cumsum(made) - made, every[there].tobytes(), None
                yield {"ids": [ids[lo:hi]], "n_words": [n], "n_features": [made], "offsets": [offsets], "stream": [stream], "counts": [counts]}

    return map_rows(pick(docs, id_col, text_col), STREAMS, run)


def _unpacked(b: dict) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    for stream, counts in zip(b["stream"], b["counts"], strict=True):
        own = np.frombuffer(stream.as_buffer(), "<u2") if len(stream.as_buffer()) else np.empty(0, "<u2")
        yield own, np.frombuffer(counts.as_buffer(), "<i8") if counts.is_valid else None


def counts(packed: DataFrame) -> np.ndarray:
    """Occurrences by bucket: each stream is sorted and run-length encoded, runs are added up in the task, then by Spark."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for stream, n in _unpacked(b):
                bucket, found = run_lengths(stream) if n is None else (stream, n)
                total[bucket] += found
        bucket = np.flatnonzero(total)
        yield {"bucket": bucket, "n": total[bucket]}

    out = np.zeros(BUCKETS, np.int64)
    summed = map_rows(packed.select("stream", "counts"), "bucket int, n bigint", run).groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in summed.collect():  # one row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, target over source, rounded down."""
    all_s, all_t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(row_id: int, seed: int = 42) -> int:
    """A document's Gumbel noise in thousandths, from its id."""
    h = int(hashlib.sha256(f"{seed}:{row_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(packed: DataFrame, gain: np.ndarray, *, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_features, weight, score) per document from the streams."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids = list(chain.from_iterable(b["ids"].to_pylist()))
            n = b["n_features"].flatten().to_numpy(zero_copy_only=False)
            weight, at = np.zeros(len(ids), np.int64), 0
            for (stream, many), made, offsets in zip(_unpacked(b), b["n_features"], b["offsets"], strict=True):
                got = gain[stream] if many is None else gain[stream] * many
                made, offsets = made.values.to_numpy(), offsets.values.to_numpy()
                full = np.flatnonzero(made)  # reduceat takes no empty ranges
                if len(full):
                    weight[at + full] = np.add.reduceat(got, offsets[full])
                at += len(made)
            score = [None if i is None else int(w) + noise(i, seed) for i, w in zip(ids, weight, strict=True)]
            yield {id_col: ids, "n_words": b["n_words"].flatten(), "n_features": n, "weight": weight, "score": score}

    return map_rows(packed, f"`{id_col}` bigint, n_words bigint, n_features bigint, weight bigint, score bigint", run)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", target_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Every document with its weight and score; ``rank`` numbers those drawn, best first.

    Of the documents with ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest
    scores are drawn, smaller ids first among equals: a sample without replacement, since scores hold Gumbel noise.
    """
    packed = spill(streams(docs, id_col=id_col, text_col=text_col), "streams")
    gain = gains(counts(packed), counts(streams(target, id_col=target_id, text_col=text_col)))
    rows = spill(weigh(packed, gain, seed=seed, id_col=id_col), "weights").withColumn("_down", -F.col("score"))
    open_ = (F.col("n_words") >= least_words) & F.col(id_col).isNotNull()
    best = ordered(rows.where(open_), ["_down", id_col], [])
    rank = F.when(F.col("row") < percent * best.n_rows // 100, F.col("row") + 1)
    out = [id_col, "n_features", "weight", "score"]
    return best.rows.select(*out, rank.alias("rank")).unionByName(rows.where(~open_).select(*out, F.lit(None).cast("bigint").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents alone, with all their columns."""
    id_col = options.get("id_col", "doc_id")
    return docs.join(resample(docs, target, **options).where("rank is not null").select(id_col).distinct(), id_col, "left_semi")


__all__ = ["counts", "draw", "features", "gains", "noise", "resample", "streams", "weigh", "words"]
