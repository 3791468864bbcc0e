"""The operators as queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, curves, jaccard, languages, packing, quality, records, resampling, secrets, sharding, substrings, templates, tries
from brindle.llm.common import table

#: Shards of op5, tokens of a window of op7.
SHARDS, CAPACITY = 16, 1024


def op1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = records.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return records.scan(spark, path, digest=True)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(table(spark, sf_dir, "documents"), digest=True)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op4_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return curves.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(own: bpe.Codec, text: str, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), work=digest, schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=CAPACITY)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.measure(docs, model=model)


def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.articles(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def digest(_: str, spans: list) -> tuple:
        own = [s for s in spans if s[2] != "markov"]
        say = lambda x: ",".join(f"{k}:{a}:{b}" for a, b, k in x)
        return (*[sum(s[2] == k for s in own) for k in ("assign", "access", "hex")], hashlib.sha256(say(own).encode()).hexdigest(), say(spans))

    return secrets.scan(docs, secrets.train(docs), work=digest, schema="n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    lead = F.crc32(conv.cast("string").cast("binary")) % 4
    return tries.trie(*tries.rebuilt(tries.places(table(spark, sf_dir, "conversations")), conv - conv % 20, lead, most=3))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = languages.learn(docs, teaches=part != 1)
    held_out = F.coalesce(part == 1, F.lit(False)).alias("held_out")
    return languages.identify(docs.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_records": op1_records,
    "op2_substrings": op2_substrings,
    "op3_jaccard": op3_jaccard,
    "op4_curves": op4_curves,
    "op5_shard": op5_shard,
    "op6_bpe": op6_bpe,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_templates": op9_templates,
    "op10_secrets": op10_secrets,
    "op11_resample": op11_resample,
    "op12_trie": op12_trie,
    "op13_languages": op13_languages,
}

# Words as in the operators' contracts, windows and shingles compared as whole sequences.
WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a text's UTF-8 bytes, with the table of its 256 steps.
CRC_TABLE = "SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)"
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(@) + 1), lambda i: CAST('0x' || substr(hex(encode(@)), 2 * i - 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"""
TERMS = rf"coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

ORACLES: dict[str, str] = {
    "op2_substrings": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
s AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS k FROM s),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT rid, i + j AS pos FROM win SEMI JOIN rep USING (k), range(0, 35) AS t(j)),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM x ANTI JOIN cov USING (rid, pos) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)""",
    "op3_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("text,", LOWER + ",", 1)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM reach r JOIN edge e ON r.b = e.x)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op11_resample": f"""
WITH k AS ({CRC_TABLE}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS w FROM documents),
b AS (SELECT {TERMS} AS w FROM benchmark),
fd AS (SELECT rid, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, range(1, 4) AS t(n))),
fb AS (SELECT array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, range(1, 4) AS t(n))),
h AS (SELECT s, {CRC.replace("@", "s")} % 10000 AS bucket FROM (SELECT s FROM fd UNION SELECT s FROM fb), k),
sb AS (SELECT bucket, count(*) AS n FROM fd JOIN h USING (s) GROUP BY bucket),
tb AS (SELECT bucket, count(*) AS n FROM fb JOIN h USING (s) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM fd) + 10000.0::DOUBLE AS s, (SELECT count(*) FROM fb) + 10000.0::DOUBLE AS t),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(tb.n, 0) + 1)::DOUBLE * total.s / ((sb.n + 1)::DOUBLE * total.t))) AS BIGINT) AS gain FROM sb LEFT JOIN tb USING (bucket), total),
w AS (SELECT rid, count(*) AS n, sum(gain) AS weight FROM fd JOIN h USING (s) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (rid)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, n_words >= 20 AND doc_id IS NOT NULL AS open FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY open ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY open) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND r <= 5 * n // 100 THEN r END AS rank FROM z""",
    "op12_trie": f"""
WITH k AS ({CRC_TABLE}),
t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS g, {CRC.replace("@", "s")} % 4 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t), k),
r AS (SELECT c.conv_id, 0 AS own, place, digest, words FROM c JOIN o ON o.conv_id = c.g AND place < h
  UNION ALL SELECT conv_id, 1, place, digest, words FROM c JOIN o USING (conv_id) WHERE place >= h),
s AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS key, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)),
n AS (SELECT conv_id, max(depth) AS n FROM s GROUP BY conv_id),
p AS (SELECT s.*, depth = n AS ends FROM s JOIN n USING (conv_id) UNION ALL SELECT conv_id, 0, '', 0, n IS NULL FROM c LEFT JOIN n USING (conv_id)),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY key, depth),
kids AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
sub AS (SELECT left(key, 64 * j) AS key, sum((n_convs - 1) * words) AS saved, count_if(n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM own) GROUP BY 1)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN sub USING (key) LEFT JOIN nodes up ON own.depth > 0 AND up.key = left(own.key, 64 * (own.depth - 1))""",
}
