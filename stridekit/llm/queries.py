"""The registered queries of the subpackage: name -> (Spark builder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import decontam, langid, licenses, lm, mixing, neardup, negatives, pieces, quality, sharding, simhash, turntrie, urls
from .textblocks import with_crc

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
N_SHARDS = 40

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return put


@query("op8_rendezvous_sharding")
def op8(spark, sf):
    return sharding.shard_documents(read_table(spark, sf, "documents"), [1.0] * N_SHARDS)


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
        lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
widths AS (SELECT DISTINCT k FROM t),
x AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2),
        lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d, widths WHERE len(w) >= k),
hit AS (SELECT x.r, x.i, x.k, t.item_id FROM x JOIN t ON x.g = t.g AND x.k = t.k),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)"""


@query("op10_benchmark_decontamination", OP10_SQL)
def op10(spark, sf):
    return decontam.contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")).drop("spans")


OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)"""


@query("op2_minhash_near_dedup", OP2_SQL)
def op2(spark, sf):
    return neardup.near_duplicates(read_table(spark, sf, "documents"))


@query("op1_language_id")
def op1(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.train(langid.training_rows(docs))
    return langid.identify(with_crc(docs.select("doc_id", "text"), 5, 0), model).drop("text")


@query("op3_quality_classifier")
def op3(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.training_labels(read_table(spark, sf, "labels")))
    return quality.score(with_crc(docs, 3, 1), model).drop("text")


@query("op6_lm_scoring")
def op6(spark, sf):
    return lm.score_documents(read_table(spark, sf, "documents"))


@query("op4_simhash_fingerprints")
def op4(spark, sf):
    return simhash.with_near_counts(simhash.fingerprint_digest(read_table(spark, sf, "documents")))


@query("op5_license_scan")
def op5(spark, sf):
    return licenses.scan_documents(read_table(spark, sf, "documents"))


@query("op7_url_filter")
def op7(spark, sf):
    return urls.filter_urls(read_table(spark, sf, "pages"))


@query("op9_sentencepiece")
def op9(spark, sf):
    return pieces.encode(read_table(spark, sf, "documents").select("doc_id", "text")).drop("text")


_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""

OP11_SQL = rf"""
WITH t AS (SELECT conv_id, md5(len(r) || ':' || r || x) AS k, len(regexp_extract_all(x, '[^ 	-]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS p
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list(k ORDER BY p) AS s, list(w ORDER BY p) AS w, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM t GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.s, [])[1:o.h], o.s[o.h + 1:]) AS s, list_concat(coalesce(b.w, [])[1:o.h], o.w[o.h + 1:]) AS w
    FROM own o LEFT JOIN own b ON b.conv_id = o.base),
x AS (SELECT conv_id, s, w, unnest(range(0, len(s) + 1)) AS depth FROM r),
node AS MATERIALIZED (SELECT depth, s[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(w[depth]), 0) AS words,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '')) AS ends_sha256 FROM x GROUP BY ALL),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
told AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids USING (depth, path)),
above AS (SELECT path, (n_convs - 1) * words AS saved, CAST(n_children = 0 AS BIGINT) AS leaf, unnest(range(0, depth + 1)) AS d FROM told),
sums AS (SELECT d AS depth, path[1:d] AS path, sum(saved) AS saved, sum(leaf) AS leaves FROM above GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM told n JOIN sums USING (depth, path) LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]"""


@query("op11_conversation_trie", OP11_SQL)
def op11(spark, sf):
    return turntrie.prefix_trie(read_table(spark, sf, "conversations"))


@query("op12_source_mixing")
def op12(spark, sf):
    return mixing.mix_documents(read_table(spark, sf, "documents"))


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.r AS ar, c.vec_id AS id, a.label = c.label AS own,
        CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
    FROM e a JOIN e c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, ar, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST) AS k
    FROM s WHERE own QUALIFY k <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.ar, k ORDER BY s.score DESC, s.id NULLS LAST) AS rank
    FROM p JOIN s ON p.ar = s.ar AND NOT s.own AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, sf):
    e = read_table(spark, sf, "embeddings")
    moved = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, F.col("vec_id") % 100 == 0)
