"""The queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.bond import hard_negatives, relabelled
from docketry.llm.common import table
from docketry.llm.decontaminate import decontaminate_documents
from docketry.llm.exact_dedup import exact_groups
from docketry.llm.licenses import oracle as license_oracle
from docketry.llm.licenses import scan_documents
from docketry.llm.mixing import mix_documents
from docketry.llm.prefix_trie import prefix_trie
from docketry.llm.quality import score_documents as score_quality
from docketry.llm.setsketch import near_sets
from docketry.llm.sharding import shard_documents
from docketry.llm.simhash import near_duplicates
from docketry.llm.suffix_dedup import dedup_documents
from docketry.llm.toxicity import score_documents as score_toxicity
from docketry.llm.warc import derivatives, responses
from docketry.llm.warc import oracle as warc_oracle


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_documents(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op11_bond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_sets(table(spark, sf_dir, "documents"), shingle=4)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_suffix_dedup, op2_warc, op3_quality, op4_sharding, op5_exact_dedup, op6_licenses, op7_decontamination, op8_simhash, op9_toxicity, op10_mixing, op11_bond, op12_setsketch, op13_prefix_trie]
    return {f.__name__: f for f in every}


OP5 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item_id, ws[s + 1 : s + 10] AS win FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) AS s FROM i WHERE len(ws) > 0)),
wins AS (SELECT win, len(win) AS n, list(item_id) AS items FROM w GROUP BY ALL),
lens AS (SELECT DISTINCT n FROM wins),
p AS (
  SELECT doc_id, n, unnest(range(len(ws) - n + 1)) AS s, ws FROM d, lens WHERE len(ws) >= n),
h AS (SELECT p.doc_id, p.s, p.n, wins.items FROM p JOIN wins ON p.n = wins.n AND p.ws[p.s + 1 : p.s + p.n] = wins.win),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(unnest(items) AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP10 = r"""
WITH d AS (
  SELECT *, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || copy), 1, 15) AS BIGINT) AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy
        FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents))),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
c AS (SELECT *, CAST([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (
  SELECT source, source_size, rank, least(cap, max(CASE WHEN level * weight < cap THEN level END) OVER () * weight) AS target FROM l),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, d.h, d.copy, row_number() OVER w AS place,
         CAST(sum(d.size) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW w AS (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size, d.copy)),
e AS (SELECT o.*, turn, CASE WHEN target > 0 THEN (upto + turn * source_size) / target END AS finish FROM o, range(2) AS r(turn)),
f AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY finish, rank, turn, place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM e WHERE finish IS NOT NULL),
b AS (SELECT CAST(floor(sum(size) * 1.5) AS BIGINT) AS budget FROM d),
k AS (SELECT rank, place, CAST(sum(greatest(0, least(size, budget - cum + size))) AS BIGINT) AS taken FROM f, b GROUP BY ALL)
SELECT o.doc_id, o.size, o.source_size, o.target, coalesce(k.taken, 0) AS taken FROM o LEFT JOIN k USING (rank, place)
"""

OP11 = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, ws[i : i + 3] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) s
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * same >= 80 * (p.n + q.n - same)),
c AS (SELECT doc_id AS a, doc_id AS r FROM d UNION SELECT l.b, c.r FROM c JOIN l ON c.a = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(r) AS component_id FROM c GROUP BY a) USING (doc_id)
"""

OP13 = """
WITH t AS (
  SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, list(said ORDER BY r) AS said FROM t GROUP BY c),
h AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: list_transform(range(8), lambda b: (ascii(x) >> b) & 1)))),
                            lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1))), CAST(4294967295 AS BIGINT)) % 9 AS h FROM k),
b AS (SELECT h.c, list_concat(coalesce(p.said, [])[1 : h], h.said[h + 1 :]) AS said FROM h LEFT JOIN k p ON p.c = h.c - h.c % 5),
x AS (SELECT c, said[1 : d] AS path, d, len(said) = d AS ends FROM (SELECT c, said, unnest(range(len(said) + 1)) AS d FROM b)),
n AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN d > 0 THEN path[1 : d - 1] END AS up, CASE WHEN d > 0 THEN octet_length(encode(path[d].text)) ELSE 0 END AS bytes
  FROM x GROUP BY path, d),
g AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN g ON n.path = g.up),
s AS (
  SELECT top, CAST(sum((n_children = 0)::INT) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
  FROM (SELECT *, path[1 : unnest(range(d + 1))] AS top FROM m) GROUP BY top)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s ON s.top = m.path LEFT JOIN n u ON u.path = m.up
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc_oracle(), "op5_exact_dedup": OP5, "op6_licenses": license_oracle(), "op7_decontamination": OP7, "op10_mixing": OP10, "op11_bond": OP11, "op12_setsketch": OP12, "op13_prefix_trie": OP13}
