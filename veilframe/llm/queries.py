"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import collocations, decontam, divergence, language_id, licenses, mixing, near_dedup, pii, quality, sentencepiece_codec, sharding, toxicity, url_filter
from veilframe.llm.common import crc32_mod, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


PIECE_MODEL = "piece_bpe_32k.model"
URL_RULES = (
    url_filter.Rule("org/", True),
    url_filter.Rule("example.org/es/", False),
    url_filter.Rule("example.org/en/1", False),
    url_filter.Rule("com/fr/", True),
    url_filter.Rule("com/de/", False),
)


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(read(spark, sf_dir, "documents")))


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(read(spark, sf_dir, "documents"), percent=85)


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read(spark, sf_dir, "documents"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 4) == 2
    model = language_id.fit(docs, ~held_out)
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 3) == 1
    model = toxicity.fit(*toxicity.fit_sample(docs, read(spark, sf_dir, "labels"), ~held_out))
    return toxicity.toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(licenses.scan_licenses(read(spark, sf_dir, "documents")))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(read(spark, sf_dir, "documents"))


@query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


# All documents that share a shingle are compared; fine for small tables.
ORACLE["op4_near_dedup"] = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) + any_value(y.n) AS n, count(*) AS shared
  FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT node, b FROM reached JOIN both_ways ON other = a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM sets JOIN (SELECT node, min(other) AS least_id FROM reached GROUP BY node) ON doc_id = node
"""

ORACLE["op11_source_divergence"] = r"""
WITH
docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
found AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT k) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, t.n AS n_lang
  FROM groups g JOIN kept t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM cells),
shares AS (
  SELECT s.lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (s.total::HUGEINT + 5 * v) AS p,
         1 + 1000000000::HUGEINT * (n_lang + 5) // (l.total + 5 * v) AS q
  FROM sized s JOIN langs l USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50
"""

ORACLE["op12_collocations"] = r"""
WITH
docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
ones AS (SELECT lang, unnest(w) AS p FROM worded),
f1 AS (SELECT lang, p, count(*) AS f FROM ones GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
twos AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS g FROM worded WHERE len(w) >= 2),
threes AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM worded WHERE len(w) >= 3),
f2 AS (SELECT lang, g, count(*) AS a FROM twos GROUP BY ALL),
f3 AS (SELECT lang, g, count(*) AS a FROM threes GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.g, c.a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.p = c.g[1] JOIN f1 y ON y.lang = c.lang AND y.p = c.g[2] WHERE c.a >= 10
  UNION ALL
  SELECT c.lang, c.g, c.a, 1, x.f, y.a
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.p = c.g[1] JOIN f2 y ON y.lang = c.lang AND y.g = c.g[2:3]
  UNION ALL
  SELECT c.lang, c.g, c.a, 2, x.a, y.f
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.g = c.g[1:2] JOIN f1 y ON y.lang = c.lang AND y.p = c.g[3]),
scored AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
around AS (
  SELECT lang, part, max(a) AS around
  FROM (SELECT lang, g[1:2] AS part, a FROM f3 UNION ALL SELECT lang, g[2:3], a FROM f3) GROUP BY ALL),
kept AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.part = b.g
  WHERE o.around IS NULL OR 100 * o.around < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
