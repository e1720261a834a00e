"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.llm import private_data, quality
from tallymark.llm.common import documents, id_bucket, stage, table
from tallymark.llm.decontamination import leaks
from tallymark.llm.divergence import divergence
from tallymark.llm.fingerprints import fingerprints
from tallymark.llm.hard_negatives import mine
from tallymark.llm.html_text import extract
from tallymark.llm.language import identify, learn
from tallymark.llm.near_duplicates import near_duplicates
from tallymark.llm.packing import pack_documents
from tallymark.llm.substrings import without_repeats
from tallymark.llm.tokens import count_tokens
from tallymark.llm.warc import read_archives, resolved, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(True))
    docs = documents(spark, folder, "doc_id", "text").withColumn("held_out", held_out)
    positives = table(spark, folder, "labels").filter((F.col("quality") == 1) & ~held_out)
    model = quality.fit(docs.filter(~F.col("held_out")), positives)
    scored = quality.score(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@_query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_tokens(documents(spark, folder, "doc_id", "text"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@_query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder, "doc_id", "text"))


# Links from all shingles that two documents share, and their closure.
ORACLES["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
         range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
long AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM long a JOIN long b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of USING (doc_id)"""


@_query
def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder, "doc_id", "text"))


@_query
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(documents(spark, folder, "doc_id", "text"))


@_query
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"), ["page_id", "url"])


@_query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(True))
    docs = documents(spark, folder, "doc_id", "text", "lang").withColumn("held_out", held_out)
    profiles = learn(docs.filter(~F.col("held_out")))
    return identify(docs, profiles, ["doc_id", "held_out"])


@_query
def op8_private_data(spark: SparkSession, folder: str) -> DataFrame:
    found = private_data.find(documents(spark, folder, "doc_id", "text"), ["doc_id"])
    return found.select(
        "doc_id", *[private_data.count(F.col("base"), kind).alias(f"n_{kind}") for kind in private_data.KINDS],
        F.sha2(private_data.listed(F.col("base")), 256).alias("base_sha256"), private_data.listed(F.col("spans")).alias("spans"))


@_query
def op9_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(documents(spark, folder, "doc_id", "text"))


@_query
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(documents(spark, folder, "doc_id", "text"), table(spark, folder, "benchmark"))


ORACLES["op13_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END::BIGINT AS refers_to FROM f"""


@_query
def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = write_archives(table(spark, folder, "pages"))
    read = stage(read_archives(archives, payloads=False))
    sound = F.when(F.col("error").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("archive record: "), "error")))
    return resolved(read).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", sound.alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, sum(coalesce(o.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total::HUGEINT + 5 * v)::HUGEINT AS p FROM cells JOIN v USING (lang)),
lt AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM cells GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total::HUGEINT + 5 * v)::HUGEINT AS q FROM lt JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50"""


@_query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(documents(spark, folder, "lang", "source", "text"))


ORACLES["op11_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


@_query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
