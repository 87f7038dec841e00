"""Registered queries of the thirteen operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe_codec, jaccard_join, language_id, lexical_search, near_duplicates, packing, quality_classifier, quality_rules, sharding, token_counts, url_filter, vector_search, whitening
from quire.llm.common import small_batches
from quire.llm.vocabulary import read_json, read_ranks

MULTI = "byte_bpe_multi_50k.tiktoken"
ENGLISH = "byte_bpe_50k.json"
#: Words in host names whose pages are listed; the list is derived from the pages themselves.
LISTED_TERMS = ("adult", "ads", "bets", "casino", "pills", "spam")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        small_batches(spark)
        return f(spark, folder)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = read_ranks(public_tokenizers.path(MULTI), public_tokenizers.PATTERN)
    coded = bpe_codec.encode_documents(table(spark, folder, "documents"), vocabulary, ["doc_id"])
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    trusted = quality_rules.trusted_ids(table(spark, folder, "labels"))
    return quality_rules.apply_rules(documents, quality_rules.fit_ratio(documents, trusted), ["doc_id"])


@query
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    listed = pages.filter(url_filter.host(F.col("url")).rlike("|".join(LISTED_TERMS))).select("url")
    return url_filter.filter_urls(pages, listed, ["page_id"]).drop("possible")


ORACLES["op3_url_filter"] = f"""
WITH parted AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
named AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM parted),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{"|".join(LISTED_TERMS)}') AND canonical <> ''),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM named)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = language_id.fold("doc_id", 5) == 0
    model = language_id.fit_languages(documents.filter(~held_out), ["doc_id"], "lang")
    return language_id.identify(documents, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = table(spark, folder, "documents").select("doc_id", "source", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = sharding.stratified_shards(narrow, "source", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = read_json(public_tokenizers.path(ENGLISH), public_tokenizers.PATTERN)
    counted = token_counts.count_tokens(table(spark, folder, "documents"), vocabulary, ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = read_json(public_tokenizers.path(ENGLISH), public_tokenizers.PATTERN)
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary, "doc_id")


@query
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = language_id.fold("doc_id", 3) == 1
    model = quality_classifier.fit_quality(documents, labels.filter(~held_out), "doc_id")
    return quality_classifier.score_quality(documents, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), "doc_id")


# Exact links by shared shingles, then everything that links reach.
ORACLES["op9_near_duplicates"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded),
classed AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS c, s FROM shingled),
nodes AS (SELECT c, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM classed WHERE c IS NOT NULL GROUP BY c),
spread AS (SELECT id, n, unnest(s) AS g FROM nodes),
meets AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM spread a JOIN spread b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
links AS (SELECT a, b FROM meets WHERE 100 * common >= 85 * (na + nb - common)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM classed d LEFT JOIN nodes k ON d.c = k.c LEFT JOIN roots r ON k.id = r.id"""


@query
def op10_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


@query
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings"), "vec_id", "embedding")
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "it")
    rows = white.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), each, "identity_error")
    return rows.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "it.whitened", "it.explained", "identity_error")


@query
def op12_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, folder, "documents"), "doc_id")


# The links of op9's statement at 80 percent, without its last column.
ORACLES["op12_jaccard_join"] = ORACLES["op9_near_duplicates"].replace("85 *", "80 *").replace(", coalesce(r.root, d.doc_id) = d.doc_id AS kept", "")


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("item_id", "rank", "doc_id", "score")


ORACLES["op13_lexical_search"] = r"""
WITH termed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sums AS (SELECT count(*) FILTER (len(t) > 0) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM termed),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
spread AS (SELECT r, len(t) AS n, unnest(t) AS term FROM termed),
times AS (SELECT r, n, term, count(*) AS tf FROM spread WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
holders AS (SELECT term, count(*) AS df FROM times GROUP BY term),
parts AS (
  SELECT r, term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))) AS part
  FROM times JOIN holders USING (term), sums),
scored AS (SELECT item_id, r, CAST(sum(part) AS BIGINT) AS score FROM parts JOIN asked USING (term) GROUP BY ALL HAVING sum(part) > 0),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scored JOIN termed USING (r))
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= 50"""
