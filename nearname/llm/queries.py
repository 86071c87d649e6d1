"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearname.llm import (
    ann, best_fit, exact_dedup, language, mixing, packing, resampling, runs, secrets, sharding, simhash, tool_calls, wrappers,
)
from nearname.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_shards(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir))


@query
def op3_mix(spark, sf_dir):
    return mixing.mix_documents(documents(spark, sf_dir))


@query
def op4_length_buckets(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir))


#: The other operators hash, learn or follow queues, which SQL cannot restate; the tests hold
#: them against brute force, held-out languages and round trips.
ORACLES["op7_exact_dedup"] = r"""
WITH flat AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(content) AS text_sha256
FROM flat WINDOW same AS (PARTITION BY content)
"""


@query
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_table(documents(spark, sf_dir))


@query
def op8_simhash(spark, sf_dir):
    return simhash.near_duplicate_table(documents(spark, sf_dir))


@query
def op2_kmeans_tree_search(spark, sf_dir):
    return ann.search_embeddings(documents(spark, sf_dir, "embeddings"))


@query
def op10_language(spark, sf_dir):
    return language.language_table(documents(spark, sf_dir))


@query
def op5_wrappers(spark, sf_dir):
    return wrappers.extract_pages(documents(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op6_secrets(spark, sf_dir):
    return secrets.secret_table(documents(spark, sf_dir))


@query
def op9_tool_calls(spark, sf_dir):
    return tool_calls.linked_conversations(documents(spark, sf_dir, "conversations"))


@query
def op11_runs(spark, sf_dir):
    return runs.run_digests(documents(spark, sf_dir))


@query
def op12_best_fit(spark, sf_dir):
    return best_fit.pack_documents(documents(spark, sf_dir))


#: The CRC of a word is a fold over its bytes with the table of the polynomial 0xEDB88320.
ORACLES["op13_resampling"] = r"""
WITH bits AS (
    SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc
    FROM range(256) AS r(b)
), words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark)
), tall AS (
    SELECT doc_id, unnest(ws) AS w FROM words
), buckets AS (
    SELECT w, xor(4294967295, list_reduce(
        list_transform(range(strlen(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM tall), bits
), counts AS (
    SELECT bucket, count(doc_id) AS s, count(*) - count(doc_id) AS t FROM tall JOIN buckets USING (w) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)))) AS gain FROM counts
), weights AS (
    SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM tall JOIN buckets USING (w) JOIN gains USING (bucket) WHERE doc_id IS NOT NULL GROUP BY doc_id
), scored AS (
    SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents d LEFT JOIN weights w USING (doc_id)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""


@query
def op13_resampling(spark, sf_dir):
    return resampling.resampled_documents(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
