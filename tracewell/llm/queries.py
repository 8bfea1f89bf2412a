"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import alignment, centroids, decontaminate, fingerprints, language, mixing, pii, quality, sharding, simhash, substring_dedup, token_store, warc
from tracewell.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), within=True)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session (spark.tracewell.pii.key); for the synthetic tables, which hold nobody's data, an example does where none is set."""
    key = spark.conf.get("spark.tracewell.pii.key", "example key for synthetic tables")
    return pii.pseudonymised_documents(table(spark, sf_dir, "documents"), key.encode(), ["doc_id", "text"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_winnowing, op3_simhash, op4_quality, op5_mixing, op6_pii, op7_warc, op8_language, op9_token_store, op10_decontamination, op11_centroids, op12_alignment, op13_sharding)}

_SQUARES = "list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))"
_ASSIGN = f"SELECT rn, arg_min(k, d * 16 + k) AS k, min(d) AS d FROM (SELECT q.rn, c.k, {_SQUARES} AS d FROM q CROSS JOIN %s c) GROUP BY rn"
_MOVE = """SELECT c.k, coalesce(m.v, c.v) AS v FROM %s c LEFT JOIN (SELECT k, list(f ORDER BY i) AS v FROM
  (SELECT k, i, (sum(x) - ((sum(x) %% count(*)) + count(*)) %% count(*)) // count(*) AS f FROM (SELECT a.k, unnest(range(1, 65)) AS i, unnest(q.v)::HUGEINT AS x FROM %s a JOIN q USING (rn)) GROUP BY k, i) GROUP BY k) m USING (k)"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: SQL for the queries that SQL can express. The others are compared with brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: CAST(CAST(instr('0123456789abcdef', hex[i]) - 1 AS TINYINT)::BIT AS VARCHAR)[5:8]), '') AS bits, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: CAST(bits[5 * i + k + 1] AS INT) * (16 >> k)))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b""",
    "op11_centroids": f"""WITH q AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM q QUALIFY k < 16),
a0 AS MATERIALIZED ({_ASSIGN % "c0"}), c1 AS MATERIALIZED ({_MOVE % ("c0", "a0")}),
a1 AS MATERIALIZED ({_ASSIGN % "c1"}), c2 AS MATERIALIZED ({_MOVE % ("c1", "a1")}),
a2 AS MATERIALIZED ({_ASSIGN % "c2"}), c3 AS MATERIALIZED ({_MOVE % ("c2", "a2")}),
a3 AS MATERIALIZED ({_ASSIGN % "c3"})
SELECT q.vec_id, CAST(a.k AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 a JOIN q USING (rn) JOIN c3 c ON c.k = a.k""",
    "op10_decontamination": f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, k, i AS j, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM (SELECT *, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, k, j, item_id FROM dw JOIN bw USING (k, win)),
r AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item, min(i) - 1 AS start, count(*) + k - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, k, i - j ORDER BY i) AS run FROM h) GROUP BY doc_id, item_id, k, i - j, run),
l AS (SELECT doc_id, n AS longest_words, start AS longest_start, item AS longest_item FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, start, item) = 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(longest_words, 0) AS longest_words, longest_start, longest_item FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)""",
}
