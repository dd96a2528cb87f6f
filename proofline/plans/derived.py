"""Deterministic inputs that the catalogue derives from the given tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.columns import median_signature
from proofline.session import table


def commitment_sql(rows: str, keys: str, identity: str) -> str:
    """DuckDB CTEs ``hash_tree (keys, commitment, samples)`` of the identities of a table's rows by key."""
    return f"""
t0 AS (SELECT {keys}, h, count(*) AS n FROM (SELECT {keys}, sha256({identity}) AS h FROM {rows}) GROUP BY ALL),
t1 AS (SELECT {keys}, substr(h, 1, 6) AS p6, sha256(string_agg(h || '*' || n, ',' ORDER BY h)) AS t, sum(n) AS n FROM t0 GROUP BY ALL),
t2 AS (SELECT {keys}, substr(p6, 1, 3) AS p3, sha256(string_agg(t, ',' ORDER BY p6)) AS t, sum(n) AS n FROM t1 GROUP BY ALL),
hash_tree AS (SELECT {keys}, sha256(string_agg(t, ',' ORDER BY p3)) AS commitment, sum(n)::BIGINT AS samples FROM t2 GROUP BY ALL)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples: contributor = source, batch = language."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"), "text", F.col("source").alias("contributor_id"), F.col("lang").alias("batch_id"))


SAMPLES = "samples AS (SELECT 'doc-' || doc_id AS sample_id, text, source AS contributor_id, lang AS batch_id FROM documents)"

EXACT = (
    SAMPLES
    + """,
hashed AS (SELECT sha256(text) AS content_hash, sample_id AS path FROM samples WHERE text IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS r FROM hashed),
groups AS (SELECT content_hash, count(*) AS n, min(path) AS asset_id, list(path ORDER BY path) FILTER (r <= 20) AS paths FROM ranked GROUP BY content_hash HAVING count(*) > 1),
exact AS (
  SELECT asset_id, content_hash, n, paths,
         'F-DATASET-' || substr(sha256('{"asset_id":"' || asset_id || '","category":"EXACT_DUPLICATE","module":"dataset_integrity","stable_evidence_key":["' || array_to_string(list_sort(list_append(paths, content_hash)), '","') || '"]}'), 1, 24) AS finding_id,
         'sha256=' || content_hash AS e1, 'duplicate_count=' || n AS e2,
         CASE WHEN length('duplicate_paths=' || array_to_string(paths, ',')) > 512 THEN substr('duplicate_paths=' || array_to_string(paths, ','), 1, 498) || '...[truncated]' ELSE 'duplicate_paths=' || array_to_string(paths, ',') END AS e3
  FROM groups)"""
)


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median signatures of the embeddings (key = 2 id) and of copies with up to two bits flipped (key = 2 id + 1)."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", median_signature(F.col("embedding")).alias("s"))
    bit = lambda e: F.expr(f"shiftleft(1L, cast({e} as int))")
    flipped = F.col("s").bitwiseXOR(bit("vec_id % 60").bitwiseOR(bit("(vec_id * 7) % 60")))
    return base.select((F.col("vec_id") * 2).alias("k"), "s").union(base.select((F.col("vec_id") * 2 + 1).alias("k"), flipped.alias("s")))


SIGNATURES = """
v AS (SELECT vec_id, embedding AS e, list_sort(embedding[2:64])[32] AS m FROM embeddings),
bits AS (SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS s FROM v),
flips AS (SELECT vec_id, s, 64 - vec_id % 60 AS p, 64 - (vec_id * 7) % 60 AS q FROM bits),
once AS (SELECT *, substr(s, 1, p - 1) || CASE substr(s, p, 1) WHEN '1' THEN '0' ELSE '1' END || substr(s, p + 1) AS s1 FROM flips),
sig AS (SELECT vec_id * 2 AS k, s FROM bits UNION ALL
        SELECT vec_id * 2 + 1, CASE WHEN p = q THEN s1 ELSE substr(s1, 1, q - 1) || CASE substr(s1, q, 1) WHEN '1' THEN '0' ELSE '1' END || substr(s1, q + 1) END FROM once),
pairs AS (SELECT a.k AS a, b.k AS b, hamming(a.s, b.s) AS distance FROM sig a JOIN sig b ON a.k < b.k WHERE hamming(a.s, b.s) <= 10)"""


def assurance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings derived from the orders: four modules, their categories, severities and confidences by key."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('F-', lpad(cast(o_orderkey as string), 9, '0')) AS finding_id",
        "element_at(array('dataset_integrity', 'model_integrity', 'inference_integrity', 'distribution_shift'), cast(o_orderkey % 4 + 1 as int)) AS module",
        "element_at(array('sample', 'model', 'pipeline', 'dataset', 'output'), cast(o_custkey % 5 + 1 as int)) AS asset_type",
        "concat('asset-', cast(o_custkey as string)) AS asset_id",
        "element_at(array('NEAR_DUPLICATE', 'MODEL_SUBSTITUTION', 'OUTPUT_TAMPERING', 'BROAD_MULTILAYER_SHIFT', 'LABEL_ANOMALY', 'DEAD_CHANNEL', 'REPLAY_DETECTED', 'OUTPUT_SHIFT_ONLY'), cast(o_orderkey % 8 + 1 as int)) AS category",
        "element_at(array('INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'), cast((o_orderkey * 7 + o_custkey) % 5 + 1 as int)) AS severity",
        "cast((o_custkey % 100 + 1) as decimal(10, 6)) / 100 AS confidence",
        "element_at(array('ACCEPT', 'REVIEW', 'QUARANTINE', 'REJECT'), cast((o_orderkey + o_custkey) % 4 + 1 as int)) AS recommendation",
        "concat('limit-', cast(o_custkey % 37 as string)) AS limitation",
        "o_orderkey AS ingested_at",
    ).withColumn("confidence", F.col("confidence").cast("decimal(10,6)"))


FINDINGS = """
f AS (SELECT 'F-' || lpad(o_orderkey::VARCHAR, 9, '0') AS finding_id,
  ['dataset_integrity', 'model_integrity', 'inference_integrity', 'distribution_shift'][o_orderkey % 4 + 1] AS module,
  ['sample', 'model', 'pipeline', 'dataset', 'output'][o_custkey % 5 + 1] AS asset_type, 'asset-' || o_custkey AS asset_id,
  ['NEAR_DUPLICATE', 'MODEL_SUBSTITUTION', 'OUTPUT_TAMPERING', 'BROAD_MULTILAYER_SHIFT', 'LABEL_ANOMALY', 'DEAD_CHANNEL', 'REPLAY_DETECTED', 'OUTPUT_SHIFT_ONLY'][o_orderkey % 8 + 1] AS category,
  ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][(o_orderkey * 7 + o_custkey) % 5 + 1] AS severity,
  ((o_custkey % 100 + 1)::DECIMAL(18, 6) * 0.01)::DECIMAL(10, 6) AS confidence,
  ['ACCEPT', 'REVIEW', 'QUARANTINE', 'REJECT'][(o_orderkey + o_custkey) % 4 + 1] AS recommendation,
  'limit-' || (o_custkey % 37) AS limitation, o_orderkey AS ingested_at FROM orders)"""
