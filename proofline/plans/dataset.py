"""Catalogue: dataset integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import detect
from proofline.plans import derived
from proofline.session import table


def _exact(spark, sf_dir) -> DataFrame:
    return detect.duplicate_groups(derived.samples(spark, sf_dir), "sample_id", "text")


def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir).select("content_hash", F.col("n").alias("duplicate_count"), "asset_id", F.array_join("paths", ",").alias("paths"))


def exact_duplicate_findings(spark, sf_dir):
    return detect.duplicate_findings(_exact(spark, sf_dir)).select("finding_id", "asset_id", "category", "severity", "confidence", F.array_join("evidence", ";").alias("evidence"))


def near_duplicate_pairs(spark, sf_dir):
    pairs = detect.near_pairs(derived.signatures(spark, sf_dir), "k", "s", 10)
    return detect.near_findings(pairs).select(F.col("asset_id").alias("a"), F.element_at("evidence", 1).alias("distance"), F.element_at("evidence", 2).alias("b"), "severity", "confidence")


def near_duplicate_classes(spark, sf_dir):
    """A third of the vectors share one signature: class pairs, and each row's class."""
    base = derived.signatures(spark, sf_dir)
    shared = base.withColumn("s", F.when(F.col("k") % 3 == 0, F.lit(12345).cast("long")).otherwise(F.col("s")))
    classes = detect.near_classes(shared, "k", "s")
    links = detect.near_class_pairs(classes, 10).select("a", "b", F.col("distance").cast("int").alias("distance"))
    return links.union(classes.select("representative", "key", F.lit(-1)))


def near_minus_exact(spark, sf_dir):
    pairs = detect.near_pairs(derived.signatures(spark, sf_dir), "k", "s", 10)
    # every copy whose vector id is even counts as equal content
    base = derived.signatures(spark, sf_dir).select(F.col("k").alias("key"), F.expr("CASE WHEN shiftright(k, 1) % 2 = 0 THEN cast(shiftright(k, 1) as string) END").alias("content_hash"))
    return detect.minus_exact(pairs, base).select("a", "b", "distance")


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def rare_labels(spark, sf_dir):
    return detect.rare_labels(_labels(spark, sf_dir), "event_id", "k", 100).select("asset_id", "severity", "confidence", F.array_join("evidence", ";").alias("evidence"))


def _scores(spark, sf_dir, segment=()):
    return detect.outlier_scores(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", segment)


def outlier_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("vec_id", "score")


def outlier_threshold(spark, sf_dir):
    found = detect.outlier_threshold(_scores(spark, sf_dir, ("label",)), segment=("label",))
    return found.select("label", "n", "method", F.round("median", 5).alias("median"), F.round("mad", 5).alias("mad"), F.round("threshold", 5).alias("threshold"))


def outliers(spark, sf_dir):
    scores = _scores(spark, sf_dir, ("label",))
    found = detect.outliers(scores, detect.outlier_threshold(scores, segment=("label",)), ("label",))
    return found.select("label", "vec_id", "severity")


def _findings(spark, sf_dir):
    found = detect.duplicate_findings(_exact(spark, sf_dir))
    return detect.bind_source(found, derived.samples(spark, sf_dir).select("sample_id", "contributor_id", "batch_id").dropDuplicates(["sample_id"]))


def bound_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("finding_id", "asset_id", F.array_join("evidence", ";").alias("evidence"))


def contributor_risk(spark, sf_dir):
    return detect.contributor_risk(detect.duplicate_findings(_exact(spark, sf_dir)), derived.samples(spark, sf_dir))


def dataset_risk(spark, sf_dir):
    found = derived.assurance_findings(spark, sf_dir).where("severity != 'INFO'").withColumn("evidence", F.array("limitation"))
    return detect.dataset_risk(found, ("asset_type", "recommendation"))


def finding_rollup(spark, sf_dir):
    found = derived.assurance_findings(spark, sf_dir)
    return detect.rollup(found).select(F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("severity", F.lit("*")).alias("severity"), "n", "n_distinct")


_SCORES = """
m AS (SELECT {seg} i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL),
c AS (SELECT {seg} list(m ORDER BY i) AS c FROM m GROUP BY ALL),
s AS (SELECT {e}vec_id, round(1 - list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c))), 6) AS score FROM embeddings {join})"""
_ONE = _SCORES.format(seg="", e="", join="CROSS JOIN c")
_BY = _SCORES.format(seg="label,", e="label, ", join="JOIN c USING (label)")
_THRESHOLD = (
    _BY
    + """,
a AS (SELECT label, count(*) AS n, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.95) AS upper FROM s GROUP BY label),
b AS (SELECT label, quantile_cont(abs(score - median), 0.5) AS mad FROM s JOIN a USING (label) GROUP BY label),
t AS (SELECT label, n, CASE WHEN n < 5 THEN 'insufficient' WHEN mad = 0 THEN 'percentile' ELSE 'mad' END AS method, median, mad,
             CASE WHEN n >= 5 THEN round(CASE WHEN mad = 0 THEN upper ELSE greatest(median + 3.5 * 1.4826 * mad, upper) END, 6) END AS threshold FROM a JOIN b USING (label))"""
)

QUERIES = {
    "exact_duplicate_groups": (exact_duplicate_groups, f"WITH {derived.EXACT} SELECT content_hash, n AS duplicate_count, asset_id, array_to_string(paths, ',') AS paths FROM groups"),
    "exact_duplicate_findings": (exact_duplicate_findings, f"WITH {derived.EXACT} SELECT finding_id, asset_id, 'EXACT_DUPLICATE' AS category, 'HIGH' AS severity, 1.0::DOUBLE AS confidence, e1 || ';' || e2 || ';' || e3 AS evidence FROM exact"),
    "near_duplicate_pairs": (
        near_duplicate_pairs,
        f"WITH {derived.SIGNATURES} SELECT a::VARCHAR AS a, 'matched_sample=' || b AS b, 'phash_distance=' || distance AS distance, round(1 - distance / 64, 2) AS confidence, CASE WHEN round(1 - distance / 64, 2) >= 0.85 THEN 'HIGH' WHEN round(1 - distance / 64, 2) >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM pairs",
    ),
    "near_duplicate_classes": (
        near_duplicate_classes,
        f"WITH {derived.SIGNATURES}, t AS (SELECT k, CASE WHEN k % 3 = 0 THEN lpad(bin(12345), 64, '0') ELSE s END AS s FROM sig), c AS (SELECT k, s, min(k) OVER (PARTITION BY s) AS r FROM t) SELECT a.k AS a, b.k AS b, hamming(a.s, b.s)::INTEGER AS distance FROM c a JOIN c b ON a.k < b.k AND a.k = a.r AND b.k = b.r WHERE hamming(a.s, b.s) <= 10 UNION ALL SELECT r, k, -1 FROM c",
    ),
    "near_minus_exact": (near_minus_exact, f"WITH {derived.SIGNATURES} SELECT a, b, distance::INTEGER AS distance FROM pairs WHERE NOT (a // 2 = b // 2 AND (a // 2) % 2 = 0)"),
    "rare_labels": (rare_labels, "WITH l AS (SELECT json_extract_string(props, '$.k') AS label, count(DISTINCT event_id) AS n FROM events GROUP BY 1) SELECT 'label:' || label AS asset_id, 'MEDIUM' AS severity, 0.75::DOUBLE AS confidence, 'label=' || label || ';label_count=' || n AS evidence FROM l WHERE label IS NOT NULL AND n < 100"),
    "outlier_scores": (outlier_scores, f"WITH {_ONE} SELECT vec_id, score FROM s"),
    "outlier_threshold": (outlier_threshold, f"WITH {_THRESHOLD} SELECT label, n, method, round(median, 5) AS median, round(mad, 5) AS mad, round(threshold, 5) AS threshold FROM t"),
    "outliers": (
        outliers,
        f"WITH {_THRESHOLD} SELECT label, vec_id, CASE WHEN c >= 0.85 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (SELECT s.label, vec_id, round(least(1.0, (score - threshold) / greatest(0.05, 1 - threshold) * least(1.0, n / 20)), 2) AS c FROM s JOIN t ON s.label = t.label WHERE score >= threshold)",
    ),
    "bound_findings": (
        bound_findings,
        f"WITH {derived.EXACT}, o AS (SELECT DISTINCT ON (sample_id) sample_id, contributor_id, batch_id FROM samples) SELECT 'F-DATASET-' || substr(sha256('{{\"asset_id\":\"' || asset_id || '\",\"category\":\"EXACT_DUPLICATE\",\"module\":\"dataset_integrity\",\"stable_evidence_key\":[\"' || array_to_string(list_sort([e1, e2, e3, 'contributor_id=' || contributor_id, 'batch_id=' || batch_id]), '\",\"') || '\"]}}'), 1, 24) AS finding_id, asset_id, array_to_string([e1, e2, e3, 'contributor_id=' || contributor_id, 'batch_id=' || batch_id], ';') AS evidence FROM exact JOIN o ON asset_id = sample_id",
    ),
    "contributor_risk": (contributor_risk, f"WITH {derived.EXACT} SELECT contributor_id, count(*) AS finding_count, 1.0::DOUBLE AS average_confidence, array_to_string(list_sort(list(DISTINCT batch_id)), ',') AS batches FROM exact JOIN samples ON asset_id = sample_id WHERE contributor_id IS NOT NULL GROUP BY contributor_id"),
    "dataset_risk": (
        dataset_risk,
        f"WITH {derived.FINDINGS}, e AS (SELECT asset_type, recommendation, max(CASE severity WHEN 'LOW' THEN 10 WHEN 'MEDIUM' THEN 30 WHEN 'HIGH' THEN 60 ELSE 100 END * confidence::DOUBLE) AS w, count(*) AS k FROM f WHERE severity <> 'INFO' GROUP BY asset_type, recommendation, category, asset_id, limitation), r AS (SELECT asset_type, recommendation, round(least(100.0, sum(w)), 2) AS risk_score, sum(k)::BIGINT AS finding_count, count(*) AS event_count FROM e GROUP BY ALL) SELECT *, CASE WHEN risk_score = 0 THEN 'NONE' WHEN risk_score < 20 THEN 'LOW' WHEN risk_score < 50 THEN 'MEDIUM' WHEN risk_score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_band FROM r",
    ),
    "finding_rollup": (finding_rollup, f"WITH {derived.FINDINGS} SELECT coalesce(category, '*') AS category, coalesce(severity, '*') AS severity, count(*) AS n, count(DISTINCT finding_id) AS n_distinct FROM f GROUP BY GROUPING SETS ((category), (severity), ())"),
}
