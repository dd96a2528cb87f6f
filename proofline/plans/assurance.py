"""Catalogue: scoring, listings, audit chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import audit, relational, scoring
from proofline.plans.derived import FINDINGS, assurance_findings
from proofline.session import cut, table


def module_scores(spark, sf_dir):
    # each asset is its own scope's module view: one row per module
    return scoring.module_scores(_some(spark, sf_dir)).select("module", F.round("score", 1).cast("double").alias("score"), "status", "disposition", "n_findings", "n_critical")


def _some(spark, sf_dir):
    """Findings with small confidences, so that scores don't all end at zero; distribution shift has none."""
    found = assurance_findings(spark, sf_dir).where("module != 'distribution_shift'")
    return found.withColumn("confidence", (F.col("confidence") * F.when(F.col("module") == "dataset_integrity", F.lit(0.05)).otherwise(F.lit(0.3)).cast("decimal(4,2)")).cast("decimal(10,6)"))


def overall_score(spark, sf_dir):
    return scoring.overall(_some(spark, sf_dir)).withColumn("score", F.col("score").cast("double")).withColumn("coverage", F.col("coverage").cast("double"))


def category_penalties(spark, sf_dir):
    return scoring.category_penalties(_some(spark, sf_dir)).select("module", "category", F.col("penalty").cast("double").alias("penalty"), "finding_id")


def critical_overrides(spark, sf_dir):
    return scoring.overrides_in(assurance_findings(spark, sf_dir))


def severity_counts(spark, sf_dir):
    return scoring.severity_counts(assurance_findings(spark, sf_dir))


def top_findings(spark, sf_dir):
    return scoring.top_findings(assurance_findings(spark, sf_dir)).select("module", "rank", "finding_id", "severity")


def latest_findings(spark, sf_dir):
    return scoring.latest_findings(assurance_findings(spark, sf_dir)).select("finding_id", "ingested_at")


def limitations(spark, sf_dir):
    return scoring.first_limitations(assurance_findings(spark, sf_dir).withColumn("limitations", F.array("limitation", F.lit("common"))))


def trust_scope(spark, sf_dir):
    trusted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.format_string("F-%09d", "o_orderkey").alias("finding_id"))
    return scoring.trust_scope(assurance_findings(spark, sf_dir), trusted)


def findings_page(spark, sf_dir):
    page = relational.paginate(assurance_findings(spark, sf_dir), {"module": "model_integrity", "severity": "HIGH"}, ("ingested_at", "finding_id"), 40, 25)
    return page.select("finding_id", "ingested_at", "total")


def findings_search(spark, sf_dir):
    found = relational.search(assurance_findings(spark, sf_dir), "Tamper", ("finding_id", "category", "asset_id"), {"recommendation": "REVIEW"})
    return found.select("finding_id", "category", "asset_id")


def _log(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("chain"), "event_id", "event_type", F.lit("user").alias("asset_type"), F.col("user_id").cast("string").alias("asset_id"), F.regexp_replace("props", " ", "").alias("payload_json"), "ts")
    return audit.build(events, "chain", ("ts", "event_id"))


def audit_build(spark, sf_dir):
    return _log(spark, sf_dir).select("chain", "audit_id", "sequence", "previous_hash", "current_hash")


def _tampered(spark, sf_dir):
    """The log with a payload edited in chains ending in 3, a record lost in those ending in 4, and junk in those ending in 5."""
    log = cut(_log(spark, sf_dir), "log")
    at = F.col("sequence") == 7
    ends = lambda d: F.col("chain").endswith(d) & at
    return log.where(~ends("4")).withColumn("payload_json", F.when(ends("3"), F.lit('{"k":-1}')).when(ends("5"), F.lit("{")).otherwise(F.col("payload_json")))


def audit_verify(spark, sf_dir):
    return audit.verify(_tampered(spark, sf_dir))


def checkpoint_verify(spark, sf_dir):
    log = cut(_log(spark, sf_dir), "log")
    points = audit.checkpoints(log, 20)
    bad = F.when(F.col("chain").endswith("2") & (F.col("audit_sequence") == 40), F.lit("0" * 64)).otherwise(F.col("checkpoint_hash"))
    return audit.verify_checkpoints(points.withColumn("checkpoint_hash", bad), log.where("NOT (chain LIKE '%1' AND sequence > 90)"))


def outbox_staging(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    intents = orders.select(F.col("o_orderkey").alias("intent_id"), F.concat(F.lit("evt-"), (F.col("o_custkey")).cast("string")).alias("event_key"), F.concat(F.lit('{"s":"'), "o_orderstatus", F.lit('"}')).alias("payload_json"))
    stored = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("evt-"), F.col("c_custkey").cast("string")).alias("event_key"), F.sha2(F.lit('{"s":"F"}'), 256).alias("payload_hash"))
    return audit.stage(intents, stored)


def outbox_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("DELIVERED").alias("status"), F.col("o_orderkey").alias("created_at"))
    return audit.outbox_status(rows, ("o_orderpriority",))


_SOME = FINDINGS + ", s AS (SELECT * EXCLUDE confidence, (confidence * CASE module WHEN 'dataset_integrity' THEN 0.05 ELSE 0.3 END::DECIMAL(4, 2))::DECIMAL(10, 6) AS confidence FROM f WHERE module <> 'distribution_shift')"
_POINTS = "CASE severity WHEN 'INFO' THEN 2 WHEN 'LOW' THEN 8 WHEN 'MEDIUM' THEN 20 WHEN 'HIGH' THEN 45 ELSE 75 END"
_CAT = _SOME + f", c AS (SELECT module, category, max({_POINTS}::DECIMAL(10, 4) * confidence) AS penalty, arg_min(finding_id, (-({_POINTS}::DECIMAL(10, 4) * confidence), finding_id)) AS finding_id FROM s GROUP BY ALL)"
_RANK = "CASE recommendation WHEN 'ACCEPT' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'QUARANTINE' THEN 2 ELSE 1 END"
_HIT = "CASE WHEN severity = 'CRITICAL' AND category IN ('OUTPUT_TAMPERING', 'REPLAY_DETECTED', 'MODEL_SUBSTITUTION', 'BACKDOOR_BEHAVIOR') THEN 2 ELSE 0 END"
_MODULES = (
    _CAT
    + f""", l AS (SELECT module, 100 - least(100, sum(penalty)) AS score FROM c GROUP BY module),
e AS (SELECT module, max(greatest({_RANK}, {_HIT})) AS effect, count(*) AS n_findings, count(*) FILTER (severity = 'CRITICAL') AS n_critical FROM s GROUP BY module),
m AS (SELECT d.module, d.i, d.w, score, CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score >= 90 THEN 'GOOD' WHEN score >= 70 THEN 'WATCH' WHEN score >= 40 THEN 'REVIEW' ELSE 'HIGH_RISK' END AS status, coalesce(effect, 0) AS effect, coalesce(n_findings, 0) AS n_findings, coalesce(n_critical, 0) AS n_critical
  FROM (VALUES ('dataset_integrity', 0, 0.25), ('model_integrity', 1, 0.35), ('inference_integrity', 2, 0.25), ('distribution_shift', 3, 0.15)) d(module, i, w) LEFT JOIN l USING (module) LEFT JOIN e USING (module)),
n AS (SELECT *, CASE WHEN score IS NULL THEN 1 ELSE greatest(effect, CASE status WHEN 'GOOD' THEN 0 WHEN 'HIGH_RISK' THEN 2 ELSE 1 END) END AS r FROM m)"""
)
_NAME = "['ACCEPT', 'REVIEW', 'QUARANTINE', 'REJECT']"
_CHAIN = """
ev AS (SELECT 'u' || (user_id % 50) AS chain, event_id, event_type, user_id::VARCHAR AS asset_id, replace(props, ' ', '') AS payload, ts, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events),
body AS (SELECT *, '{"asset_id":"' || asset_id || '","asset_type":"user","audit_id":"' || printf('AUD-%08d', n) || '","event_type":"' || event_type || '","payload_json":"' || replace(payload, '"', '\\"') || '","previous_hash":"' AS a,
  '","sequence":' || n || ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}' AS z FROM ev),
log AS (SELECT chain, n, repeat('0', 64) AS previous_hash, sha256(a || repeat('0', 64) || z) AS current_hash FROM body WHERE n = 1
  UNION ALL SELECT b.chain, b.n, l.current_hash, sha256(b.a || l.current_hash || b.z) FROM log l JOIN body b ON b.chain = l.chain AND b.n = l.n + 1)"""

QUERIES = {
    "module_scores": (module_scores, f"WITH {_MODULES} SELECT module, round(score, 1)::DOUBLE AS score, status, {_NAME}[r + 1] AS disposition, n_findings, n_critical FROM n"),
    "overall_score": (
        overall_score,
        f"WITH {_MODULES}, o AS (SELECT sum(score::DOUBLE * w) / sum(w) FILTER (score IS NOT NULL) AS score, sum(w) FILTER (score IS NOT NULL)::DOUBLE AS coverage, max(r) FILTER (score IS NOT NULL) AS r, arg_min(module, (score, i)) FILTER (score IS NOT NULL) AS most_concerning FROM n), x AS (SELECT max(greatest({_HIT}, CASE WHEN recommendation IN ('QUARANTINE', 'REJECT') AND asset_type IN ('model', 'pipeline', 'dataset') THEN 2 WHEN recommendation <> 'ACCEPT' THEN 1 ELSE 0 END)) AS e, max({_HIT}) AS h FROM s) "
        f"SELECT round(score, 1) AS score, coverage, CASE WHEN coverage < 1 THEN 'PROVISIONAL' ELSE 'COMPLETE' END AS assessment, CASE WHEN score >= 90 THEN 'GOOD' WHEN score >= 70 THEN 'WATCH' WHEN score >= 40 THEN 'REVIEW' ELSE 'HIGH_RISK' END AS status, {_NAME}[greatest(r, e, CASE WHEN score >= 90 THEN 0 WHEN score < 40 THEN 2 ELSE 1 END, (coverage < 1)::INT) + 1] AS disposition, most_concerning, CASE WHEN h > 0 THEN 'CRITICAL_OVERRIDE' WHEN coverage < 1 THEN 'INCOMPLETE_COVERAGE' ELSE 'COMPLETE' END AS reason FROM o, x",
    ),
    "category_penalties": (category_penalties, f"WITH {_CAT} SELECT module, category, penalty::DOUBLE AS penalty, finding_id FROM c"),
    "critical_overrides": (critical_overrides, f"WITH {FINDINGS} SELECT category, count(*) AS n, CASE WHEN category IN ('OUTPUT_TAMPERING', 'REPLAY_DETECTED') THEN 'REJECT' ELSE 'QUARANTINE' END AS asset, 'QUARANTINE' AS module, 'QUARANTINE' AS system FROM f WHERE severity = 'CRITICAL' AND category IN ('OUTPUT_TAMPERING', 'REPLAY_DETECTED', 'MODEL_SUBSTITUTION', 'BACKDOOR_BEHAVIOR') GROUP BY category"),
    "severity_counts": (severity_counts, f"WITH {FINDINGS} SELECT module, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")) + " FROM f GROUP BY module"),
    "top_findings": (top_findings, f"WITH {FINDINGS} SELECT module, rank, finding_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY {_POINTS} DESC, confidence DESC, finding_id) AS rank FROM f) WHERE rank <= 5"),
    "latest_findings": (latest_findings, f"WITH {FINDINGS} SELECT finding_id, ingested_at FROM f ORDER BY ingested_at DESC, finding_id DESC LIMIT 10"),
    "limitations": (limitations, f"WITH {FINDINGS}, e AS (SELECT limitation, ingested_at, finding_id, 0 AS pos FROM f UNION ALL SELECT 'common', ingested_at, finding_id, 1 FROM f), g AS (SELECT limitation, min((ingested_at, finding_id, pos)) AS a FROM e GROUP BY limitation) SELECT limitation, a[1]::BIGINT AS first_at FROM g ORDER BY a LIMIT 20"),
    "trust_scope": (trust_scope, f"WITH {FINDINGS} SELECT module, count(*) FILTER (o_orderstatus = 'F') AS trusted, count(*) FILTER (o_orderstatus <> 'F') AS excluded FROM f JOIN orders ON ingested_at = o_orderkey GROUP BY module"),
    "findings_page": (findings_page, f"WITH {FINDINGS}, p AS (SELECT * FROM f WHERE module = 'model_integrity' AND severity = 'HIGH') SELECT finding_id, ingested_at, (SELECT count(*) FROM p) AS total FROM p ORDER BY ingested_at, finding_id LIMIT 25 OFFSET 40"),
    "findings_search": (findings_search, f"WITH {FINDINGS} SELECT finding_id, category, asset_id FROM f WHERE recommendation = 'REVIEW' AND contains(lower(concat_ws(' ', finding_id, category, asset_id)), 'tamper')"),
    "audit_build": (audit_build, f"WITH RECURSIVE {_CHAIN} SELECT chain, printf('AUD-%08d', n) AS audit_id, n AS sequence, previous_hash, current_hash FROM log"),
    "audit_verify": (
        audit_verify,
        f"WITH {_CHAIN.split('body AS')[0].rstrip().rstrip(',')}, c AS (SELECT chain, count(*) AS k FROM ev GROUP BY chain) SELECT chain, (k - (chain LIKE '%4' AND k >= 7)::INT)::BIGINT AS records, CASE WHEN chain[-1] IN ('3', '4', '5') AND (k > 7 OR (k = 7 AND chain[-1] <> '4')) THEN 'COMPROMISED' ELSE 'VALID' END AS status, CASE WHEN chain[-1] IN ('3', '5') AND k >= 7 THEN 'AUD-00000007' WHEN chain LIKE '%4' AND k > 7 THEN 'AUD-00000008' END AS first_broken, CASE WHEN chain LIKE '%3' AND k >= 7 THEN 'AUDIT_RECORD_TAMPERING' WHEN chain LIKE '%5' AND k >= 7 THEN 'AUDIT_RECORD_MALFORMED' WHEN chain LIKE '%4' AND k > 7 THEN 'AUDIT_CHAIN_LINK_FAILURE' END AS code FROM c",
    ),
    "checkpoint_verify": (checkpoint_verify, "WITH " + _CHAIN.split("body AS")[0].rstrip().rstrip(",") + " SELECT chain, n AS audit_sequence, CASE WHEN chain LIKE '%2' AND n = 40 THEN 'CHECKPOINT_TAMPERED' WHEN chain LIKE '%1' AND n > 90 THEN 'HISTORY_SHORTER' ELSE 'VALID' END AS status FROM ev WHERE n % 20 = 0"),
    "outbox_staging": (
        outbox_staging,
        "WITH i AS (SELECT o_orderkey AS intent_id, 'evt-' || o_custkey AS event_key, o_custkey, sha256('{\"s\":\"' || o_orderstatus || '\"}') AS payload_hash FROM orders), s AS (SELECT 'evt-' || c_custkey AS event_key, sha256('{\"s\":\"F\"}') AS stored FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT event_key, arg_min(payload_hash, intent_id) AS first_hash, min(intent_id) AS first_id FROM i GROUP BY event_key) SELECT intent_id, event_key, payload_hash, CASE WHEN payload_hash <> coalesce(stored, first_hash) THEN 'CONFLICT' WHEN stored IS NOT NULL OR intent_id <> first_id THEN 'EXISTS' ELSE 'CREATED' END AS status FROM i JOIN b USING (event_key) LEFT JOIN s USING (event_key)",
    ),
    "outbox_status": (outbox_status, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus <> 'O') AS delivered, min(o_orderkey) FILTER (o_orderstatus = 'O') AS oldest_pending FROM orders GROUP BY o_orderpriority"),
}
