"""Catalogue: whole scans, baselines, coverage, and what hangs runs, receipts and findings together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofline.operators import audit, dataset_scan, models, registry, relational
from proofline.plans import assurance, runs
from proofline.plans.derived import commitment_sql
from proofline.session import cut, table
from proofline.streaming import acceptance


def dataset_scan_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("content"), F.col("source").alias("contributor_id"), F.col("lang").alias("batch_id"))
    labels = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.when(F.col("doc_id") % 4001 == 7, F.concat(F.lit("odd-"), "source")).otherwise(F.col("lang")).alias("label"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").alias("vector"))
    found, _ = dataset_scan.analyze(docs, labels, vectors)
    return found.groupBy("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("asset_id").alias("assets"))


def parameter_coverage(spark, sf_dir):
    tensors = table(spark, sf_dir, "part").select((F.col("p_partkey") % 30).alias("model_id"), F.col("p_size").cast("long").alias("elements"), (F.col("p_size") * 4).cast("long").alias("bytes"), (F.col("p_partkey") % 30 == 0) | ((F.col("p_partkey") % 30 != 1) & (F.col("p_size") % 7 != 0)).alias("analysed"))
    return models.parameter_coverage(tensors.toDF("model_id", "elements", "bytes", "analysed")).withColumn("element_ratio", F.round("element_ratio", 9))


def structure_fingerprint(spark, sf_dir):
    nodes = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("model_id"), F.col("event_id").alias("position"), F.col("event_type").alias("op_type"), F.lit("").alias("domain"))
    return models.structure_fingerprint(nodes)


def _records(spark, sf_dir, changed: bool):
    p = table(spark, sf_dir, "part").where("p_partkey % 13 != 4" if changed else "p_partkey % 17 != 5")
    edit = lambda c, m: F.sha2(F.concat(F.col(c).cast("string"), F.when((F.col("p_partkey") % m == 0) & F.lit(changed), "x").otherwise("")), 256)
    return p.select(F.col("p_partkey").cast("string").alias("model_id"), edit("p_name", 5).alias("artifact_sha256"), edit("p_brand", 11).alias("structure_sha256"), F.when(F.col("p_partkey") % 19 != 3, edit("p_type", 7)).alias("value_sha256"), F.lit("COMPLETE").alias("status"))


def baseline_compare(spark, sf_dir):
    return models.compare_baselines(_records(spark, sf_dir, False), _records(spark, sf_dir, True))


def baseline_verify(spark, sf_dir):
    records = models.baseline(_records(spark, sf_dir, False)).withColumn("record_sha256", F.when(F.col("model_id").endswith("7"), F.lit("0" * 64)).otherwise(F.col("record_sha256")))
    return models.baseline_problems(records).select("model_id", F.array_join("errors", ",").alias("errors"))


def assessment_findings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    members = o.select(F.col("o_custkey").alias("assessment_id"), F.col("o_orderkey").alias("run_id"))
    ids = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_set(F.concat(F.lit("F"), F.col("l_linenumber").cast("string"))).alias("finding_ids"))
    done = o.select(F.col("o_orderkey").alias("run_id"), F.lit("m").alias("module"), F.col("o_orderpriority").alias("request_hash")).join(ids, "run_id")
    signed = o.where("o_orderkey % 3 != 1").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 10 == 0, "other").otherwise(F.col("o_orderpriority")).alias("request_hash"), F.when(F.col("o_orderstatus") == "F", "SIGNED").otherwise("TOKEN").alias("mode"))
    return registry.assessment_findings(members, done, signed, "SIGNED").groupBy("assessment_id").agg(F.count("*").alias("n"))


def receipt_links(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_key"), F.col("event_id").alias("receipt_id"), F.col("event_id").alias("sequence"), F.sha2(F.col("event_id").cast("string"), 256).alias("receipt_hash"))
    before = F.lag("receipt_hash").over(Window.partitionBy("stream_key").orderBy("sequence"))
    linked = e.withColumn("previous_receipt_hash", F.when(F.col("receipt_id") % 20 == 0, F.lit("0" * 64)).otherwise(before))
    return acceptance.verify_links(linked).groupBy("stream_key").agg(F.count_if("linked").alias("linked"), F.count_if(~F.col("linked")).alias("broken"))


def attack_findings(spark, sf_dir):
    outcomes = acceptance.accept_batch(runs._receipts(spark, sf_dir))
    return acceptance.attack_findings(outcomes).groupBy("category", "severity", "recommendation").agg(F.count("*").alias("n"), F.countDistinct("finding_id").alias("ids"))


def checkpoint_refusals(spark, sf_dir):
    log = cut(assurance._log(spark, sf_dir), "log")
    pending = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("chain"))
    latest = audit.heads(log).where("chain LIKE '%2' OR chain LIKE '%5'").select("chain", "record_hash")
    return audit.checkpoint_refusals(log, pending, latest).select("chain", "audit_sequence", F.coalesce("reason", F.lit("-")).alias("reason"))


def outbox_drainable(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    payload = F.when(F.col("o_orderkey") % 50 == 7, F.lit("{")).otherwise(F.concat(F.lit('{"s":"'), "o_orderstatus", F.lit('"}')))
    rows = o.select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("event_key"), payload.alias("payload_json"), F.sha2(F.when(F.col("o_orderkey") % 40 == 3, "x").otherwise(payload), 256).alias("payload_hash"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("DELIVERED").alias("status"), F.col("o_orderkey").alias("created_at"))
    return audit.drainable(rows).select("event_key", F.coalesce("problem", F.lit("-")).alias("problem"))


def sequence_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("sequence"))
    return relational.lookup(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer")), relational.next_sequence(o, "sequence", ("customer",)), "customer").select("customer", F.coalesce("next", F.lit(1)).alias("next"))


_REC = "SELECT p_partkey AS k, p_partkey::VARCHAR AS model_id, sha256(p_name || {e5}) AS a, sha256(p_brand || {e11}) AS s, CASE WHEN p_partkey % 19 <> 3 THEN sha256(p_type || {e7}) END AS v FROM part WHERE {w}"
_B = _REC.format(e5="''", e11="''", e7="''", w="p_partkey % 17 <> 5")
_A = _REC.format(**{f"e{m}": f"CASE WHEN p_partkey % {m} = 0 THEN 'x' ELSE '' END" for m in (5, 7, 11)}, w="p_partkey % 13 <> 4")
_CMP = "CASE WHEN b.k IS NULL OR a.k IS NULL THEN 'INCOMPARABLE' WHEN b.{c} IS NULL OR a.{c} IS NULL THEN 'UNAVAILABLE' WHEN b.{c} = a.{c} THEN 'SAME' ELSE 'CHANGED' END"
_EV = "ev AS (SELECT 'u' || (user_id % 50) AS chain, count(*) AS n FROM events GROUP BY 1)"

QUERIES = {
    "dataset_scan": (dataset_scan_findings, None),
    "parameter_coverage": (
        parameter_coverage,
        "WITH t AS (SELECT p_partkey % 30 AS model_id, p_size::BIGINT AS e, p_size::BIGINT * 4 AS b, p_partkey % 30 = 0 OR (p_partkey % 30 <> 1 AND p_size % 7 <> 0) AS a FROM part), g AS (SELECT model_id, count(*) AS tensors, count(*) FILTER (a) AS tensors_analysed, sum(e)::BIGINT AS elements, coalesce(sum(e) FILTER (a), 0)::BIGINT AS elements_analysed, sum(b)::BIGINT AS bytes, coalesce(sum(b) FILTER (a), 0)::BIGINT AS bytes_analysed FROM t GROUP BY model_id) SELECT *, round(elements_analysed / elements, 9) AS element_ratio, CASE WHEN tensors_analysed = 0 THEN 'UNAVAILABLE' WHEN tensors_analysed < tensors THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM g",
    ),
    "structure_fingerprint": (
        structure_fingerprint,
        f"""WITH n AS (SELECT user_id % 20 AS model_id, event_id || '|' || event_type || '|' AS row FROM events), {commitment_sql("n", "model_id", "row")}
        SELECT model_id, samples AS nodes, commitment AS structure_sha256 FROM hash_tree""",
    ),
    "baseline_compare": (
        baseline_compare,
        f"WITH b AS ({_B}), a AS ({_A}), c AS (SELECT coalesce(b.model_id, a.model_id) AS model_id, {_CMP.format(c='a')} AS artifact, {_CMP.format(c='s')} AS structure, {_CMP.format(c='v')} AS parameters FROM b FULL JOIN a ON a.k = b.k) SELECT *, CASE WHEN structure = 'INCOMPARABLE' THEN 'NOT_COMPARED' WHEN structure = 'CHANGED' THEN 'STRUCTURE_CHANGED' WHEN parameters = 'CHANGED' THEN 'PARAMETERS_CHANGED' WHEN parameters = 'UNAVAILABLE' THEN 'EVIDENCE_INCOMPLETE' WHEN artifact = 'CHANGED' THEN 'REPACKAGED' ELSE 'UNCHANGED' END AS interpretation FROM c",
    ),
    "baseline_verify": (baseline_verify, f"WITH b AS ({_B}) SELECT model_id, concat_ws(',', CASE WHEN v IS NULL THEN 'VALUE_SHA256_MALFORMED' END, CASE WHEN model_id LIKE '%7' THEN 'RECORD_DIGEST_MISMATCH' END) AS errors FROM b"),
    "assessment_findings": (
        assessment_findings,
        "SELECT o_custkey AS assessment_id, count(DISTINCT l_linenumber) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 1 AND o_orderkey % 10 <> 0 AND o_orderstatus = 'F' GROUP BY o_custkey",
    ),
    "receipt_links": (receipt_links, "WITH r AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id::VARCHAR AS stream_key, count(*) FILTER (event_id % 20 <> 0) AS linked, count(*) FILTER (event_id % 20 = 0) AS broken FROM r GROUP BY user_id"),
    "attack_findings": (
        attack_findings,
        f"WITH {runs.FOLD}, c AS (SELECT receipt_id, 'REPLAY_DETECTED' AS category FROM w WHERE reasons LIKE '%REPLAY%' OR reasons LIKE '%NONCE%' UNION ALL SELECT receipt_id, 'OUTPUT_TAMPERING' FROM w WHERE reasons LIKE '%CHECKS%') SELECT category, 'CRITICAL' AS severity, 'REJECT' AS recommendation, count(*) AS n, count(*) AS ids FROM c GROUP BY category",
    ),
    "checkpoint_refusals": (checkpoint_refusals, f"WITH {_EV} SELECT chain, n AS audit_sequence, CASE WHEN chain IN (SELECT 'u' || n_nationkey FROM nation WHERE n_regionkey = 2) THEN 'INTENTS_PENDING' WHEN chain LIKE '%2' OR chain LIKE '%5' THEN 'HEAD_UNCHANGED' ELSE '-' END AS reason FROM ev"),
    "outbox_drainable": (outbox_drainable, "SELECT 'e' || o_orderkey AS event_key, CASE WHEN o_orderkey % 40 = 3 THEN 'PAYLOAD_HASH_MISMATCH' WHEN o_orderkey % 50 = 7 THEN 'PAYLOAD_MALFORMED' ELSE '-' END AS problem FROM orders WHERE o_orderstatus = 'O'"),
    "sequence_lookup": (sequence_lookup, "SELECT c_custkey AS customer, coalesce(max(o_orderkey), 0) + 1 AS next FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
}
