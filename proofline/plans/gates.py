"""Catalogue: gates, contracts, perturbations, fingerprints, counts, seals and drains."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import audit, compare, models, registry, scoring
from proofline.plans import runs
from proofline.plans.derived import FINDINGS, assurance_findings, commitment_sql
from proofline.session import cut, table


def window_gates(spark, sf_dir):
    """Two windows of each customer; by rule one is absent, of another space, schema or role, or unavailable."""
    k, i = F.col("key"), F.col("i")
    current = i == 1
    sides = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    rows = sides.where(~(current & (k % 17 == 3))).select(
        "key",
        F.when(current & (k % 23 == 5), "OTHER").when(current, "CURRENT").otherwise("REFERENCE").alias("role"),
        F.when(~current & (k % 19 == 4), 2).otherwise(1).alias("schema_version"),
        F.when((k + i) % 7 == 0, "UNAVAILABLE").when((k + i) % 5 == 0, "PARTIAL").otherwise("COMPLETE").alias("status"),
        ((k * 3 + i) % 40 + 5).alias("samples"),
        F.when(current & (k % 11 == 2), 32).otherwise(64).alias("dimension"),
        F.when(current & (k % 13 == 6), "b").otherwise("a").alias("space_id"),
    )
    return compare.comparability(rows, ("key",), compare.VECTOR_SPACE, partial_code=compare.VECTOR_PARTIAL)


def output_contract_typed(spark, sf_dir):
    """Vectors as named, typed outputs; two in ten have another name or type, and one model's are too large."""
    k, wide = F.col("vec_id") % 10, F.col("label") % 3 == 2
    model = F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model_id")
    dtype = F.when((k == 3) != wide, "float64").otherwise("float32")
    outputs = table(spark, sf_dir, "embeddings").select(model, "vec_id", F.when(k == 2, "other").otherwise("logits").alias("name"), dtype.alias("dtype"), F.col("embedding").alias("output"))
    kinds = table(spark, sf_dir, "embeddings").select(model).distinct()
    contracts = kinds.select("model_id", F.lit(64).alias("expected_size"), F.lit("logits").alias("expected_name"), F.when(F.col("model_id") == "m2", "float64").otherwise("float32").alias("expected_dtype"))
    return models.output_contract(outputs, contracts, most_bytes=300).select("vec_id", F.coalesce("code", F.lit("-")).alias("code"))


def perturbation_grid(spark, sf_dir):
    """Vectors as images of two channels, 2 by 16; a weighted sum of each image with each patch, in both layouts."""
    samples = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))
    triggers = spark.createDataFrame(models.default_triggers(2, 16, -1.0, 1.0), models.TRIGGER)
    both = [models.perturbed(samples, triggers, 2, 16, 2, layout).withColumn("layout", F.lit(layout)) for layout in ("NCHW", "NHWC")]
    weighted = F.aggregate(F.transform("pixels", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return both[0].unionByName(both[1]).select("layout", "trigger_id", "vec_id", F.round(weighted, 6).alias("checksum"))


def parameter_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("model_id"), F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("dtype"), F.col("p_size").alias("shape"))
    return models.parameter_fingerprint(rows)


def recommendation_counts(spark, sf_dir):
    return scoring.recommendation_counts(assurance_findings(spark, sf_dir))


def category_counts(spark, sf_dir):
    return scoring.category_counts(assurance_findings(spark, sf_dir))


def _outbox(spark, sf_dir):
    """Orders as intents, a chain for each customer: some payloads are tampered with, some name another event."""
    k = F.col("o_orderkey")
    event = F.concat(F.lit("STATUS_"), "o_orderstatus")
    named = F.when(k % 45 == 2, "x").otherwise(event)
    body = F.concat(F.lit('{"asset_id":"'), k.cast("string"), F.lit('","asset_type":"order","event_type":"'), named, F.lit('","payload":{"s":"'), "o_orderstatus", F.lit('"}}'))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("chain"),
        F.concat(F.lit("e"), k.cast("string")).alias("event_key"),
        k.alias("created_at"),
        event.alias("event_type"),
        F.lit("order").alias("asset_type"),
        k.cast("string").alias("asset_id"),
        body.alias("payload_json"),
        F.sha2(F.when(k % 40 == 3, "x").otherwise(body), 256).alias("payload_hash"),
        F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("DELIVERED").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


def _logged(spark, sf_dir):
    return audit.build(_outbox(spark, sf_dir).where("event_type = 'STATUS_F'"), "chain", ("created_at",))


def _drained(spark, sf_dir, log):
    outbox = _outbox(spark, sf_dir)
    return audit.drain(outbox, log, outbox.where("created_at % 30 = 7").select("event_key"))


def outbox_drain(spark, sf_dir):
    """Deliveries after the records of the finished orders; some intents have been delivered before."""
    return _drained(spark, sf_dir, _logged(spark, sf_dir)).select("chain", "event_key", "sequence", "audit_id", "payload_json")


def drained_chains(spark, sf_dir):
    """The chains with what was delivered appended to them, verified as a whole."""
    # both are read more than once, so they are built once and written down
    log = cut(_logged(spark, sf_dir), "logged")
    appended = cut(_drained(spark, sf_dir, log).drop("event_key"), "drained")
    return audit.verify(log.unionByName(appended)).select("chain", "records", "status")


def active_overlaps(spark, sf_dir):
    """Assessments of customers, in scopes; their orders move them on."""
    state = F.element_at(F.array(*map(F.lit, ("DRAFT", "ACTIVE", "SEALED"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    log = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("scope"), F.col("o_custkey").alias("assessment_id"), F.col("o_orderkey").alias("at"), state.alias("state"))
    return registry.active_overlaps(log, "scope")


def run_results(spark, sf_dir):
    """Some customers' runs are stored, under the same request or another."""
    k = F.col("run_id")
    requests = runs._submitted(spark, sf_dir).select("run_id").distinct().withColumn("request_hash", F.sha2(k.cast("string"), 256))
    stored = requests.where((k % 4 == 1) | (k % 12 == 6)).withColumn("request_hash", F.when(k % 4 == 1, F.col("request_hash")).otherwise("other"))
    return registry.run_results(requests, stored, runs._submitted(spark, sf_dir), runs._stored(spark, sf_dir))


def seal_summaries(spark, sf_dir):
    """Seals over runs and findings of customers; some findings are edited after."""
    found = assurance_findings(spark, sf_dir).withColumn("assessment_id", F.expr("cast(substring(asset_id, 7) AS bigint)"))
    members = runs._members(spark, sf_dir)
    edited = found.withColumn("severity", F.when(F.col("ingested_at") % 300 == 0, "EDITED").otherwise(F.col("severity")))
    return registry.verify_seals(registry.seal(members, found), members, edited)


_GATES = """w AS (SELECT c_custkey AS key, i, i = 1 AND c_custkey % 23 = 5 AS other, CASE WHEN i = 0 AND c_custkey % 19 = 4 THEN 2 ELSE 1 END AS version,
  CASE WHEN (c_custkey + i) % 7 = 0 THEN 'UNAVAILABLE' WHEN (c_custkey + i) % 5 = 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
  (c_custkey * 3 + i) % 40 + 5 AS samples, i = 1 AND c_custkey % 11 = 2 AS narrow, i = 1 AND c_custkey % 13 = 6 AS elsewhere
  FROM customer, range(0, 2) t(i) WHERE NOT (i = 1 AND c_custkey % 17 = 3)),
g AS (SELECT key, CASE WHEN bool_or(other) THEN 'ROLE_INVALID' WHEN bool_or(version <> 1) THEN 'PROFILE_SCHEMA_INCOMPATIBLE'
    WHEN count(*) < 2 OR bool_or(status = 'UNAVAILABLE') THEN 'INPUT_PROFILE_UNAVAILABLE' WHEN bool_or(narrow) THEN 'REPRESENTATION_DIMENSION_MISMATCH' WHEN bool_or(elsewhere) THEN 'REPRESENTATION_SPACE_MISMATCH' END AS stop,
  concat_ws(',', CASE WHEN min(samples) < 20 THEN 'INSUFFICIENT_SAMPLE_SUPPORT' END, CASE WHEN bool_or(status = 'PARTIAL') THEN 'INPUT_REPRESENTATION_PROFILE_PARTIAL' END) AS notes FROM w GROUP BY key)
SELECT key, CASE WHEN stop = 'INPUT_PROFILE_UNAVAILABLE' THEN 'UNAVAILABLE' WHEN stop IS NOT NULL THEN 'INCOMPARABLE' WHEN notes <> '' THEN 'PARTIAL' ELSE 'COMPLETE' END AS state,
  coalesce(stop, notes) AS limitations FROM g"""

_GRID = """t AS (SELECT kind, place, top, lft FROM (VALUES ('solid'), ('zero'), ('checkerboard')) a(kind),
  (VALUES ('top_left', 0, 0), ('top_right', 0, 14), ('bottom_left', 1, 0), ('bottom_right', 1, 14), ('center', 0, 7)) b(place, top, lft)),
i AS (SELECT i, 'NCHW' AS layout, i % 32 AS pos FROM range(0, 64) r(i) UNION ALL SELECT i, 'NHWC', i // 2 FROM range(0, 64) r(i)),
p AS (SELECT layout, kind || '_' || place AS trigger_id, vec_id, i, CASE WHEN pos // 16 <> top OR pos % 16 - lft NOT IN (0, 1) THEN embedding[i + 1]::DOUBLE
  WHEN kind = 'zero' THEN 0 WHEN kind = 'checkerboard' AND pos % 16 = lft THEN -1 ELSE 1 END AS x FROM embeddings, t, i)
SELECT layout, trigger_id, vec_id, round(sum(x * (i + 1)), 6) AS checksum FROM p GROUP BY ALL"""

_DRAIN = """b AS (SELECT o_custkey AS chain, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1),
w AS (SELECT o_custkey AS chain, o_orderkey AS k, sum((o_orderkey % 40 = 3 OR o_orderkey % 45 = 2)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS held
  FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 30 <> 7),
d AS (SELECT chain, 'e' || k AS event_key, n + row_number() OVER (PARTITION BY chain ORDER BY k) AS sequence FROM w JOIN b USING (chain) WHERE held = 0)"""

_ACTIVE = """l AS (SELECT o_custkey AS assessment_id, o_orderkey AS k, ['DRAFT', 'ACTIVE', 'SEALED'][o_orderkey % 3 + 1] AS state FROM orders),
b AS (SELECT *, lag(state) OVER (PARTITION BY assessment_id ORDER BY k) AS p FROM l),
c AS (SELECT * FROM b WHERE (p IS NULL AND state = 'DRAFT') OR (p = 'DRAFT' AND state = 'ACTIVE') OR (p = 'ACTIVE' AND state = 'SEALED')),
s AS (SELECT *, sum(CASE state WHEN 'ACTIVE' THEN 1 WHEN 'SEALED' THEN -1 ELSE 0 END) OVER (PARTITION BY assessment_id % 25 ORDER BY k, assessment_id) AS active FROM c)
SELECT assessment_id % 25 AS scope, k AS "at", assessment_id, active::BIGINT AS active FROM s WHERE state = 'ACTIVE' AND active > 1"""

_RESULTS = """g AS (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'CREATED') AS c, count(*) FILTER (status = 'EXISTS') AS e, bool_or(status = 'CONFLICT') AS x FROM sg GROUP BY run_id),
r AS (SELECT *, CASE WHEN run_id % 4 = 1 THEN 'EXISTS' WHEN run_id % 12 = 6 OR x THEN 'CONFLICT' ELSE 'CREATED' END AS result FROM g)
SELECT run_id, result, CASE result WHEN 'CREATED' THEN c ELSE 0 END AS created_findings, CASE result WHEN 'EXISTS' THEN n WHEN 'CREATED' THEN e ELSE 0 END AS existing_findings FROM r"""

_SEALS = """k AS (SELECT substr(asset_id, 7)::BIGINT AS assessment_id, module || '|' || severity || '|' || recommendation || '|' || count(*) AS line, bool_or(ingested_at % 300 = 0) AS e
  FROM f GROUP BY 1, module, severity, recommendation),
s AS (SELECT assessment_id, sha256(string_agg(line, ';' ORDER BY line)) AS summary_hash, bool_or(e) AS e FROM k GROUP BY 1)
SELECT assessment_id, samples AS runs, commitment AS run_set_hash, coalesce(summary_hash, sha256('')) AS summary_hash, CASE WHEN e THEN 'COMPROMISED' ELSE 'VALID' END AS status
FROM hash_tree LEFT JOIN s USING (assessment_id)"""

_RECOMMENDED = ", ".join(f"count(*) FILTER (recommendation = '{r}') AS {r.lower()}" for r in ("ACCEPT", "REVIEW", "QUARANTINE", "REJECT"))
_MODULES = "(VALUES ('dataset_integrity'), ('model_integrity'), ('inference_integrity'), ('distribution_shift')) m(module)"

QUERIES = {
    "window_gates": (window_gates, f"WITH {_GATES}"),
    "output_contract_typed": (
        output_contract_typed,
        "SELECT vec_id, CASE WHEN vec_id % 10 IN (2, 3) THEN 'OUTPUT_CONTRACT_CHANGED' WHEN label % 3 = 2 THEN 'OUTPUT_BYTE_LIMIT_EXCEEDED' ELSE '-' END AS code FROM embeddings",
    ),
    "perturbation_grid": (perturbation_grid, f"WITH {_GRID}"),
    "parameter_fingerprint": (
        parameter_fingerprint,
        f"""WITH p AS (SELECT p_partkey % 10 AS model_id, p_partkey || '|' || p_brand || '|' || p_size AS row FROM part), {commitment_sql("p", "model_id", "row")}
        SELECT model_id, samples AS parameters, commitment AS metadata_sha256 FROM hash_tree""",
    ),
    "recommendation_counts": (recommendation_counts, f"WITH {FINDINGS} SELECT module, {_RECOMMENDED} FROM f GROUP BY module"),
    "category_counts": (
        category_counts,
        f"WITH {FINDINGS} SELECT m.module, c.category, (SELECT count(*) FROM f WHERE f.module = m.module AND f.category = c.category) AS n FROM (SELECT DISTINCT category FROM f) c, {_MODULES}",
    ),
    "outbox_drain": (
        outbox_drain,
        f"""WITH {_DRAIN} SELECT *, printf('AUD-%08d', sequence) AS audit_id, '{{"s":"O"}}' AS payload_json FROM d""",
    ),
    "drained_chains": (
        drained_chains,
        f"WITH {_DRAIN}, e AS (SELECT chain, count(*) AS m FROM d GROUP BY chain) SELECT chain, n + coalesce(m, 0) AS records, 'VALID' AS status FROM b LEFT JOIN e USING (chain) WHERE n + coalesce(m, 0) > 0",
    ),
    "active_overlaps": (active_overlaps, f"WITH {_ACTIVE}"),
    "run_results": (run_results, f"WITH {runs._SUB}, {runs._STATUS.format(x='su')}, {_RESULTS}"),
    "seal_summaries": (
        seal_summaries,
        f"""WITH {FINDINGS}, {runs._MEM}, {commitment_sql("me", "assessment_id", "run_id || '|' || request_hash || '|' || mode")}, {_SEALS}""",
    ),
}
