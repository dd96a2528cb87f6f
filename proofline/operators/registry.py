"""Registries, authorisation of runs, run ingestion and assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators import profile
from proofline.operators.relational import ingest_status, running_sum, transitions


def verify_models(observed: DataFrame, registry: DataFrame) -> DataFrame:
    """Observed digests against the registry: the finding, if any, and the verdict; ``registry``: (model_id, digest, state)."""
    known = registry.select("model_id", F.col("digest").alias("registered"), "state")
    joined = observed.join(known, "model_id", "left")
    finding = (
        F.when(F.col("state").isNull(), "MODEL_UNREGISTERED")
        .when(~F.col("digest").eqNullSafe(F.col("registered")), "MODEL_SUBSTITUTION")
        .when(F.col("state").isin("REVOKED", "QUARANTINED"), F.concat(F.lit("MODEL_"), F.col("state")))
    )
    verdict = F.when(F.col("finding").isNull(), "ACCEPT").when(F.col("finding") == "MODEL_UNREGISTERED", "REVIEW").when(F.col("finding") == "MODEL_QUARANTINED", "QUARANTINE").otherwise("REJECT")
    return joined.withColumn("finding", finding).withColumn("verdict", verdict)


def authorise(runs: DataFrame, producers: DataFrame, keys: DataFrame) -> DataFrame:
    """The first reason to deny a run, or null.

    ``runs``: producer_id, module, key_id, fingerprint; ``producers``: producer_id, module, state; ``keys``: key_id,
    producer_id, state, fingerprint.
    """
    p = producers.select("producer_id", F.col("module").alias("_module"), F.col("state").alias("_state"))
    k = keys.select("key_id", F.col("producer_id").alias("_owner"), F.col("state").alias("_key"), F.col("fingerprint").alias("_print"))
    reason = (
        F.when(F.col("_state").isNull(), "PRODUCER_UNKNOWN")
        .when(F.col("_state") != "APPROVED", "PRODUCER_NOT_APPROVED")
        .when(~F.col("_module").eqNullSafe(F.col("module")), "MODULE_MISMATCH")
        .when(F.col("_key").isNull(), "KEY_UNKNOWN")
        .when(F.col("_owner") != F.col("producer_id"), "KEY_NOT_OWNED")
        .when(F.col("_key") != "ACTIVE", "KEY_NOT_ACTIVE")
        .when(~F.col("_print").eqNullSafe(F.col("fingerprint")), "FINGERPRINT_MISMATCH")
    )
    return runs.join(p, "producer_id", "left").join(k, "key_id", "left").withColumn("denial", reason).drop("_module", "_state", "_owner", "_key", "_print")


def key_conflicts(keys: DataFrame) -> DataFrame:
    """Keys registered under one id with different content, and fingerprints bound to several producers."""
    content = keys.groupBy("key_id").agg(F.countDistinct("producer_id", "fingerprint").alias("n")).where("n > 1").select(F.lit("KEY_CONTENT_CONFLICT").alias("conflict"), F.col("key_id").alias("subject"), "n")
    owner = keys.groupBy("fingerprint").agg(F.countDistinct("producer_id").alias("n")).where("n > 1").select(F.lit("FINGERPRINT_BOUND_TWICE").alias("conflict"), F.col("fingerprint").alias("subject"), "n")
    return content.union(owner)


def run_problems(runs: DataFrame, most: int = 100) -> DataFrame:
    """Why a run is malformed, or null; ``findings`` is a list of (finding_id, module)."""
    ids = F.transform("findings", lambda f: f["finding_id"])
    return runs.withColumn("problem", F.when(F.size("findings") > most, "TOO_MANY_FINDINGS").when(F.size(F.array_distinct(ids)) < F.size(ids), "DUPLICATE_FINDING_IDS").when(~F.forall("findings", lambda f: f["module"].eqNullSafe(F.col("module"))), "MODULE_MISMATCH"))


def ingest_runs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Runs, given by their findings (run_id, finding_id, content), against stored findings (finding_id, content).

    A run is taken whole or not at all: one finding that is stored with other content rejects it.
    """
    status = ingest_status(incoming, stored, "finding_id", "content")
    found = status.groupBy("run_id").agg(F.count_if(F.col("status") == "CREATED").alias("created"), F.count_if(F.col("status") == "EXISTS").alias("existing"), F.count_if(F.col("status") == "CONFLICT").alias("conflicts"))
    return found.withColumn("accepted", F.col("conflicts") == 0)


def run_results(requests: DataFrame, stored_runs: DataFrame, incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of submitted runs (run_id, request_hash) against stored ones: ``result`` with counts of findings.

    EXISTS for a run that is stored under the same request: all its findings exist, none is looked at again. CONFLICT
    for one stored under another request, and for a new one with a finding stored with other content; else CREATED.
    """
    kept = stored_runs.select("run_id", F.col("request_hash").alias("_stored"))
    counts = ingest_runs(incoming, stored)
    joined = requests.join(kept, "run_id", "left").join(counts, "run_id", "left").fillna(0, ["created", "existing", "conflicts"])
    known, same = F.col("_stored").isNotNull(), F.col("_stored") == F.col("request_hash")
    result = F.when(known & same, "EXISTS").when(known | (F.col("conflicts") > 0), "CONFLICT").otherwise("CREATED")
    every = F.col("created") + F.col("existing") + F.col("conflicts")
    return joined.withColumn("result", result).select(
        "run_id",
        "result",
        F.when(F.col("result") == "CREATED", F.col("created")).otherwise(0).alias("created_findings"),
        F.when(F.col("result") == "EXISTS", every).when(F.col("result") == "CREATED", F.col("existing")).otherwise(0).alias("existing_findings"),
    )


def lifecycle(log: DataFrame) -> DataFrame:
    """Assessment events with their legality: DRAFT, then ACTIVE, then SEALED."""
    return transitions(log, "assessment_id", ("at",), "state", {None: ("DRAFT",), "DRAFT": ("ACTIVE",), "ACTIVE": ("SEALED",), "SEALED": ()})


def active_overlaps(log: DataFrame, scope: str) -> DataFrame:
    """Legal events that leave more than one assessment of a scope ACTIVE at once: (scope, at, assessment_id, active).

    ``log``: scope, assessment_id, at, state. What is ACTIVE is the running sum of legal activations less legal seals.
    """
    step = F.when(F.col("state") == "ACTIVE", 1).when(F.col("state") == "SEALED", -1).otherwise(0)
    legal = lifecycle(log).where("is_legal").withColumn("_step", step)
    summed = running_sum(legal, (scope,), ("at", "assessment_id"), F.col("_step"))
    return summed.where((F.col("state") == "ACTIVE") & (F.col("running") > 1)).select(scope, "at", "assessment_id", F.col("running").alias("active"))


def seal(members: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Per assessment, the hash of its set of runs (run_id, request_hash, mode), whatever their order.

    With its findings (assessment_id, module, severity, recommendation) also the hash of their summary: the counts by
    module, severity and recommendation, in order; an assessment without findings has the hash of an empty summary.
    """
    row = F.concat_ws("|", F.col("run_id").cast("string"), "request_hash", "mode")
    runs = profile.commitment(members, ("assessment_id",), row).select("assessment_id", F.col("samples").alias("runs"), F.col("commitment").alias("run_set_hash"))
    if found is None:
        return runs
    kinds = found.groupBy("assessment_id", "module", "severity", "recommendation").agg(F.count("*").alias("n"))
    line = F.concat_ws("|", "module", "severity", "recommendation", F.col("n").cast("string"))
    summary = kinds.groupBy("assessment_id").agg(F.array_join(F.array_sort(F.collect_list(line)), ";").alias("_s"))
    return runs.join(summary, "assessment_id", "left").withColumn("summary_hash", F.sha2(F.coalesce("_s", F.lit("")), 256)).drop("_s")


def verify_seals(sealed: DataFrame, members: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Stored seals against the runs (and, where given, the findings) as they are now."""
    hashes = ["run_set_hash"] if found is None else ["run_set_hash", "summary_hash"]
    now = seal(members, found).select("assessment_id", *(F.col(h).alias(f"_{h}") for h in hashes))
    same = F.lit(True)
    for h in hashes:
        same = same & F.col(f"_{h}").eqNullSafe(F.col(h))
    return sealed.join(now, "assessment_id", "left").withColumn("status", F.when(same, "VALID").otherwise("COMPROMISED")).drop(*(f"_{h}" for h in hashes))


def edges(members: DataFrame, found: DataFrame) -> DataFrame:
    """Edges assessment -> run -> finding."""
    up = members.select(F.col("assessment_id").cast("string").alias("src"), F.col("run_id").cast("string").alias("dst"), F.lit("HAS_RUN").alias("relation"))
    down = found.select(F.col("run_id").cast("string").alias("src"), F.col("finding_id").alias("dst"), F.lit("REPORTED").alias("relation"))
    return up.union(down).distinct()


def run_details(runs: DataFrame, members: DataFrame, authentications: DataFrame) -> DataFrame:
    """Runs with their assessment and authentication; a run without authentication has the error MISSING_AUTHENTICATION."""
    joined = runs.join(members.select("run_id", "assessment_id"), "run_id", "left").join(authentications.select("run_id", "mode"), "run_id", "left")
    return joined.withColumn("authenticated", F.coalesce(F.col("mode") == "SIGNED", F.lit(False))).withColumn("error", F.when(F.col("mode").isNull(), "MISSING_AUTHENTICATION"))


def run_id(*parts: str):
    """A run's id over the columns that make it the run it is."""
    return F.concat(F.lit("R-"), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256), 1, 24))


def assessment_findings(members: DataFrame, runs: DataFrame, authentications: DataFrame, mode: str | None = None) -> DataFrame:
    """Findings of assessments whose runs are authenticated for the very request that was made.

    ``members``: (assessment_id, run_id); ``runs``: (run_id, module, request_hash, finding_ids); ``authentications``:
    (run_id, request_hash, mode).
    """
    joined = members.join(runs, "run_id").join(authentications.select("run_id", F.col("request_hash").alias("_signed"), "mode"), "run_id").where("request_hash = _signed")
    joined = joined.where(F.col("mode") == mode) if mode else joined
    return joined.select("assessment_id", "module", "mode", F.explode("finding_ids").alias("finding_id")).distinct()
