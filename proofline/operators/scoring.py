"""Assurance scoring over the findings table, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.policies import OVERRIDES, PENALTY, RANK, WEIGHT

MODULES = tuple(WEIGHT)


def penalty(severity: Column) -> Column:
    """Points of a severity; an unknown one is an error."""
    return F.coalesce(*(F.when(severity == s, F.lit(p).cast("decimal(10,4)")) for s, p in PENALTY.items()), F.raise_error(F.concat(F.lit("unknown severity "), F.coalesce(severity, F.lit("null")))).cast("decimal(10,4)"))


def rank(disposition: Column) -> Column:
    return F.coalesce(*(F.when(disposition == d, F.lit(r)) for d, r in RANK.items()))


def disposition(ranked: Column) -> Column:
    return F.coalesce(*(F.when(ranked == r, F.lit(d)) for d, r in RANK.items()))


def band(score: Column) -> Column:
    return F.when(score.isNull(), "UNKNOWN").when(score >= 90, "GOOD").when(score >= 70, "WATCH").when(score >= 40, "REVIEW").otherwise("HIGH_RISK")


def band_rank(status: Column) -> Column:
    return F.when(status == "GOOD", 0).when(status == "HIGH_RISK", 2).otherwise(1)


def _overrides(which: int) -> Column:
    """Rank of the override of a critical category for the asset (0), module (1) or system (2); else 0."""
    return F.coalesce(*(F.when((F.col("category") == c) & (F.col("severity") == "CRITICAL"), F.lit(RANK[d[which]])) for c, d in OVERRIDES.items()), F.lit(0))


def system_effect(recommendation: Column, asset_type: Column) -> Column:
    """Rank of a finding's effect on the system: quarantine only for whole models, pipelines and data sets."""
    strong = (rank(recommendation) >= RANK["QUARANTINE"]) & asset_type.isin("model", "pipeline", "dataset")
    return F.when(strong, RANK["QUARANTINE"]).when(rank(recommendation) > 0, RANK["REVIEW"]).otherwise(0)


def category_penalties(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The worst severity penalty x confidence of each module and category; on a tie the smallest finding id.

    A struct's minimum keeps the finding: (negative points, id) is combined before the shuffle, without a sort.
    """
    points = (penalty(F.col("severity")) * F.col("confidence")).cast("decimal(20,10)")
    worst = F.min(F.struct((-points).alias("p"), "finding_id"))
    return found.groupBy(*keys, "module", "category").agg(worst.alias("w")).select(*keys, "module", "category", (-F.col("w.p")).alias("penalty"), F.col("w.finding_id").alias("finding_id"))


def module_scores(found: DataFrame) -> DataFrame:
    """Score, status, disposition and counts of the four modules; a module without findings is unknown."""
    modules = found.sparkSession.createDataFrame([(m, i) for i, m in enumerate(MODULES)], "module string, module_order int")
    lost = category_penalties(found).groupBy("module").agg(F.sum("penalty").alias("lost"))
    effects = found.groupBy("module").agg(
        F.max(F.greatest(F.least(rank(F.col("recommendation")), F.when(F.col("recommendation") == "REJECT", RANK["REVIEW"]).otherwise(RANK["REJECT"])), _overrides(1))).alias("effect"),
        F.count("*").alias("n_findings"),
        F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
    )
    score = F.when(F.col("lost").isNotNull(), F.lit(100).cast("decimal(20,10)") - F.least(F.lit(100).cast("decimal(20,10)"), F.col("lost").cast("decimal(20,10)")))
    joined = F.broadcast(modules).join(lost, "module", "left").join(effects, "module", "left").withColumn("score", score)
    status = band(F.col("score"))
    return joined.withColumn("status", status).withColumn("rank", F.when(F.col("score").isNull(), RANK["REVIEW"]).otherwise(F.greatest(band_rank(status), "effect"))).select(
        "module", "module_order", "score", "status", disposition(F.col("rank")).alias("disposition"), "rank", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("n_critical", F.lit(0)).alias("n_critical")
    )


def overrides_in(found: DataFrame) -> DataFrame:
    """Critical overrides that apply: category and the dispositions of asset, module and system."""
    hit = found.where((F.col("severity") == "CRITICAL") & F.col("category").isin(*OVERRIDES))
    return hit.groupBy("category").agg(F.count("*").alias("n"), F.max(_overrides(0)).alias("a"), F.max(_overrides(1)).alias("m"), F.max(_overrides(2)).alias("s")).select("category", "n", *(disposition(F.col(x)).alias(n) for x, n in (("a", "asset"), ("m", "module"), ("s", "system"))))


def overall(found: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """One row: weighted score, coverage, status, disposition, the most concerning module, and the leading reason.

    ``audit``: one row with ``audit_status`` VALID, COMPROMISED or UNAVAILABLE; none counts as VALID.
    """
    scores = module_scores(found)
    weight = F.coalesce(*(F.when(F.col("module") == m, F.lit(w).cast("decimal(10,4)")) for m, w in WEIGHT.items()))
    known = F.when(F.col("score").isNotNull(), weight)
    worst = F.min(F.when(F.col("score").isNotNull(), F.struct("score", "module_order", "module")))["module"]
    one = scores.agg(
        (F.sum(F.col("score") * known) / F.sum(known)).cast("decimal(38,18)").alias("score"),
        F.coalesce(F.sum(known), F.lit(0).cast("decimal(10,4)")).cast("decimal(10,4)").alias("coverage"),
        F.max(F.when(F.col("score").isNotNull(), F.col("rank"))).alias("module_rank"),
        worst.alias("most_concerning"),
    )
    effect = found.agg(F.coalesce(F.max(F.greatest(system_effect(F.col("recommendation"), F.col("asset_type")), _overrides(2))), F.lit(0)).alias("effect"), F.coalesce(F.max(_overrides(2)), F.lit(0)).alias("override"))
    audit = audit if audit is not None else found.sparkSession.createDataFrame([("VALID",)], "audit_status string")
    row = one.crossJoin(F.broadcast(effect)).crossJoin(F.broadcast(audit.select("audit_status")))
    status = band(F.col("score"))
    by_audit = F.when(F.col("audit_status") == "COMPROMISED", 2).when(F.col("audit_status") == "UNAVAILABLE", 1).otherwise(0)
    short = F.when(F.col("coverage") < 1, 1).otherwise(0)
    strongest = F.greatest(band_rank(status), F.coalesce("module_rank", F.lit(0)), "effect", by_audit, short)
    reason = F.when(F.col("audit_status") == "COMPROMISED", "AUDIT_COMPROMISED").when(F.col("override") > 0, "CRITICAL_OVERRIDE").when(F.col("score").isNull() | (F.col("audit_status") == "UNAVAILABLE"), "UNAVAILABLE").when(F.col("coverage") < 1, "INCOMPLETE_COVERAGE").otherwise("COMPLETE")
    return row.select(
        F.round("score", 1).alias("score"),
        F.round("coverage", 2).alias("coverage"),
        F.when(F.col("coverage") == 0, "UNAVAILABLE").when(F.col("coverage") < 1, "PROVISIONAL").otherwise("COMPLETE").alias("assessment"),
        status.alias("status"),
        disposition(strongest).alias("disposition"),
        "most_concerning",
        reason.alias("reason"),
    )


def severity_counts(found: DataFrame) -> DataFrame:
    """Findings by module and severity, absent ones as 0."""
    wide = found.groupBy("module").pivot("severity", list(PENALTY)).count()
    return wide.select("module", *(F.coalesce(s, F.lit(0)).alias(s.lower()) for s in PENALTY))


def recommendation_counts(found: DataFrame) -> DataFrame:
    """Findings by module and recommendation, absent ones as 0."""
    wide = found.groupBy("module").pivot("recommendation", list(RANK)).count()
    return wide.select("module", *(F.coalesce(r, F.lit(0)).alias(r.lower()) for r in RANK))


def category_counts(found: DataFrame) -> DataFrame:
    """Findings by module for each category that occurs at all, absent ones as 0."""
    counts = found.groupBy("module", "category").agg(F.count("*").alias("n"))
    module = F.explode(F.array(*map(F.lit, WEIGHT))).alias("module")
    every = found.select("category").distinct().select("category", module)
    return every.join(counts, ["module", "category"], "left").fillna(0, ["n"])


def top_findings(found: DataFrame, most: int = 5) -> DataFrame:
    """The leading findings of each module: by severity, then confidence, then id."""
    order = Window.partitionBy("module").orderBy(penalty(F.col("severity")).desc(), F.col("confidence").desc(), "finding_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def latest_findings(found: DataFrame, most: int = 10) -> DataFrame:
    """The findings ingested last."""
    return found.orderBy(F.col("ingested_at").desc(), F.col("finding_id").desc()).limit(most)


def first_limitations(found: DataFrame, most: int = 20) -> DataFrame:
    """The first distinct limitations in order of ingestion; ``found`` has a list column ``limitations``."""
    each = found.select("ingested_at", "finding_id", F.posexplode("limitations").alias("pos", "limitation"))
    return each.groupBy("limitation").agg(F.min(F.struct("ingested_at", "finding_id", "pos")).alias("at")).orderBy("at").limit(most).select("limitation", F.col("at.ingested_at").alias("first_at"))


def trust_scope(found: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """Counts of findings from authenticated runs and of the others, by module."""
    marked = found.join(trusted_ids.select("finding_id", F.lit(True).alias("trusted")).distinct(), "finding_id", "left")
    return marked.groupBy("module").agg(F.count_if("trusted").alias("trusted"), F.count_if(F.col("trusted").isNull()).alias("excluded"))
