"""Model outputs: validated prediction rows, their profiles, and the reading of three layers' reports together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.columns import canonical, entropy, finite, margin

TIERS = ("LABEL_ONLY", "TOP1_CONFIDENCE", "FULL_PROBABILITIES")


def prediction_code(labels: tuple[str, ...], tier: str = "FULL_PROBABILITIES", abstention: bool = False, unknown: bool = False, tolerance: float = 1e-6) -> Column:
    """The first rule that a prediction row breaks, or null; columns as in the predictions table."""
    p, confidence = F.col("probabilities"), F.col("confidence")
    vocabulary = F.array(*(F.lit(x) for x in labels))
    top = F.array_max(p)
    broken = (
        F.when(F.col("sample_id").isNotNull() & ((F.length("sample_id") == 0) | (F.length("sample_id") > 256)), "INVALID_SAMPLE_ID")
        .when(F.col("predicted_label").isNull() | ~F.array_contains(vocabulary, F.col("predicted_label")), "INVALID_LABEL")
        .when(confidence.isNotNull() & ~(finite(confidence) & (confidence >= 0) & (confidence <= 1)), "INVALID_CONFIDENCE")
        .when(F.col("abstained").isNotNull() if not abstention else F.col("abstained").isNull(), "INVALID_ABSTENTION_FLAG")
        .when(F.col("unknown_or_ood").isNotNull() if not unknown else F.col("unknown_or_ood").isNull(), "INVALID_UNKNOWN_FLAG")
    )
    if tier == "LABEL_ONLY":
        return broken.when(confidence.isNotNull() | p.isNotNull(), "EVIDENCE_TIER_MISMATCH")
    if tier == "TOP1_CONFIDENCE":
        return broken.when(confidence.isNull() | p.isNotNull(), "EVIDENCE_TIER_MISMATCH")
    bad = p.isNull() | (F.size(p) != len(labels)) | F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return (
        broken.when(bad, "INVALID_PROBABILITY_VECTOR")
        .when(F.abs(total - 1) > tolerance, "PROBABILITY_SUM_MISMATCH")
        .when(F.array_position(p, top) != F.array_position(vocabulary, F.col("predicted_label")), "LABEL_ARGMAX_MISMATCH")
        .when(confidence.isNotNull() & (F.abs(confidence - top) > tolerance), "CONFIDENCE_PROBABILITY_MISMATCH")
    )


def measured(valid: DataFrame, tier: str = "FULL_PROBABILITIES") -> DataFrame:
    """Valid rows with ``top1``, ``entropy`` and ``margin`` where the tier has them."""
    full = tier == "FULL_PROBABILITIES"
    none = F.lit(None).cast("double")
    return valid.withColumns({"top1": F.array_max("probabilities") if full else F.col("confidence"), "entropy": entropy(F.col("probabilities")) if full else none, "margin": margin(F.col("probabilities")) if full else none})


def label_counts(valid: DataFrame, keys: tuple[str, ...], labels: tuple[str, ...]) -> DataFrame:
    """Counts of the declared labels by key, absent ones as 0, in the vocabulary's order (``class_index``)."""
    wide = valid.groupBy(*keys).pivot("predicted_label", list(labels)).count()
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("class_index"), F.lit(x).alias("value"), F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias("n")) for i, x in enumerate(labels))))
    return wide.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def rates(valid: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Abstention and unknown rates by key; null where the flag is never given."""
    share = lambda c: F.try_divide(F.count_if(F.col(c)).cast("double"), F.count(c).cast("double"))
    return valid.groupBy(*keys).agg(share("abstained").alias("abstention_rate"), share("unknown_or_ood").alias("unknown_rate"))


def rate_shift(rows: DataFrame, keys: tuple[str, ...], rate: str, threshold: float = 0.10) -> DataFrame:
    """Absolute change of a rate between roles, and whether it is a shift."""
    both = rows.groupBy(*keys).agg(*(F.first(F.when(F.col("role") == role, F.col(rate)), ignorenulls=True).alias(n) for role, n in (("REFERENCE", "a"), ("CURRENT", "b"))))
    change = F.abs(F.col("b") - F.col("a"))
    return both.select(*keys, change.alias("change"), F.when(change.isNull(), "UNAVAILABLE").when(change >= threshold, "SHIFTED").otherwise("STABLE").alias("state"))


LAYERS = ("IMAGE", "REPRESENTATION", "OUTPUT")
#: Names of pairs of changed layers.
PAIRS = {(True, True, False): "IMAGE_AND_REPRESENTATION_SHIFT", (True, False, True): "IMAGE_AND_OUTPUT_SHIFT", (False, True, True): "REPRESENTATION_AND_OUTPUT_SHIFT"}


def interpret(reports: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The pattern of three layers' reports per key; ``reports``: (keys..., layer, status, shifted as a text list).

    A layer without a report is not provided; one that is UNAVAILABLE or INCOMPARABLE can't be assessed.
    """
    bit = lambda layer: F.coalesce(F.max(F.when(F.col("layer") == layer, F.col("status").isin("COMPLETE", "PARTIAL") & (F.length("shifted") > 0))), F.lit(False))
    status = lambda layer: F.max(F.when(F.col("layer") == layer, F.col("status")))
    wide = reports.groupBy(*keys).agg(*(bit(x).alias(f"_{x}") for x in LAYERS), *(status(x).alias(f"s_{x}") for x in LAYERS))
    complete = F.lit(True)
    usable = F.lit(False)
    for x in LAYERS:
        complete = complete & F.coalesce(F.col(f"s_{x}") == "COMPLETE", F.lit(False))
        usable = usable | F.coalesce(F.col(f"s_{x}").isin("COMPLETE", "PARTIAL"), F.lit(False))
    changed = sum((F.col(f"_{x}").cast("int") for x in LAYERS), F.lit(0))
    pair = F.coalesce(*(F.when((F.col("_IMAGE") == a) & (F.col("_REPRESENTATION") == b) & (F.col("_OUTPUT") == c), F.lit(n)) for (a, b, c), n in PAIRS.items()))
    only = F.coalesce(*(F.when(F.col(f"_{x}"), F.lit(f"{x}_SHIFT_ONLY")) for x in LAYERS))
    pattern = (
        F.when(~F.col("usable"), "DISTRIBUTION_SHIFT_EVIDENCE_UNAVAILABLE")
        .when(F.col("changed") == 3, "BROAD_MULTILAYER_SHIFT")
        .when((F.col("changed") == 0) & F.col("complete"), "NO_SHIFT_OBSERVED")
        .when(F.col("changed") == 0, "DISTRIBUTION_SHIFT_EVIDENCE_INCOMPLETE")
        .when(~F.col("complete"), "DISTRIBUTION_SHIFT_WITH_INCOMPLETE_COVERAGE")
        .when(F.col("changed") == 2, pair)
        .otherwise(only)
    )
    found = wide.withColumns({"complete": complete, "usable": usable, "changed": changed}).withColumn("pattern", pattern)
    lists = {n: F.array_join(F.array_compact(F.array(*(F.when(cond(x), F.lit(x)) for x in LAYERS))), ",") for n, cond in (("changed_layers", lambda x: F.col(f"_{x}")), ("incomplete_layers", lambda x: F.col(f"s_{x}") == "PARTIAL"), ("missing_layers", lambda x: F.col(f"s_{x}").isNull() | ~F.col(f"s_{x}").isin("COMPLETE", "PARTIAL")))}
    return found.withColumns(lists).withColumn("interpretation_id", F.sha2(canonical(changed=F.col("changed_layers"), incomplete=F.col("incomplete_layers"), missing=F.col("missing_layers"), pattern=F.col("pattern")), 256))


def shift_findings(interpreted: DataFrame) -> DataFrame:
    """The finding of each pattern that is one: category, severity and confidence."""
    severity = F.when(F.col("pattern") == "DISTRIBUTION_SHIFT_EVIDENCE_UNAVAILABLE", "MEDIUM").when(F.col("pattern") == "DISTRIBUTION_SHIFT_EVIDENCE_INCOMPLETE", "LOW").when(F.col("changed") == 1, "MEDIUM").otherwise("HIGH")
    confidence = F.when(F.col("pattern").like("%EVIDENCE%"), 1.0).otherwise(0.9)
    return interpreted.where("pattern != 'NO_SHIFT_OBSERVED'").withColumns({"category": F.col("pattern"), "severity": severity, "confidence": confidence})


#: What to look into when a layer moved.
LAYER_CHECKS = {
    "IMAGE": ("Look at the pixel features that moved.", "Compare capture and preprocessing settings of both windows."),
    "REPRESENTATION": ("Make sure that both windows were embedded by one model.", "Look at the embedding features that moved, segment by segment."),
    "OUTPUT": ("Make sure that both windows share one label set.", "Look at the output features that moved and at the runtime."),
}


def texts(interpreted: DataFrame) -> DataFrame:
    """Interpretations with a ``summary``, one line per layer (``observations``) and the ``checks`` they call for."""
    listed = lambda c: F.replace(F.col(c), F.lit(","), F.lit(", "))
    gap = F.when(F.col("complete"), "").otherwise(" Not every layer was fully assessed.")
    summary = (
        F.when(~F.col("usable"), F.lit("No layer could be assessed."))
        .when(F.col("changed") == 0, F.concat(F.lit("None of the assessed layers moved."), gap))
        .otherwise(F.concat(F.lit("Moved: "), listed("changed_layers"), F.lit("."), gap))
    )
    seen = lambda x: F.col(f"s_{x}").isin("COMPLETE", "PARTIAL")
    line = lambda x: F.concat(F.lit(f"{x}: "), F.when(F.col(f"_{x}"), "moved").when(seen(x), "steady").otherwise(F.concat(F.lit("not assessed, "), F.coalesce(F.col(f"s_{x}"), F.lit("NOT_PROVIDED")))))
    none = F.array().cast("array<string>")
    of_layers = [F.when(F.col(f"_{x}"), F.array(*map(F.lit, checks))).otherwise(none) for x, checks in LAYER_CHECKS.items()]
    missing = F.when(F.col("complete"), none).otherwise(F.array(F.lit("Provide the layers that were not fully assessed.")))
    checks = F.concat(F.array(F.lit("Make sure that the reports belong to the two windows meant.")), *of_layers, missing)
    return interpreted.withColumns({"summary": summary, "observations": F.array(*map(line, LAYERS)), "checks": checks})


def layer_problems(reports: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Reports that contradict themselves: a layer twice, a feature in two lists, or a shift in an unavailable layer."""
    n = reports.groupBy(*keys, "layer").agg(F.count("*").alias("n")).where("n > 1").select(*keys, "layer", F.lit("DUPLICATE_LAYER").alias("problem"))
    as_list = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != "")
    overlap = reports.where(F.arrays_overlap(as_list("shifted"), as_list("stable"))).select(*keys, "layer", F.lit("OVERLAPPING_PARTITIONS").alias("problem"))
    claim = reports.where((~F.col("status").isin("COMPLETE", "PARTIAL")) & (F.length("shifted") > 0)).select(*keys, "layer", F.lit("IMPOSSIBLE_COVERAGE").alias("problem"))
    return n.unionByName(overlap).unionByName(claim)
