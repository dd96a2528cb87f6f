"""The full dataset scan: every detector that has its input, as one findings table and a summary row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions.columns import median_signature
from proofline.operators import detect
from proofline.session import cut

DETECTORS = ("exact_duplicates", "near_duplicates", "rare_labels", "outliers")


def analyze(samples: DataFrame, labels: DataFrame | None = None, vectors: DataFrame | None = None, only: tuple[str, ...] = DETECTORS, threshold: int = 10, least_label: int = 2, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, summary) of a data set.

    ``samples``: sample_id, content, contributor_id, batch_id; ``labels``: sample_id, label; ``vectors``: sample_id,
    vector (near duplicates take those of 64 values). Near duplicates are found between classes of equal signatures, a
    member of a class linked with its representative. Each detector is a plan of its own; those left out or without input are named in the summary. All distinct
    findings are returned; with ``most``, the first so many by id, and ``partial`` says whether more were left out.
    """
    found, skipped = [], []
    exact = detect.duplicate_groups(samples, "sample_id", "content")
    for name, have in (("exact_duplicates", True), ("near_duplicates", vectors is not None), ("rare_labels", labels is not None), ("outliers", vectors is not None)):
        if name not in only:
            skipped.append(f"{name}:DISABLED")
        elif not have:
            skipped.append(f"{name}:NO_INPUT")
        elif name == "exact_duplicates":
            found.append(detect.duplicate_findings(exact))
        elif name == "near_duplicates":
            signed = vectors.where(F.size("vector") == 64).select("sample_id", median_signature(F.col("vector")).alias("s"))
            # one finding for each pair of classes and for each member that its representative stands for
            classes = cut(detect.near_classes(signed, "sample_id", "s"), "near-classes")
            members = classes.where("key != representative").select(F.col("representative").alias("a"), F.col("key").alias("b"), F.lit(0).alias("distance"))
            pairs = detect.near_class_pairs(classes, threshold).select("a", "b", F.col("distance").cast("int").alias("distance")).union(members)
            hashes = samples.select(F.col("sample_id").alias("key"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
            found.append(detect.near_findings(detect.minus_exact(pairs, hashes)))
        elif name == "rare_labels":
            found.append(detect.rare_labels(labels, "sample_id", "label", least_label))
        else:
            scores = detect.outlier_scores(vectors, "sample_id", "vector")
            out = detect.outliers(scores, detect.outlier_threshold(scores))
            evidence = F.array(F.concat(F.lit("ood_score="), F.format_string("%.6f", "score")), F.concat(F.lit("calibrated_threshold="), F.format_string("%.6f", "threshold")))
            found.append(detect.findings(out, "OOD_OUTLIER", "sample", F.col("sample_id").cast("string"), F.col("severity"), F.col("confidence"), F.lit("A sample lies far from the others."), evidence, evidence))
    every = detect.findings(samples.limit(0), "NONE", "dataset", F.lit(""), F.lit("LOW"), F.lit(0.0), F.lit(""), F.array(F.lit("")), F.array(F.lit("")))
    for part in found:
        every = every.unionByName(part)
    bound = cut(detect.bind_source(every, samples.select(F.col("sample_id").cast("string").alias("sample_id"), "contributor_id", "batch_id").dropDuplicates(["sample_id"])), "dataset-scan")
    kept = bound.dropDuplicates(["finding_id"])
    kept = kept.withColumn("partial", F.lit(False)) if most is None else detect.stable(kept, most)
    risk = detect.dataset_risk(bound)
    summary = risk.withColumn("skipped", F.lit(",".join(skipped))).crossJoin(F.broadcast(bound.agg(F.count_distinct("finding_id").alias("unique_findings"))))
    return kept, summary
