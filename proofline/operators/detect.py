"""Dataset-integrity detectors: duplicates, near duplicates, rare labels, outliers, risk."""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.columns import bounded_list, dot, finding_id, hamming, norm
from proofline.functions.policies import RISK_WEIGHT, OutlierPolicy
from proofline.operators.quantiles import with_quantiles
from proofline.session import cut

DATASET = "dataset_integrity"


def findings(df: DataFrame, category: str, asset_type: str, asset_id: Column, severity: Column, confidence: Column, reason: Column, evidence: Column, key: Column, limitations: Column | None = None, module: str = DATASET) -> DataFrame:
    """Rows of ``df`` in the common findings schema; the id is over all of ``key``, evidence is bounded."""
    return df.select(
        finding_id(F.lit(module), F.lit(category), asset_id, key).alias("finding_id"),
        F.lit(module).alias("module"),
        F.lit(asset_type).alias("asset_type"),
        asset_id.alias("asset_id"),
        F.lit(category).alias("category"),
        severity.alias("severity"),
        confidence.cast("double").alias("confidence"),
        reason.alias("reason"),
        bounded_list(evidence).alias("evidence"),
        F.lit("REVIEW").alias("recommendation"),
        (limitations if limitations is not None else F.array().cast("array<string>")).alias("limitations"),
    )


def duplicate_groups(df: DataFrame, path: str, content: str, segment: tuple[str, ...] = (), shown: int = 20) -> DataFrame:
    """Groups of equal content: hash, size, smallest path and the first ``shown`` paths.

    Paths are ranked inside their group and only the shown ones are collected, so a group of any size stays small.
    """
    hashed = df.select(*segment, F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"), F.col(path).alias("path")).where("content_hash IS NOT NULL")
    sizes = hashed.groupBy(*segment, "content_hash").agg(F.count("*").alias("n"), F.min("path").alias("asset_id")).where("n > 1")
    rank = Window.partitionBy(*segment, "content_hash").orderBy("path")
    first = hashed.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= shown).groupBy(*segment, "content_hash").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return sizes.join(first, [*segment, "content_hash"])


def duplicate_findings(groups: DataFrame) -> DataFrame:
    """One finding for each duplicate group, on its smallest path."""
    shown = F.concat(F.lit("duplicate_paths="), F.array_join("paths", ","))
    evidence = F.array(F.concat(F.lit("sha256="), "content_hash"), F.concat(F.lit("duplicate_count="), F.col("n").cast("string")), shown)
    more = F.when(F.col("n") > F.size("paths"), F.array(F.concat(F.lit("Only the first "), F.size("paths").cast("string"), F.lit(" paths are listed.")))).otherwise(F.array().cast("array<string>"))
    return findings(groups, "EXACT_DUPLICATE", "sample", F.col("asset_id"), F.lit("HIGH"), F.lit(1.0), F.lit("Several samples have byte-identical content."), evidence, F.concat(F.array("content_hash"), F.col("paths")), more)


#: Candidates per signature that the number of blocks is chosen for, and the most copies of a signature.
CANDIDATES, COPIES = 20_000, 10_000


def block_count(n: int, threshold: int = 10) -> int:
    """The fewest blocks for which signatures spread at random have ``CANDIDATES`` candidates each, whatever their number."""
    blocks = threshold + 1
    while blocks < 64 and comb(blocks + 1, threshold) <= COPIES and n * comb(blocks, threshold) * 2.0 ** -(64 * (blocks - threshold) / blocks) > CANDIDATES:
        blocks += 1
    return blocks


def near_candidates(df: DataFrame, key: str, signature: str, threshold: int, blocks: int) -> DataFrame:
    """Rows (a, sa, b, sb, chosen, through) that share all bits of some ``blocks - threshold`` blocks, once for each such choice."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    choices = [(signed(sum(masks[i] for i in c)), sum(1 << i for i in c), (1 << c[-1] + 1) - 1) for c in combinations(range(blocks), blocks - threshold)]
    rows = df.select(F.col(key).alias("k"), F.col(signature).alias("s")).where("s IS NOT NULL")
    # one literal, however many choices there are: as expressions they would fill the driver with plans
    listed = F.from_json(F.lit(json.dumps([dict(zip(("mask", "chosen", "through"), c)) for c in choices])), "array<struct<mask:long,chosen:long,through:long>>")
    spread = rows.withColumn("c", F.explode(listed))
    keyed = spread.select("k", "s", "c.chosen", "c.through", F.col("s").bitwiseAND(F.col("c.mask")).alias("v"))
    one, two = keyed.selectExpr("k AS a", "s AS sa", "chosen", "through", "v"), keyed.selectExpr("k AS b", "s AS sb", "chosen", "v")
    return one.join(two.hint("merge"), ["chosen", "v"]).where("a < b").select("a", "sa", "b", "sb", "chosen", "through")


def near_pairs(df: DataFrame, key: str, signature: str, threshold: int = 10, blocks: int | None = None) -> DataFrame:
    """All pairs of 64-bit signatures at most ``threshold`` bits apart: (a, b, distance), a < b.

    Of ``blocks`` blocks, ``threshold`` different bits leave at least ``blocks - threshold`` untouched, so two such
    signatures agree in every bit of some choice of that many blocks: an equi-join on (choice, those bits). More blocks
    make keys longer and choices more; their number grows with the signatures (``block_count``), which keeps the
    candidates of a signature about level. Each pair is kept once, in the choice of the first blocks that agree.
    """
    # counted and read by both sides: signatures are computed once
    df = cut(df.select(key, signature).where(F.col(signature).isNotNull()), "signatures")
    blocks = blocks or block_count(df.count(), threshold)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    apart = F.col("sa").bitwiseXOR(F.col("sb"))
    agree = reduce(lambda x, y: x + y, (F.when(F.shiftrightunsigned(apart, edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1).cast("long")) == 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(blocks)))
    found = near_candidates(df, key, signature, threshold, blocks).where(hamming(F.col("sa"), F.col("sb")) <= threshold)
    return found.where(agree.bitwiseAND(F.col("through")) == F.col("chosen")).select("a", "b", hamming(F.col("sa"), F.col("sb")).alias("distance"))


def near_classes(df: DataFrame, key: str, signature: str) -> DataFrame:
    """Each row's class: (key, representative, s), where rows of one signature are a class named by its smallest key."""
    rows = df.select(F.col(key).alias("key"), F.col(signature).alias("s")).where("s IS NOT NULL")
    rows = cut(rows, "signed")
    # a row for each signature: too many for the driver to send around
    return rows.join(rows.groupBy("s").agg(F.min("key").alias("representative")).hint("merge"), "s").select("key", "representative", "s")


def near_class_pairs(classes: DataFrame, threshold: int = 10, blocks: int | None = None) -> DataFrame:
    """Pairs of different classes at most ``threshold`` bits apart: (a, b, distance) by representative.

    Copies of a signature are one row here, so their number does not enter the join; with the classes' members, no link
    between different signatures is lost.
    """
    return near_pairs(classes.where("key = representative").dropDuplicates(["representative"]), "representative", "s", threshold, blocks)


def similarity_band(confidence: Column) -> Column:
    """Severity of a confidence."""
    return F.when(confidence >= 0.85, "HIGH").when(confidence >= 0.70, "MEDIUM").otherwise("LOW")


def near_findings(pairs: DataFrame) -> DataFrame:
    """Pairs with their confidence and severity, as findings on the first member."""
    confidence = F.round(1 - F.col("distance") / 64, 2)
    evidence = F.array(F.concat(F.lit("phash_distance="), F.col("distance").cast("string")), F.concat(F.lit("matched_sample="), F.col("b").cast("string")))
    return findings(pairs, "NEAR_DUPLICATE", "sample", F.col("a").cast("string"), similarity_band(confidence), confidence, F.lit("Two samples look nearly alike."), evidence, evidence)


def minus_exact(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Near pairs without those whose members have equal content; ``hashes``: (key, content_hash)."""
    a, b = hashes.selectExpr("key AS a", "content_hash AS ha"), hashes.selectExpr("key AS b", "content_hash AS hb")
    return pairs.join(a, "a", "left").join(b, "b", "left").where("ha IS NULL OR hb IS NULL OR ha != hb").drop("ha", "hb")


def label_counts(samples: DataFrame, sample: str, label: str) -> DataFrame:
    """In how many samples each label occurs; ``samples`` has a row for each label of a sample."""
    return samples.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.countDistinct(sample).alias("n"))


def rare_labels(samples: DataFrame, sample: str, label: str, least: int = 2) -> DataFrame:
    """Labels in fewer than ``least`` samples, as findings on ``label:<name>``."""
    rare = label_counts(samples, sample, label).where(F.col("n") < least)
    evidence = F.array(F.concat(F.lit("label="), "label"), F.concat(F.lit("label_count="), F.col("n").cast("string")))
    return findings(rare, "LABEL_ANOMALY", "dataset", F.concat(F.lit("label:"), "label"), F.lit("MEDIUM"), F.lit(0.75), F.lit("A label is unusually rare."), evidence, evidence)


def mean_vector(df: DataFrame, vector: str, segment: tuple[str, ...] = ()) -> DataFrame:
    """Mean of a vector column by segment, as an array."""
    parts = df.select(*segment, F.posexplode(vector).alias("pos", "x")).groupBy(*segment, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(*segment).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"))


def outlier_scores(df: DataFrame, key: str, vector: str, segment: tuple[str, ...] = ()) -> DataFrame:
    """1 - cosine to the segment's mean vector, to 6 places; a vector or mean without length is an error."""
    centre = mean_vector(df, vector, segment)
    joined = df.join(centre, list(segment)) if segment else df.crossJoin(F.broadcast(centre))
    size = norm(F.col(vector)) * norm(F.col("centre"))
    checked = F.when(size > 0, size).otherwise(F.raise_error(F.lit("zero vector")).cast("double"))
    return joined.select(*segment, F.col(key), F.round(1 - dot(F.col(vector), F.col("centre")) / checked, 6).alias("score"))


def outlier_threshold(scores: DataFrame, score: str = "score", segment: tuple[str, ...] = (), policy: OutlierPolicy = OutlierPolicy()) -> DataFrame:
    """Threshold by segment: median and scaled MAD, but at least the upper percentile; none below the least support.

    A policy with a ``fixed`` threshold takes that, whatever the scores are.
    """
    top = policy.percentile / 100
    first = with_quantiles(scores, segment, F.col(score), {"median": 0.5, "upper": top}, F.count(score).alias("n"))
    near = scores.join(first.select(*segment, "median"), list(segment)) if segment else scores.crossJoin(F.broadcast(first.select("median")))
    second = with_quantiles(near, segment, F.abs(F.col(score) - F.col("median")), {"mad": 0.5})
    both = first.join(second, list(segment)) if segment else first.crossJoin(F.broadcast(second))
    if policy.fixed is not None:
        return both.withColumn("method", F.lit("fixed")).withColumn("threshold", F.lit(float(policy.fixed)))
    robust = F.col("median") + policy.multiplier * policy.scale * F.col("mad")
    method = F.when(F.col("n") == 0, "empty").when(F.col("n") < policy.least, "insufficient").when(F.col("mad") == 0, "percentile").otherwise("mad")
    return both.withColumn("method", method).withColumn("threshold", F.when(F.col("method") == "mad", F.round(F.greatest(robust, "upper"), 6)).when(F.col("method") == "percentile", F.round("upper", 6)))


def outliers(scores: DataFrame, thresholds: DataFrame, segment: tuple[str, ...] = ()) -> DataFrame:
    """Scores at or above their threshold, with confidence and severity."""
    joined = scores.join(thresholds.select(*segment, "threshold", "n"), list(segment)) if segment else scores.crossJoin(F.broadcast(thresholds.select("threshold", "n")))
    excess = (F.col("score") - F.col("threshold")) / F.greatest(F.lit(0.05), 1 - F.col("threshold"))
    confidence = F.round(F.least(F.lit(1.0), excess * F.least(F.lit(1.0), F.col("n") / 20)), 2)
    return joined.where("score >= threshold").withColumn("confidence", confidence).withColumn("severity", similarity_band(F.col("confidence")))


def bind_source(found: DataFrame, samples: DataFrame) -> DataFrame:
    """Findings on known samples with contributor and batch added to their evidence and a new id."""
    joined = found.join(samples.select(F.col("sample_id").alias("asset_id"), "contributor_id", "batch_id"), "asset_id", "left")
    extra = F.filter(F.array(F.concat(F.lit("contributor_id="), "contributor_id"), F.concat(F.lit("batch_id="), "batch_id")), lambda x: x.isNotNull())
    evidence = F.array_distinct(F.concat("evidence", extra))
    renewed = F.when(F.size(extra) > 0, finding_id(F.col("module"), F.col("category"), F.col("asset_id"), evidence)).otherwise(F.col("finding_id"))
    return joined.withColumn("finding_id", renewed).withColumn("evidence", evidence).select(*found.columns)


def contributor_risk(found: DataFrame, samples: DataFrame) -> DataFrame:
    """Per contributor: findings on its samples, their average confidence, and its batches."""
    joined = found.join(samples.selectExpr("sample_id AS asset_id", "contributor_id", "batch_id"), "asset_id").where("contributor_id IS NOT NULL")
    return joined.groupBy("contributor_id").agg(F.count("*").alias("finding_count"), F.round(F.avg("confidence"), 2).alias("average_confidence"), F.array_join(F.array_sort(F.collect_set("batch_id")), ",").alias("batches"))


def risk_band(score: Column) -> Column:
    return F.when(score == 0, "NONE").when(score < 20, "LOW").when(score < 50, "MEDIUM").when(score < 75, "HIGH").otherwise("CRITICAL")


def dataset_risk(found: DataFrame, segment: tuple[str, ...] = ()) -> DataFrame:
    """Risk score: the worst weight x confidence of each event (category, asset, evidence), summed up to 100."""
    weight = F.coalesce(*(F.when(F.col("severity") == s, F.lit(w)) for s, w in RISK_WEIGHT.items()), F.raise_error(F.concat(F.lit("unknown severity "), F.coalesce("severity", F.lit("null")))).cast("double"))
    events = found.groupBy(*segment, "category", "asset_id", F.array_sort("evidence").alias("e")).agg(F.max(weight * F.col("confidence")).alias("w"), F.count("*").alias("k"))
    total = events.groupBy(*segment).agg(F.round(F.least(F.lit(100.0), F.coalesce(F.sum("w"), F.lit(0.0))), 2).alias("risk_score"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("finding_count"), F.count("*").alias("event_count"))
    return total.withColumn("risk_band", risk_band(F.col("risk_score")))


def rollup(found: DataFrame) -> DataFrame:
    """Counts by category, by severity and in total, in one pass."""
    grouped = found.groupingSets([["category"], ["severity"], []], "category", "severity").agg(F.count("*").alias("n"), F.count_distinct("finding_id").alias("n_distinct"))
    return grouped


def stable(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` findings by id, with whether more were left out."""
    total = found.agg(F.count("*").alias("_total"))
    return found.orderBy("finding_id").limit(most).crossJoin(F.broadcast(total)).withColumn("partial", F.col("_total") > most).drop("_total")
