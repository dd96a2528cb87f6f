"""Comparison of a reference and a current window by effect sizes, per segment and feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.columns import public
from proofline.functions.policies import ComparisonPolicy

POLICY = ComparisonPolicy()


def side_by_side(profiles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Profiles with a role column REFERENCE or CURRENT as one row per key: structs ``r`` and ``c``, null where absent."""
    rest = [c for c in profiles.columns if c not in (*keys, "role")]
    at = lambda role: F.first(F.when(F.col("role") == role, F.struct(*rest)), ignorenulls=True)
    return profiles.groupBy(*keys).agg(at("REFERENCE").alias("r"), at("CURRENT").alias("c"))


def divergences(counts: DataFrame, keys: tuple[str, ...], bucket: str, bins: int | None = None) -> DataFrame:
    """Jensen-Shannon (base 2), total variation and, for ordered bins, Wasserstein distance by key.

    ``counts``: (keys..., role, bucket, n). Both sides' counts are put next to each other by one aggregation, where a
    bucket that one side lacks counts as 0; totals and running sums are windows over buckets. Null for an empty side.
    """
    n = lambda role: F.sum(F.when(F.col("role") == role, F.col("n")).otherwise(0)).cast("double")
    both = counts.groupBy(*keys, bucket).agg(n("REFERENCE").alias("a"), n("CURRENT").alias("b"))
    whole = Window.partitionBy(*keys)
    shares = both.withColumns({"ta": F.sum("a").over(whole), "tb": F.sum("b").over(whole)}).withColumns({"p": F.try_divide("a", "ta"), "q": F.try_divide("b", "tb")})
    shares = shares.withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(F.when(F.col(x).isNotNull(), 0.0))
    js = F.sum((part("p") + part("q")) / 2)
    found = [F.when(js.isNotNull(), public(F.least(F.lit(1.0), F.greatest(F.lit(0.0), js)))).alias("js"), public(F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv")]
    if bins:
        # a bin absent on both sides keeps the running difference, so each bin counts for the gap up to the next
        order = whole.orderBy(bucket)
        shares = shares.withColumn("_d", F.abs(F.sum(F.col("p") - F.col("q")).over(order.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("_w", F.lead(bucket, 1, bins).over(order) - F.col(bucket))
        found.append(public(F.sum(F.col("_d") * F.col("_w")) / bins).alias("wasserstein"))
    return shares.groupBy(*keys).agg(*found)


def constant_shift(r: str = "r", c: str = "c", epsilon: float = POLICY.epsilon) -> Column:
    """Both sides are constant, at different values."""
    return (F.col(f"{r}.std") <= epsilon) & (F.col(f"{c}.std") <= epsilon) & (F.abs(F.col(f"{c}.mean") - F.col(f"{r}.mean")) > epsilon)


def smd(r: str = "r", c: str = "c", epsilon: float = POLICY.epsilon) -> Column:
    """Standardised mean difference over the pooled deviation; 0 for equal constants, null for different ones."""
    pooled = F.sqrt((F.col(f"{r}.std") ** 2 + F.col(f"{c}.std") ** 2) / 2)
    gap = F.abs(F.col(f"{c}.mean") - F.col(f"{r}.mean"))
    return F.when(pooled > epsilon, public(gap / pooled)).when(gap <= epsilon, F.lit(0.0))


def quantile_shift(r: str = "r", c: str = "c", epsilon: float = POLICY.epsilon) -> Column:
    """The largest move of a quantile over the wider 5-95 % range."""
    moves = F.greatest(*(F.abs(F.col(f"{c}.{q}") - F.col(f"{r}.{q}")) for q in ("q05", "q25", "median", "q75", "q95")))
    width = F.greatest(F.col(f"{r}.q95") - F.col(f"{r}.q05"), F.col(f"{c}.q95") - F.col(f"{c}.q05"))
    return F.when(width > epsilon, public(moves / width)).when(moves <= epsilon, F.lit(0.0))


def median_change(r: str = "r", c: str = "c", epsilon: float = POLICY.epsilon) -> Column:
    """Symmetric relative change of the median, 0 to 2."""
    a, b = F.col(f"{r}.median"), F.col(f"{c}.median")
    size = F.abs(a) + F.abs(b)
    return F.when(size > epsilon, public(F.least(F.lit(2.0), 2 * F.abs(b - a) / size))).otherwise(F.lit(0.0))


def direction(r: str = "r", c: str = "c", epsilon: float = POLICY.epsilon) -> Column:
    d = F.col(f"{c}.median") - F.col(f"{r}.median")
    return F.when(F.abs(d) <= epsilon, "SAME").when(d > 0, "INCREASED").otherwise("DECREASED")


def metric(name: str, value: Column, threshold: float) -> Column:
    """A metric record: exceeded when at least its threshold, null without a value."""
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(threshold).alias("threshold"), (value >= threshold).alias("exceeded"))


def valid_summary(side: str) -> Column:
    """A summary is finite, in order and not negative in spread."""
    q = [F.col(f"{side}.{x}") for x in ("minimum", "q05", "q25", "median", "q75", "q95", "maximum")]
    ordered = F.lit(True)
    for a, b in zip(q, q[1:]):
        ordered = ordered & (a <= b)
    return F.coalesce(ordered & (F.col(f"{side}.std") >= 0) & (F.abs(F.col(f"{side}.mean")) < float("inf")), F.lit(False))


def gate(policy: ComparisonPolicy = POLICY) -> Column:
    """Why two sides can't be compared, or null: a side absent, an invalid summary, too little support."""
    return (
        F.when(F.col("r").isNull() | F.col("c").isNull(), "UNAVAILABLE")
        .when(~valid_summary("r") | ~valid_summary("c"), "INCOMPARABLE")
        .when((F.col("r.count") < policy.support) | (F.col("c.count") < policy.support), "INSUFFICIENT")
    )


def continuous(profiles: DataFrame, keys: tuple[str, ...], distances: DataFrame | None = None, policy: ComparisonPolicy = POLICY) -> DataFrame:
    """Numeric features: SHIFTED on a constant shift or when two metrics exceed; histogram distances count where given."""
    both = side_by_side(profiles, keys)
    metrics = [metric("smd", smd(), policy.smd), metric("quantile", quantile_shift(), policy.quantile), metric("median", median_change(), policy.median)]
    if distances is not None:
        both = both.join(distances, list(keys), "left")
        metrics += [metric(n, F.col(n), t) for n, t in (("js", policy.js), ("tv", policy.tv), ("wasserstein", policy.wasserstein))]
    found = both.withColumn("metrics", F.array(*metrics)).withColumn("blocked", gate(policy))
    exceeded = F.size(F.filter("metrics", lambda m: F.coalesce(m["exceeded"], F.lit(False))))
    state = F.coalesce(F.col("blocked"), F.when(F.coalesce(constant_shift(), F.lit(False)) | (exceeded >= 2), "SHIFTED").otherwise("STABLE"))
    return found.withColumn("exceeded", exceeded).withColumn("state", state).withColumn("direction", direction()).drop("blocked")


def categorical(counts: DataFrame, keys: tuple[str, ...], bucket: str = "value", policy: ComparisonPolicy = POLICY) -> DataFrame:
    """Categorical features: SHIFTED when both Jensen-Shannon and total variation exceed."""
    support = counts.groupBy(*keys).agg(*(F.sum(F.when(F.col("role") == role, F.col("n")).otherwise(0)).alias(name) for role, name in (("REFERENCE", "n_ref"), ("CURRENT", "n_cur"))))
    found = support.join(divergences(counts, keys, bucket), list(keys))
    blocked = F.when((F.col("n_ref") == 0) | (F.col("n_cur") == 0), "UNAVAILABLE").when((F.col("n_ref") < policy.support) | (F.col("n_cur") < policy.support), "INSUFFICIENT")
    shifted = (F.col("js") >= policy.js) & (F.col("tv") >= policy.tv)
    return found.withColumn("state", F.coalesce(blocked, F.when(shifted, "SHIFTED").otherwise("STABLE"))).withColumn("direction", F.when(F.col("tv") > policy.epsilon, "MIXED").otherwise("SAME"))


def report(states: DataFrame, segment: tuple[str, ...]) -> DataFrame:
    """Features by state, status, limitations and a content id for each segment; ``states``: (segment..., feature, state)."""
    of = lambda *s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("state").isin(*s), F.col("feature")))), ",")
    known = F.count_if(F.col("state").isin("SHIFTED", "STABLE"))
    found = states.groupBy(*segment).agg(of("SHIFTED").alias("shifted"), of("STABLE").alias("stable"), of("UNAVAILABLE", "INCOMPARABLE", "INSUFFICIENT").alias("not_assessed"), known.alias("k"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("state").isin("SHIFTED", "STABLE"), F.concat(F.lit("FEATURE_"), "state")))), ",").alias("limitations"))
    status = F.when(F.col("k") == 0, "UNAVAILABLE").when(F.col("k") < F.col("n"), "PARTIAL").otherwise("COMPLETE")
    return found.withColumn("status", status).withColumn("report_id", F.sha2(F.concat_ws("|", "shifted", "stable", "not_assessed", "status"), 256)).drop("k", "n")


#: What two windows of vectors, or of predictions, have to agree in, and the code where they don't.
VECTOR_SPACE = {"dimension": "REPRESENTATION_DIMENSION_MISMATCH", "space_id": "REPRESENTATION_SPACE_MISMATCH"}
OUTPUT_SPACE = {"space_id": "OUTPUT_SPACE_MISMATCH"}
#: The limitation that a partial window leaves, and the features of a report in order.
VECTOR_PARTIAL, OUTPUT_PARTIAL = "INPUT_REPRESENTATION_PROFILE_PARTIAL", "INPUT_PREDICTION_PROFILE_PARTIAL"
VECTOR_FEATURES = ("REPRESENTATION_CENTROID", "REPRESENTATION_DISPERSION", "REPRESENTATION_VARIANCE", "REPRESENTATION_MMD", "REPRESENTATION_SUPPORT_DISTANCE")
OUTPUT_FEATURES = ("PREDICTED_LABEL_DISTRIBUTION", "TOP1_CONFIDENCE", "PREDICTION_ENTROPY", "TOP1_MARGIN", "ABSTENTION_RATE", "DECLARED_UNKNOWN_RATE")


def comparability(windows: DataFrame, keys: tuple[str, ...], space: dict[str, str], version: int = 1, policy: ComparisonPolicy = POLICY, partial_code: str = "INPUT_PROFILE_PARTIAL") -> DataFrame:
    """Per key, whether its two windows can be compared: ``state`` with ``limitations``.

    ``windows``: keys, role, schema_version, status, samples and the columns of ``space``. INCOMPARABLE for a role that
    is unknown or given twice, another schema version or another space; UNAVAILABLE where a side is absent or without
    a usable sample; PARTIAL below the least support or for a partial window; else COMPLETE. The first rule decides
    the terminal states; limitations of PARTIAL are listed in order.
    """
    role = F.col("role")
    side = lambda name: F.max(F.when(role == name, F.struct("schema_version", "status", "samples", *space)))
    wrong = F.count("*") > F.countDistinct(F.when(role.isin("REFERENCE", "CURRENT"), role))
    both = windows.groupBy(*keys).agg(side("REFERENCE").alias("r"), side("CURRENT").alias("c"), wrong.alias("_wrong"))
    either = lambda test: test("r") | test("c")
    end = F.when(F.col("_wrong"), "ROLE_INVALID")
    end = end.when(either(lambda s: F.col(s).isNotNull() & ~F.col(f"{s}.schema_version").eqNullSafe(F.lit(version))), "PROFILE_SCHEMA_INCOMPATIBLE")
    end = end.when(either(lambda s: F.col(s).isNull() | F.coalesce(F.col(f"{s}.status") == "UNAVAILABLE", F.lit(True))), "INPUT_PROFILE_UNAVAILABLE")
    for column, code in space.items():
        end = end.when(~F.col(f"r.{column}").eqNullSafe(F.col(f"c.{column}")), code)
    few = either(lambda s: F.coalesce(F.col(f"{s}.samples"), F.lit(0)) < policy.support)
    partial = either(lambda s: F.col(f"{s}.status") == "PARTIAL")
    notes = F.array_compact(F.array(F.when(few, "INSUFFICIENT_SAMPLE_SUPPORT"), F.when(partial, partial_code)))
    found = both.withColumn("_end", end).withColumn("limitations", F.when(F.col("_end").isNull(), F.array_join(notes, ",")).otherwise(F.col("_end")))
    state = F.when(F.col("_end") == "INPUT_PROFILE_UNAVAILABLE", "UNAVAILABLE").when(F.col("_end").isNotNull(), "INCOMPARABLE").when(F.col("limitations") != "", "PARTIAL").otherwise("COMPLETE")
    return found.select(*keys, state.alias("state"), "limitations")


def layer_report(gates: DataFrame, features: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], missing: dict[str, str] | None = None) -> DataFrame:
    """One report for each pair of windows: status, features by state, what each of them could not say, and an id.

    ``gates``: what ``comparability`` gives. ``features``: keys, feature, state (SHIFTED, STABLE, or what else it is),
    limitations (array). Windows that can't be compared have every feature of ``order`` in the gate's state; below the
    least support every feature is PARTIAL; a feature without a row is UNAVAILABLE with its code in ``missing``, else
    FEATURE_NOT_SUPPLIED. Limitations of the windows and of measured features are those of the report.
    """
    codes = {f: (missing or {}).get(f, "FEATURE_NOT_SUPPLIED") for f in order}
    asked = gates.select(*keys, F.col("state").alias("_gate"), F.col("limitations").alias("_notes"), F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), F.lit(f).alias("feature"), F.lit(codes[f]).alias("_code")) for i, f in enumerate(order)))).alias("_f"))
    asked = asked.select(*keys, "_gate", "_notes", "_f.*")
    joined = asked.join(features.select(*keys, "feature", "state", F.coalesce("limitations", F.array().cast("array<string>")).alias("_own")), [*keys, "feature"], "left")
    ended, few = F.col("_gate").isin("INCOMPARABLE", "UNAVAILABLE"), F.col("_notes").contains("INSUFFICIENT_SAMPLE_SUPPORT")
    state = F.when(ended, F.col("_gate")).when(few, "PARTIAL").otherwise(F.coalesce("state", F.lit("UNAVAILABLE")))
    own = F.when(ended, F.array("_notes")).when(few, F.array(F.lit("INSUFFICIENT_SAMPLE_SUPPORT"))).when(F.col("state").isNull(), F.array("_code")).otherwise(F.col("_own"))
    measured = F.when(~ended & ~few & F.col("state").isNotNull(), F.col("_own")).otherwise(F.array().cast("array<string>"))
    rows = joined.select(*keys, "_i", "feature", state.alias("state"), own.alias("_own"), measured.alias("_measured"), "_gate", "_notes")
    of = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("state") == s, F.struct("_i", "feature")))), lambda x: x["feature"])
    known = ("SHIFTED", "STABLE", "PARTIAL", "UNAVAILABLE", "INCOMPARABLE")
    notes = F.filter(F.split(F.first("_notes"), ","), lambda x: x != "")
    summed = rows.groupBy(*keys).agg(
        F.first("_gate").alias("_gate"),
        *(of(s).alias(s.lower()) for s in known),
        F.array_sort(F.array_distinct(F.concat(notes, F.flatten(F.collect_list("_measured"))))).alias("limitations"),
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "feature", F.array_sort("_own").alias("limitations")))), lambda x: F.concat(x["feature"], F.lit(":"), F.array_join(x["limitations"], "+"))).alias("feature_limitations"),
    )
    degraded = (F.size("limitations") > 0) | (F.size("partial") + F.size("unavailable") + F.size("incomparable") > 0)
    status = F.when(F.col("_gate").isin("INCOMPARABLE", "UNAVAILABLE"), F.col("_gate")).when(degraded, "PARTIAL").otherwise("COMPLETE")
    whole = summed.withColumn("status", status).drop("_gate")
    said = F.concat_ws("|", "status", *(F.array_join(s.lower(), ",") for s in known), F.array_join("limitations", ","), F.array_join("feature_limitations", ","))
    return whole.withColumn("report_id", F.sha2(said, 256))
