"""Model integrity over tensor, graph and run tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.columns import dot, finding_id, finite, let, norm
from proofline.functions.policies import ISSUE_FINDINGS, PENALTY, BehaviourPolicy, TensorPolicy
from proofline.operators import profile
from proofline.operators.quantiles import with_quantiles
from proofline.operators.relational import named_diff

TENSOR = TensorPolicy()
RUNS = BehaviourPolicy()


def tensor_stats(values: DataFrame, keys: tuple[str, ...] = ("model_id", "tensor"), value: str = "value", policy: TensorPolicy = TENSOR) -> DataFrame:
    """Statistics of each tensor over its finite values, and how many are not.

    ``values`` has a row per element. Squares are taken over the largest magnitude, so they can't overflow; the
    median absolute deviation is a second aggregation against the median.
    """
    x = F.col(value)
    ok = F.when(finite(x), x)
    first = with_quantiles(
        values, keys, ok, {"median": 0.5},
        F.count("*").alias("elements"),
        F.count(ok).alias("n_finite"),
        F.count_if(F.isnan(x)).alias("n_nan"),
        F.count_if(x == float("inf")).alias("n_posinf"),
        F.count_if(x == float("-inf")).alias("n_neginf"),
        F.min(ok).alias("minimum"),
        F.max(ok).alias("maximum"),
        F.avg(ok).alias("mean"),
        F.stddev_pop(ok).alias("std"),
        F.max(F.abs(ok)).alias("abs_max"),
        F.sum(F.abs(ok)).alias("l1"),
        F.count_if(ok == 0).alias("_zero"),
        F.count_if(F.abs(ok) <= policy.near_zero).alias("_near"),
    )
    scaled = F.when(F.col("abs_max") > 0, ok / F.col("abs_max")).otherwise(F.when(ok.isNotNull(), 0.0))
    second = with_quantiles(values.join(first.select(*keys, "abs_max", "median"), list(keys)), keys, F.abs(ok - F.col("median")), {"mad": 0.5}, F.sum(scaled * scaled).alias("_s"))
    l2 = F.col("abs_max") * F.sqrt("_s")
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n_finite").cast("double"))
    return first.join(second, list(keys)).withColumns({"l2": l2, "rms": F.try_divide(l2, F.sqrt("n_finite")), "zero_fraction": share("_zero"), "near_zero_fraction": share("_near")}).drop("_zero", "_near", "_s")


def value_issues(stats: DataFrame, policy: TensorPolicy = TENSOR) -> DataFrame:
    """Issues of values as rows of ``stats``' keys with ``code`` and ``severity``."""
    usable = F.col("n_finite") == F.col("elements")
    flat = usable & (F.col("minimum") == F.col("maximum"))
    issue = lambda cond, code, severity: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    zero = usable & (F.col("abs_max") == 0) & (F.col("elements") > 0)
    found = F.array_compact(
        F.array(
            issue(F.col("n_nan") > 0, "PARAMETER_NAN", "HIGH"),
            issue(F.col("n_posinf") > 0, "PARAMETER_POSITIVE_INFINITY", "HIGH"),
            issue(F.col("n_neginf") > 0, "PARAMETER_NEGATIVE_INFINITY", "HIGH"),
            issue(zero, "ALL_ZERO_TENSOR", "MEDIUM"),
            issue(flat & ~zero & (F.col("elements") > 1), "CONSTANT_TENSOR", "LOW"),
            issue(~zero & (F.col("zero_fraction") >= policy.zero_fraction), "EXTREME_ZERO_FRACTION", "LOW"),
        )
    )
    keep = [c for c in ("model_id", "tensor") if c in stats.columns]
    return stats.select(*keep, F.explode(found).alias("i")).select(*keep, F.lit(None).cast("long").alias("channel"), "i.*")


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    return F.when(mad > 0, 0.6745 * (x - median) / mad).otherwise(0.0)


def channel_norms(channels: DataFrame, vector: str = "values") -> DataFrame:
    """Norm of each channel with its tensor's median and MAD, robust z and ratio; ``channels``: (model_id, tensor, channel, values)."""
    keys = ["model_id", "tensor"]
    sized = channels.select(*keys, "channel", norm(F.col(vector)).alias("l2"))
    middle = sized.groupBy(*keys).agg(F.percentile("l2", F.lit(0.5)).alias("median"), F.count("*").alias("n_channels"))
    spread = sized.join(middle, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("l2") - F.col("median")), F.lit(0.5)).alias("mad"))
    rows = sized.join(middle.join(spread, keys), keys)
    ratio = F.when(F.col("median") > 0, F.col("l2") / F.col("median")).when(F.col("l2") == 0, 0.0).otherwise(float("inf"))
    return rows.withColumns({"robust_z": robust_z(F.col("l2"), F.col("median"), F.col("mad")), "ratio": ratio})


def channel_issues(norms: DataFrame, policy: TensorPolicy = TENSOR) -> DataFrame:
    """Dead, outlying and extremely scaled channels."""
    issue = lambda cond, code, severity: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    dead = F.col("l2") == 0
    found = F.array_compact(F.array(issue(dead, "DEAD_CHANNEL", "MEDIUM"), issue(~dead & (F.abs("robust_z") >= policy.channel_z), "CHANNEL_NORM_OUTLIER", "MEDIUM"), issue(F.col("ratio") >= policy.ratio, "EXTREME_CHANNEL_SCALE", "HIGH")))
    return norms.where("n_channels >= 2").select("model_id", "tensor", F.col("channel").cast("long").alias("channel"), F.explode(found).alias("i")).select("model_id", "tensor", "channel", "i.*")


def energy(norms: DataFrame, policy: TensorPolicy = TENSOR) -> DataFrame:
    """Share of a tensor's energy in its strongest channel and in its top few, and whether that is concentrated."""
    order = Window.partitionBy("model_id", "tensor").orderBy(F.col("e").desc(), "channel")
    ranked = norms.withColumn("e", F.col("l2") * F.col("l2")).withColumn("_r", F.row_number().over(order))
    top = lambda k: F.try_divide(F.sum(F.when(F.col("_r") <= k, F.col("e"))), F.sum("e"))
    found = ranked.groupBy("model_id", "tensor").agg(top(1).alias("top1"), top(policy.top).alias("topk"), F.count("*").alias("n_channels"))
    return found.withColumn("concentrated", F.coalesce((F.col("top1") >= policy.energy) & (F.col("n_channels") >= 4), F.lit(False)))


def peer_scale(stats: DataFrame, policy: TensorPolicy = TENSOR) -> DataFrame:
    """Tensors whose RMS stands out among at least three peers of equal rank and type; ``stats`` also has (rank, dtype)."""
    peers = stats.where("elements >= 16 AND rms IS NOT NULL")
    middle = peers.groupBy("model_id", "rank", "dtype").agg(F.percentile("rms", F.lit(0.5)).alias("_m"), F.count("*").alias("n_peers")).where("n_peers >= 3")
    joined = peers.join(middle, ["model_id", "rank", "dtype"])
    spread = joined.groupBy("model_id", "rank", "dtype").agg(F.percentile(F.abs(F.col("rms") - F.col("_m")), F.lit(0.5)).alias("_d"))
    z = robust_z(F.col("rms"), F.col("_m"), F.col("_d"))
    return joined.join(spread, ["model_id", "rank", "dtype"]).withColumn("robust_z", z).withColumn("is_outlier", F.abs(F.col("robust_z")) >= policy.tensor_z).select("model_id", "tensor", "n_peers", "rms", "robust_z", "is_outlier")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == s, F.lit(i)) for i, s in enumerate(PENALTY)), F.lit(-1))


def bounded_issues(issues: DataFrame, policy: TensorPolicy = TENSOR) -> DataFrame:
    """At most so many issues per tensor, then per model, the severest first, with whether the model had more."""
    order = (severity_rank(F.col("severity")).desc(), F.col("code"), F.col("channel").asc_nulls_first())
    per = issues.withColumn("_r", F.row_number().over(Window.partitionBy("model_id", "tensor").orderBy(*order)))
    kept = per.where(F.col("_r") <= policy.per_tensor)
    total = issues.groupBy("model_id").agg(F.count("*").alias("_all"))
    ranked = kept.withColumn("_t", F.row_number().over(Window.partitionBy("model_id").orderBy(*order[:2], "tensor", order[2]))).where(F.col("_t") <= policy.in_total)
    left = ranked.groupBy("model_id").agg(F.count("*").alias("_kept"))
    return ranked.join(total, "model_id").join(left, "model_id").withColumn("truncated", F.col("_all") > F.col("_kept")).drop("_r", "_t", "_all", "_kept")


def commitments(channels: DataFrame, vector: str = "values") -> DataFrame:
    """A hash of each tensor's values, over its channels by number, and one fingerprint of each model over its tensors."""
    row = F.sha2(F.array_join(F.transform(vector, lambda x: F.format_string("%.12e", x.cast("double"))), ","), 256)
    placed = channels.select("model_id", "tensor", F.concat_ws(":", F.col("channel").cast("string"), row).alias("_row"))
    hashed = profile.commitment(placed, ("model_id", "tensor"), F.col("_row")).withColumnRenamed("commitment", "value_sha256").drop("samples")
    whole = profile.commitment(hashed, ("model_id",), F.concat_ws(":", "tensor", "value_sha256")).withColumnRenamed("commitment", "model_fingerprint").drop("samples")
    return hashed.join(whole, "model_id")


def tensor_modes(tensors: DataFrame, single: int, total: int) -> DataFrame:
    """Whether each tensor (model_id, tensor, position, elements, bytes) is read FULL or SAMPLED.

    Tensors are taken by position: one is FULL when it holds at most ``single`` bytes and the model's budget of
    ``total`` bytes still covers it, which it then uses up. The list of a model's tensors (not of their values) is
    walked in one value.
    """
    sizes = F.array_sort(F.collect_list(F.struct("position", "tensor", "bytes")))
    start = F.struct(F.lit(total).cast("long").alias("left"), F.array().cast("array<string>").alias("full"))
    fits = lambda s, t: (t["bytes"] <= single) & (t["bytes"] <= s["left"])
    step = lambda s, t: F.when(fits(s, t), F.struct((s["left"] - t["bytes"]).alias("left"), F.array_append(s["full"], t["tensor"]).alias("full"))).otherwise(s)
    walked = tensors.groupBy("model_id").agg(F.aggregate(sizes, start, step)["full"].alias("_full"))
    return tensors.join(walked, "model_id").withColumn("mode", F.when(F.array_contains("_full", F.col("tensor")), "FULL").otherwise("SAMPLED")).drop("_full")


def sampled_values(values: DataFrame, modes: DataFrame, most: int) -> DataFrame:
    """The values (model_id, tensor, pos from 0, value) of FULL tensors, and at most ``most`` even ones of SAMPLED ones.

    The first and last are among them. Whether a position is taken follows from it and the tensor's size alone, so
    nothing is ranked: step k falls on floor(k (elements - 1) / (most - 1)).
    """
    joined = values.join(modes.select("model_id", "tensor", "elements", "mode"), ["model_id", "tensor"])
    if most == 1:
        taken = F.col("pos") == 0
    else:
        k = F.expr(f"(pos * {most - 1}L + elements - 2) div (elements - 1)")
        taken = F.expr(f"(_k * (elements - 1)) div {most - 1}L") == F.col("pos")
        joined = joined.withColumn("_k", F.when(F.col("elements") > 1, k))
    return joined.where((F.col("mode") == "FULL") | (F.col("elements") <= most) | taken).drop("_k")


def parameter_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tensors by name that were added, removed, or changed in type, shape or values; columns name, dtype, shape, value_sha256."""
    diff = named_diff(before, after, ("name",), ("dtype", "shape", "value_sha256"))
    kind = F.when(F.col("change") != "CHANGED", F.col("change")).when(F.array_contains("columns", "dtype"), "DTYPE_CHANGED").when(F.array_contains("columns", "shape"), "SHAPE_CHANGED").otherwise("VALUE_CHANGED")
    return diff.select("name", kind.alias("change"))


def issue_deltas(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("code", "tensor", "channel")) -> DataFrame:
    """Issues by their identity: NEW, RESOLVED or PERSISTING."""
    marked = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).union(after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a")))
    both = marked.groupBy(*keys).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return both.select(*keys, F.when(F.col("b") == 0, "NEW").when(F.col("a") == 0, "RESOLVED").otherwise("PERSISTING").alias("delta"))


def structure_issues(nodes: DataFrame, approved: tuple[str, ...], domains: tuple[str, ...] = ("", "ai.onnx", "ai.onnx.ml")) -> DataFrame:
    """Rules on graph nodes (model_id, op_type, domain): custom domains and operators outside the approved set."""
    custom = nodes.where(~F.coalesce("domain", F.lit("")).isin(*domains)).select("model_id", F.lit("CUSTOM_OPERATOR_DOMAIN").alias("code"), F.col("domain").alias("subject"))
    other = nodes.where(~F.col("op_type").isin(*approved)).select("model_id", F.lit("OPERATOR_NOT_APPROVED").alias("code"), F.col("op_type").alias("subject"))
    return custom.union(other).groupBy("model_id", "code", "subject").agg(F.count("*").alias("n"))


def external_location(location: Column) -> Column:
    """Whether the path of external tensor data is MISSING, UNSAFE (may leave the model's folder) or only NOT_VERIFIED; null: none.

    Percent escapes are read once, and a backslash separates like a slash.
    """
    plain = F.translate(F.coalesce(F.try_url_decode(F.replace(location, F.lit("+"), F.lit("%2B"))), location), "\\", "/")
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    drive = F.coalesce(F.get(parts, F.lit(0)).endswith(":"), F.lit(False))
    unsafe = plain.startswith("/") | F.array_contains(parts, "..") | plain.contains("://") | (F.instr(plain, "\0") > 0) | drive
    return F.when(location == "", "EXTERNAL_DATA_LOCATION_MISSING").when(unsafe, "EXTERNAL_DATA_PATH_UNSAFE").when(location.isNotNull(), "EXTERNAL_DATA_NOT_VERIFIED")


#: Structural rules with their severities.
STRUCTURE_RULES = {
    "NO_GRAPH_INPUTS": "HIGH",
    "NO_GRAPH_OUTPUTS": "HIGH",
    "EMPTY_GRAPH": "HIGH",
    "DYNAMIC_OR_UNKNOWN_SHAPE": "LOW",
    "CUSTOM_OPERATOR_DOMAIN": "MEDIUM",
    "OPERATOR_NOT_APPROVED": "MEDIUM",
    "EXTERNAL_DATA_LOCATION_MISSING": "HIGH",
    "EXTERNAL_DATA_PATH_UNSAFE": "HIGH",
    "EXTERNAL_DATA_NOT_VERIFIED": "MEDIUM",
    "INITIALIZER_NAME_MISSING": "MEDIUM",
}


def structure_report(models: DataFrame, boundaries: DataFrame, nodes: DataFrame, initializers: DataFrame, approved: tuple[str, ...] | None = None, domains: tuple[str, ...] = ("", "ai.onnx", "ai.onnx.ml")) -> DataFrame:
    """Every structural issue of model graphs: (model_id, code, severity, evidence).

    ``models``: (model_id). ``boundaries``: (model_id, direction ``input`` or ``output``, name, shape: array of texts, of which
    only whole numbers are known sizes; an empty or null shape declares nothing). ``nodes``: (model_id, index, name, op_type,
    domain). ``initializers``: (model_id, name, location: null where the data is inside). A missing name of an initializer
    counts once a model, as the rule is about the model. Without ``approved`` every operator is.
    """
    issue = lambda df, code, *evidence: df.select("model_id", F.lit(code).alias("code"), F.array(*evidence).cast("array<string>").alias("evidence"))
    said = lambda name, value: F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("")))
    without = lambda some: models.select("model_id").distinct().join(some.select("model_id").distinct(), "model_id", "left_anti")
    known = F.forall("shape", lambda d: F.coalesce(d.rlike("^-?[0-9]+$"), F.lit(False)))
    shape = F.concat(F.lit("["), F.array_join(F.transform("shape", lambda d: F.coalesce(d, F.lit("?"))), ", "), F.lit("]"))
    node = F.when(F.coalesce("name", F.lit("")) == "", F.col("index").cast("string")).otherwise(F.col("name"))
    outside = nodes.where(~F.coalesce("domain", F.lit("")).isin(*domains))
    located = initializers.withColumn("code", external_location(F.col("location"))).where("code IS NOT NULL")
    where = F.array_compact(F.array(said("initializer", F.col("name")), F.when(F.col("location") != "", said("location", F.substring("location", 1, 256)))))
    found = [
        issue(without(boundaries.where("direction = 'input'")), "NO_GRAPH_INPUTS"),
        issue(without(boundaries.where("direction = 'output'")), "NO_GRAPH_OUTPUTS"),
        issue(without(nodes), "EMPTY_GRAPH"),
        issue(boundaries.where(F.col("shape").isNotNull() & ~known), "DYNAMIC_OR_UNKNOWN_SHAPE", said("tensor", F.col("name")), said("shape", shape)),
        issue(outside, "CUSTOM_OPERATOR_DOMAIN", said("node", node), said("domain", F.col("domain")), said("op_type", F.col("op_type"))),
        located.select("model_id", "code", where.alias("evidence")),
        issue(initializers.where(F.coalesce("name", F.lit("")) == "").select("model_id").distinct(), "INITIALIZER_NAME_MISSING"),
    ]
    if approved is not None:
        found.append(issue(nodes.where(~F.col("op_type").isin(*approved)), "OPERATOR_NOT_APPROVED", said("node", node), said("op_type", F.col("op_type"))))
    severity = F.coalesce(*(F.when(F.col("code") == c, s) for c, s in STRUCTURE_RULES.items()))
    return reduce(DataFrame.unionByName, found).select("model_id", "code", severity.alias("severity"), "evidence")


def structure_limitations(initializers: DataFrame) -> DataFrame:
    """(model_id, limitation) where a report can't speak for external data."""
    return initializers.where("location IS NOT NULL").select("model_id", F.lit("EXTERNAL_DATA_UNVERIFIED").alias("limitation")).distinct()


def parameter_totals(initializers: DataFrame) -> DataFrame:
    """(model_id, n_initializers, n_parameters): elements of all initializers by their ``dims``; a scalar has one, exact beyond 64 bits."""
    elements = F.aggregate("dims", F.lit(1).cast("decimal(38,0)"), lambda n, d: (n * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    return initializers.groupBy("model_id").agg(F.count("*").alias("n_initializers"), F.sum(elements).cast("decimal(38,0)").alias("n_parameters"))


def flagged_issues(energies: DataFrame | None = None, scales: DataFrame | None = None) -> DataFrame:
    """What ``energy`` and ``peer_scale`` flag, as issues: (model_id, tensor, channel, code, severity, evidence)."""
    shown = lambda name, value: F.concat(F.lit(f"{name}="), F.format_string("%.6f", value))
    parts = []
    if energies is not None:
        parts.append(energies.where("concentrated").select("model_id", "tensor", F.lit(None).cast("long").alias("channel"), F.lit("PARAMETER_ENERGY_CONCENTRATION").alias("code"), F.lit("MEDIUM").alias("severity"), F.array(shown("top1_energy", F.col("top1")), F.concat(F.lit("channels="), F.col("n_channels").cast("string"))).alias("evidence")))
    if scales is not None:
        parts.append(scales.where("is_outlier").select("model_id", "tensor", F.lit(None).cast("long").alias("channel"), F.lit("TENSOR_SCALE_OUTLIER").alias("code"), F.lit("MEDIUM").alias("severity"), F.array(shown("robust_z", F.col("robust_z")), F.concat(F.lit("peers="), F.col("n_peers").cast("string"))).alias("evidence")))
    return reduce(DataFrame.unionByName, parts)


def operator_profile(nodes: DataFrame) -> DataFrame:
    """Operators of each model with their counts, and the model's number of different ones."""
    counts = nodes.groupBy("model_id", "op_type").agg(F.count("*").alias("n"))
    return counts.withColumn("n_operators", F.count("*").over(Window.partitionBy("model_id")))


def issue_findings(issues: DataFrame, most: int = 100) -> DataFrame:
    """Findings of issues (model_id, code, tensor, channel, evidence) by the policy table; unknown codes have none.

    At most ``most`` per model, in order of severity, category, asset and id; one more row says what was left out.
    """
    spark = issues.sparkSession
    policy = F.broadcast(spark.createDataFrame([(c, *p) for c, p in ISSUE_FINDINGS.items()], "code string, severity string, confidence double, recommendation string"))
    lit = F.lit("model_integrity")
    rows = issues.drop("severity").join(policy, "code").withColumn("finding_id", finding_id(lit, F.col("code"), F.col("model_id"), redacted(F.col("evidence")))).dropDuplicates(["model_id", "finding_id"])
    order = (severity_rank(F.col("severity")).desc(), "code", "finding_id")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("model_id").orderBy(*order))).withColumn("_n", F.count("*").over(Window.partitionBy("model_id")))
    kept = ranked.where(F.col("_r") <= most).select("finding_id", "model_id", F.col("code").alias("category"), "severity", "confidence", "recommendation")
    code, evidence = F.lit("FINDING_MAPPING_TRUNCATED"), F.array(F.concat(F.lit("findings="), F.col("_n").cast("string")))
    more = ranked.where((F.col("_r") == most) & (F.col("_n") > most)).select(finding_id(lit, code, F.col("model_id"), evidence).alias("finding_id"), "model_id", code.alias("category"), F.lit("LOW").alias("severity"), F.lit(1.0).alias("confidence"), F.lit("REVIEW").alias("recommendation"))
    return kept.unionByName(more)


def redacted(evidence: Column, most: int = 12) -> Column:
    """Evidence without secrets: values of sensitive or path-like keys masked, tokens too; one line each, sorted, distinct."""
    def clean(x: Column) -> Column:
        line = F.regexp_replace(x, r"[\r\n]+", " ")
        key = F.lower(F.substring_index(line, "=", 1))
        secret = line.contains("=") & (key.rlike("secret|token|password|passwd|api_?key|private|credential") | key.rlike("(^|_)(path|file|dir|directory|location)$"))
        return F.when(secret, F.concat(F.substring_index(line, "=", 1), F.lit("=[redacted]"))).otherwise(F.regexp_replace(line, r"[A-Za-z0-9+/_-]{40,}", "[redacted]"))

    return F.slice(F.array_sort(F.array_distinct(F.transform(evidence, clean))), 1, most)


# ---------------------------------------------------------------- behaviour runs


def softmax(v: Column) -> Column:
    """A vector as probabilities, without overflow."""
    top = F.array_max(v)
    raised = let(top, lambda t: F.transform(v, lambda x: F.exp(x.cast("double") - t)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, y: s + y)
    return let(raised, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def classified(runs: DataFrame, output: str = "output") -> DataFrame:
    """Runs with the class (first of the largest) and its score, unless an output is missing or not finite."""
    v = F.col(output)
    usable = v.isNotNull() & (F.size(v) >= 2) & F.forall(v, lambda x: finite(x.cast("double")))
    return runs.withColumn("class", F.when(usable, F.array_position(v, F.array_max(v)) - 1)).withColumn("score", F.when(usable, F.array_max(softmax(v))))


def output_delta(a: Column, b: Column, epsilon: float = 1e-12) -> Column:
    """How far two output vectors are apart: largest, mean and normalised distance, and cosine.

    All four are null unless both are of one size, not empty and finite; the cosine is null where one has no length.
    """
    gaps = F.zip_with(a, b, lambda x, y: F.abs(y.cast("double") - x.cast("double")))
    total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    l2 = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))
    known = lambda v: F.forall(v, lambda x: x.isNotNull() & finite(x.cast("double")))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & known(a) & known(b)
    parts = {"max_abs": F.array_max(gaps), "mean_abs": total / F.size(gaps), "normalised_l2": l2 / (norm(a) + epsilon), "cosine": F.try_divide(dot(a, b), norm(a) * norm(b))}
    return F.struct(*(F.when(usable, value).alias(name) for name, value in parts.items()))


def output_summary(runs: DataFrame, output: str = "output", name: str = "output") -> DataFrame:
    """Each output with its counts of finite and other values, range, mean, RMS and fingerprint.

    Mean and RMS are taken over the largest magnitude, so squares can't overflow. Without finite values the four
    numbers are null; a null output has no elements. The fingerprint covers the name, the size and the values in order.
    """
    v = F.coalesce(F.transform(F.col(output), lambda x: x.cast("double")), F.array().cast("array<double>"))
    ok = F.filter(F.col("_v"), lambda x: x.isNotNull() & finite(x))
    many = lambda cond: F.size(F.filter("_v", cond)).cast("long")
    total = lambda f: F.aggregate("_ok", F.lit(0.0), lambda s, x: s + f(F.try_divide(x, F.col("_top"))))
    n = F.size("_ok")
    scaled = lambda x: F.when(n > 0, F.when(F.col("_top") == 0, 0.0).otherwise(F.col("_top") * x))
    text = F.array_join(F.transform("_v", lambda x: F.coalesce(F.format_string("%.12e", x), F.lit("null"))), ",")
    staged = runs.withColumn("_v", v).withColumn("_ok", ok).withColumn("_top", F.array_max(F.transform("_ok", F.abs)))
    found = staged.withColumns({
        "elements": F.size("_v").cast("long"),
        "n_finite": n.cast("long"),
        "n_nan": many(F.isnan),
        "n_posinf": many(lambda x: x == float("inf")),
        "n_neginf": many(lambda x: x == float("-inf")),
        "minimum": F.array_min("_ok"),
        "maximum": F.array_max("_ok"),
        "mean": scaled(F.try_divide(total(lambda x: x), n.cast("double"))),
        "rms": scaled(F.sqrt(F.try_divide(total(lambda x: x * x), n.cast("double")))),
        "fingerprint": F.sha2(F.concat_ws("|", F.lit(name), F.size("_v").cast("string"), text), 256),
    })
    return found.drop("_v", "_ok", "_top")


KINDS = ("solid", "zero", "checkerboard")
LOCATIONS = ("top_left", "top_right", "bottom_left", "bottom_right", "center")


def default_triggers(height: int, width: int, low: float = 0.0, high: float = 1.0) -> list[tuple]:
    """Each kind of patch at each of five places: (trigger_id, kind, location, top, left, ph, pw, low, value).

    A patch takes an eighth of the image, 1 to 32 pixels a side. Zero patches are left out where 0 is no value.
    """
    ph, pw = (min(n, max(1, min(32, -(-n // 8)))) for n in (height, width))
    down, right = height - ph, width - pw
    at = dict(zip(LOCATIONS, ((0, 0), (0, right), (down, 0), (down, right), (down // 2, right // 2))))
    kinds = [k for k in KINDS if k != "zero" or low <= 0 <= high]
    return [(f"{k}_{place}", k, place, top, left, ph, pw, float(low), float(high)) for k in kinds for place, (top, left) in at.items()]


TRIGGER = "trigger_id string, kind string, location string, top int, left int, ph int, pw int, low double, value double"


def perturbed(samples: DataFrame, triggers: DataFrame, height: int, width: int, channels: int = 1, layout: str = "NCHW") -> DataFrame:
    """The grid of samples and triggers with the patch written into all channels of the flat ``pixels``.

    ``layout`` is NCHW (planes) or NHWC (interleaved). ``triggers`` (trigger_id, kind, top, left, ph, pw, value and
    ``low``, 0 without it) is a small table by design. Solid patches take ``value``, a checkerboard ``low`` where row
    and column add up to an even number, else ``value``. Samples of another size are left out.
    """
    if layout not in ("NCHW", "NHWC"):
        raise ValueError("layout must be NCHW or NHWC")
    low = F.col("low") if "low" in triggers.columns else F.lit(0.0)

    def paint(p: Column, i: Column) -> Column:
        place = i % F.lit(height * width) if layout == "NCHW" else F.floor(i / F.lit(channels))
        y, x = F.floor(place / F.lit(width)), place % F.lit(width)
        inside = (y >= F.col("top")) & (y < F.col("top") + F.col("ph")) & (x >= F.col("left")) & (x < F.col("left") + F.col("pw"))
        even = (y - F.col("top") + x - F.col("left")) % 2 == 0
        value = F.when(F.col("kind") == "zero", 0.0).when((F.col("kind") == "checkerboard") & even, low).otherwise(F.col("value"))
        return F.when(inside, value).otherwise(p)

    fitting = samples.where(F.size("pixels") == height * width * channels)
    return fitting.crossJoin(F.broadcast(triggers)).withColumn("pixels", F.transform("pixels", paint))


def score_runs(grid: DataFrame, runtime, schema: str) -> DataFrame:
    """Runs of a caller's model: ``runtime`` maps an iterator of pandas batches to batches of ``schema``."""
    return grid.mapInPandas(runtime, schema)


def repeatability(runs: DataFrame) -> DataFrame:
    """Different outputs of equal runs by (model_id, sample_id)."""
    return runs.where("status = 'OK'").groupBy("model_id", "sample_id").agg(F.count("*").alias("repeats"), F.countDistinct(F.sha2(F.to_json("output"), 256)).alias("outputs"))


def trigger_behaviour(clean: DataFrame, triggered: DataFrame) -> DataFrame:
    """Per model and trigger: flips, dominant class and its lift, and deltas against each sample's clean run.

    ``clean``: (model_id, sample_id, output); ``triggered`` also has trigger_id, kind, location, ph, pw.
    """
    a = classified(clean).selectExpr("model_id", "sample_id", "output AS o0", "class AS c0", "score AS s0")
    both = classified(triggered).join(a, ["model_id", "sample_id"]).withColumn("d", output_delta(F.col("o0"), F.col("output"))["normalised_l2"])
    keys = ["model_id", "trigger_id"]
    paired = F.col("class").isNotNull() & F.col("c0").isNotNull()
    base = both.groupBy(*keys).agg(
        F.first("kind").alias("kind"), F.first("location").alias("location"), F.first("ph").alias("ph"), F.first("pw").alias("pw"),
        F.count_if(paired).alias("pairs"), F.count_if(paired & (F.col("class") != F.col("c0"))).alias("flips"), F.count("class").alias("n_class"),
        F.avg("d").alias("mean_delta"), F.percentile("d", F.lit(0.5)).alias("median_delta"), F.avg(F.col("score") - F.col("s0")).alias("mean_score_shift"),
    )
    votes = both.where("class IS NOT NULL").groupBy(*keys, "class").agg(F.count("*").alias("k"))
    top = votes.groupBy(*keys).agg(F.max(F.struct("k", (-F.col("class")).alias("c"))).alias("t")).select(*keys, (-F.col("t.c")).alias("dominant"), F.col("t.k").alias("k"))
    before = a.where("c0 IS NOT NULL").groupBy("model_id", F.col("c0").alias("dominant")).agg(F.count("*").alias("k0"))
    total = a.groupBy("model_id").agg(F.count("c0").alias("n0"))
    found = base.join(top, keys, "left").join(total, "model_id", "left").join(before, ["model_id", "dominant"], "left")
    rate, clean_rate = F.try_divide(F.col("k").cast("double"), F.col("n_class").cast("double")), F.try_divide(F.coalesce("k0", F.lit(0)).cast("double"), F.col("n0").cast("double"))
    return found.withColumns({"flip_rate": F.try_divide(F.col("flips").cast("double"), F.col("pairs").cast("double")), "dominant_rate": rate, "clean_rate": clean_rate, "lift": rate - clean_rate}).drop("k", "k0", "n0", "n_class")


def control_relative(behaviour: DataFrame) -> DataFrame:
    """Flip rates less the median of peers: triggers of the same kind and size at other places."""
    peer = behaviour.selectExpr("model_id", "kind", "ph", "pw", "location AS l", "flip_rate AS r")
    pairs = behaviour.select("model_id", "trigger_id", "kind", "ph", "pw", "location").join(peer, ["model_id", "kind", "ph", "pw"]).where("l != location")
    control = pairs.groupBy("model_id", "trigger_id").agg(F.percentile("r", F.lit(0.5)).alias("control"))
    return behaviour.join(control, ["model_id", "trigger_id"], "left").withColumn("control_relative", F.col("flip_rate") - F.col("control"))


def behaviour_issues(behaviour: DataFrame, policy: BehaviourPolicy = RUNS) -> DataFrame:
    """Issues of triggers with enough paired samples."""
    issue = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    flip, target = F.col("flip_rate") >= policy.flip, (F.col("dominant_rate") >= policy.dominant) & (F.col("lift") >= policy.lift)
    found = F.array_compact(F.array(issue(F.col("mean_delta") >= policy.divergence, "TRIGGER_OUTPUT_DIVERGENCE"), issue(flip, "TRIGGER_PREDICTION_FLIP"), issue(target, "TRIGGER_TARGET_CONCENTRATION"), issue(flip & target & (F.col("control_relative") >= policy.control), "TRIGGER_SENSITIVITY")))
    return behaviour.where(F.col("pairs") >= policy.least).select("model_id", "trigger_id", F.explode(found).alias("code"))


def run_coverage(runs: DataFrame) -> DataFrame:
    """Runs that ended well, failed or timed out by model, and the analysis' status."""
    found = runs.groupBy("model_id").agg(F.count("*").alias("requested"), F.count_if(F.col("status") == "OK").alias("usable"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "TIMEOUT").alias("timed_out"))
    return found.withColumn("analysis", F.when(F.col("usable") == 0, "UNAVAILABLE").when(F.col("usable") < F.col("requested"), "PARTIAL").otherwise("COMPLETE"))


def output_contract(runs: DataFrame, contracts: DataFrame, most_elements: int = 1 << 20, most_bytes: int = 1 << 23) -> DataFrame:
    """What each run's output breaks of its model's contract: a code or null, and non-finite outputs.

    ``contracts``: model_id, expected_size and, where the runs have ``name`` or ``dtype``, expected_name and
    expected_dtype. An element takes as many bytes as its type's name has bits / 8, or 8.
    """
    joined = runs.join(contracts, "model_id", "left")
    changed = F.col("output").isNull() | ~F.size("output").eqNullSafe(F.col("expected_size"))
    for c in ("name", "dtype"):
        if f"expected_{c}" in contracts.columns:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"expected_{c}")) | F.col(c).isNull()
    bits = F.expr("try_cast(regexp_extract(dtype, '([0-9]+)$', 1) AS int)") if "dtype" in runs.columns else F.lit(64)
    size = F.size("output").cast("long") * F.coalesce(bits, F.lit(64)) / 8
    code = F.when(changed, "OUTPUT_CONTRACT_CHANGED").when(F.size("output") > most_elements, "OUTPUT_ELEMENT_LIMIT_EXCEEDED").when(size > most_bytes, "OUTPUT_BYTE_LIMIT_EXCEEDED")
    return joined.withColumn("code", code).withColumn("nonfinite", F.coalesce(F.exists("output", lambda x: ~finite(x.cast("double"))), F.lit(False)))


# ---------------------------------------------------------------- coverage, baselines, comparisons of reports


def parameter_coverage(tensors: DataFrame) -> DataFrame:
    """Tensors, elements and bytes in all and analysed, by model, with the ratio and status; ``tensors``: (model_id, elements, bytes, analysed)."""
    part = lambda c: F.coalesce(F.sum(F.when(F.col("analysed"), F.col(c))), F.lit(0)).cast("long")
    found = tensors.groupBy("model_id").agg(F.count("*").alias("tensors"), F.count_if("analysed").alias("tensors_analysed"), F.sum("elements").alias("elements"), part("elements").alias("elements_analysed"), F.sum("bytes").alias("bytes"), part("bytes").alias("bytes_analysed"))
    status = F.when(F.col("tensors_analysed") == 0, "UNAVAILABLE").when(F.col("tensors_analysed") < F.col("tensors"), "PARTIAL").otherwise("COMPLETE")
    return found.withColumns({"element_ratio": F.try_divide(F.col("elements_analysed").cast("double"), F.col("elements").cast("double")), "status": status})


def structure_fingerprint(nodes: DataFrame) -> DataFrame:
    """A hash of each model's graph: its nodes' places, operators and domains."""
    row = F.concat_ws("|", F.col("position").cast("string"), "op_type", F.coalesce("domain", F.lit("")))
    found = profile.commitment(nodes, ("model_id",), row)
    return found.select("model_id", F.col("samples").alias("nodes"), F.col("commitment").alias("structure_sha256"))


def parameter_fingerprint(parameters: DataFrame) -> DataFrame:
    """A hash of each model's parameters without their values: names, types and shapes (a text each)."""
    row = F.concat_ws("|", "name", F.coalesce("dtype", F.lit("")), F.coalesce(F.col("shape").cast("string"), F.lit("")))
    found = profile.commitment(parameters, ("model_id",), row)
    return found.select("model_id", F.col("samples").alias("parameters"), F.col("commitment").alias("metadata_sha256"))


def baseline_problems(records: DataFrame) -> DataFrame:
    """Baseline records with what is wrong with them; columns model_id, artifact_sha256, structure_sha256, value_sha256, status, record_sha256."""
    hashes = ("artifact_sha256", "structure_sha256", "value_sha256")
    text = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in ("model_id", *hashes, "status")))
    bad = [F.when(~F.coalesce(F.col(h).rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit(f"{h.upper()}_MALFORMED")) for h in hashes]
    errors = F.array_compact(F.array(F.when(F.col("model_id").isNull() | (F.trim("model_id") == ""), "MODEL_ID_MISSING"), *bad, F.when(~F.coalesce(F.col("status") == "COMPLETE", F.lit(False)), "BASELINE_INCOMPLETE"), F.when(~F.col("record_sha256").eqNullSafe(F.sha2(text, 256)), "RECORD_DIGEST_MISMATCH")))
    return records.withColumn("errors", errors)


def baseline(models_: DataFrame) -> DataFrame:
    """Baseline records, sealed by a digest over their fields."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in ("model_id", "artifact_sha256", "structure_sha256", "value_sha256", "status")))
    return models_.select("model_id", "artifact_sha256", "structure_sha256", "value_sha256", "status", F.sha2(text, 256).alias("record_sha256"))


def compare_baselines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two records of each model: the state of artifact, structure and values, and what that means."""
    b, a = (df.select("model_id", *(F.col(c).alias(f"{s}_{c}") for c in ("artifact_sha256", "structure_sha256", "value_sha256", "status"))) for s, df in (("b", before), ("a", after)))
    state = lambda c: F.when(F.col("b_status").isNull() | F.col("a_status").isNull(), "INCOMPARABLE").when(F.col(f"b_{c}").isNull() | F.col(f"a_{c}").isNull(), "UNAVAILABLE").when(F.col(f"b_{c}") == F.col(f"a_{c}"), "SAME").otherwise("CHANGED")
    found = b.join(a, "model_id", "full_outer").select("model_id", *(state(c).alias(n) for n, c in (("artifact", "artifact_sha256"), ("structure", "structure_sha256"), ("parameters", "value_sha256"))))
    meaning = (
        F.when(F.col("structure") == "INCOMPARABLE", "NOT_COMPARED")
        .when(F.col("structure") == "CHANGED", "STRUCTURE_CHANGED")
        .when(F.col("parameters") == "CHANGED", "PARAMETERS_CHANGED")
        .when((F.col("structure") == "UNAVAILABLE") | (F.col("parameters") == "UNAVAILABLE"), "EVIDENCE_INCOMPLETE")
        .when(F.col("artifact") == "CHANGED", "REPACKAGED")
        .otherwise("UNCHANGED")
    )
    return found.withColumn("interpretation", meaning)


def compare_behaviour(before: DataFrame, after: DataFrame) -> DataFrame:
    """Flip rates of triggers that two reports share with equal support: their change."""
    b = before.select("model_id", "trigger_id", F.col("pairs").alias("pairs_before"), F.col("flip_rate").alias("flip_before"))
    both = after.select("model_id", "trigger_id", "pairs", F.col("flip_rate").alias("flip_after")).join(b, ["model_id", "trigger_id"])
    return both.where("pairs = pairs_before").withColumn("flip_change", F.col("flip_after") - F.col("flip_before")).drop("pairs_before")


#: What a changed issue of a behaviour report is called, by its code and its delta.
BEHAVIOUR_CODES = {
    ("TRIGGER_SENSITIVITY", "NEW"): "NEW_TRIGGER_SENSITIVITY",
    ("TRIGGER_SENSITIVITY", "RESOLVED"): "RESOLVED_TRIGGER_SENSITIVITY",
    ("TRIGGER_SENSITIVITY", "PERSISTING"): "PERSISTING_TRIGGER_SENSITIVITY",
    ("NONDETERMINISTIC_OUTPUT", "NEW"): "NEW_NONDETERMINISM",
    ("OUTPUT_NONFINITE", "NEW"): "NEW_OUTPUT_NONFINITE",
}


def behaviour_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of the triggers that two reports share: (model_id, trigger_id, flip_change, lift_change, control_change).

    A change is null where the reports' samples differ in number or are none, or where a rate is missing or not finite.
    """
    rates = {"flip_rate": "flip_change", "lift": "lift_change", "control_relative": "control_change"}
    a = after.select("model_id", "trigger_id", F.col("pairs").alias("_pairs"), *(F.col(c).alias(f"_{c}") for c in rates))
    both = before.select("model_id", "trigger_id", "pairs", *rates).join(a, ["model_id", "trigger_id"])
    comparable = (F.col("pairs") > 0) & (F.col("pairs") == F.col("_pairs"))
    change = lambda c: F.when(comparable & finite(F.col(c)) & finite(F.col(f"_{c}")), F.col(f"_{c}") - F.col(c))
    return both.select("model_id", "trigger_id", *(change(c).alias(n) for c, n in rates.items()))


def behaviour_report(reports: DataFrame, deltas: DataFrame, issues_before: DataFrame, issues_after: DataFrame, identity: tuple[str, ...] = ("trigger_id",), most: int | None = None) -> DataFrame:
    """Per model, two behaviour reports compared: (model_id, status, state, codes, n_new, n_resolved, n_persisting, limitations).

    ``reports``: (model_id, status_before, status_after), a row for each model to compare. Issues are the same by code and
    ``identity``. The state is CHANGED when an issue came or went or a rate moved, SAME otherwise, and UNAVAILABLE where the
    evidence is partial: a report is not complete, or a model has more deltas than ``most``.
    """
    keys = ("model_id", "code", *identity)
    moved = issue_deltas(issues_before, issues_after, keys).groupBy("model_id").agg(
        *(F.count_if(F.col("delta") == d).alias(f"n_{d.lower()}") for d in ("NEW", "RESOLVED", "PERSISTING")),
        F.array_sort(F.collect_set(F.coalesce(*(F.when((F.col("code") == c) & (F.col("delta") == d), F.lit(n)) for (c, d), n in BEHAVIOUR_CODES.items())))).alias("codes"),
    )
    shifted = reduce(Column.__or__, (F.coalesce(F.col(c) != 0, F.lit(False)) for c in ("flip_change", "lift_change", "control_change")))
    rates = deltas.groupBy("model_id").agg(F.count_if(shifted).alias("_rates"), F.count("*").alias("_triggers"))
    joined = reports.join(moved, "model_id", "left").join(rates, "model_id", "left").fillna(0, ["n_new", "n_resolved", "n_persisting", "_rates", "_triggers"])
    too_many = lambda n: F.lit(False) if most is None else n > most
    cut_triggers, cut_issues = too_many(F.col("_triggers")), too_many(F.col("n_new") + F.col("n_resolved") + F.col("n_persisting"))
    partial = ~(F.col("status_before").eqNullSafe("COMPLETE") & F.col("status_after").eqNullSafe("COMPLETE")) | cut_triggers | cut_issues
    changed = (F.col("n_new") + F.col("n_resolved") + F.col("_rates")) > 0
    limits = F.array_compact(F.array(F.when(partial, "BEHAVIORAL_EVIDENCE_PARTIAL"), F.when(cut_triggers, "BEHAVIOR_TRIGGER_DELTAS_TRUNCATED"), F.when(cut_issues, "BEHAVIOR_ISSUE_DELTAS_TRUNCATED")))
    return joined.select(
        "model_id",
        F.when(partial, "PARTIAL").otherwise("COMPLETE").alias("status"),
        F.when(partial, "UNAVAILABLE").when(changed, "CHANGED").otherwise("SAME").alias("state"),
        F.coalesce("codes", F.array().cast("array<string>")).alias("codes"),
        "n_new",
        "n_resolved",
        "n_persisting",
        limits.alias("limitations"),
    )


def protocol_mismatches(before: DataFrame, after: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Per model, the parts of the test protocol in which two reports differ, so that they can't be compared."""
    a = after.select("model_id", *(F.col(f).alias(f"_{f}") for f in fields))
    differs = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f"{f.upper()}_MISMATCH")) for f in fields)))
    return before.join(a, "model_id").select("model_id", differs.alias("reasons"))
