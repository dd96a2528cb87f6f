"""Embedding windows: validation, profiles and comparison, with pairwise metrics over whole windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.columns import cosine_distance, dot, finite, norm, public
from proofline.functions.policies import VectorPolicy
from proofline.operators import compare, pairwise, profile
from proofline.operators.detect import mean_vector
from proofline.operators.relational import running_sum
from proofline.session import cut

POLICY = VectorPolicy()


def validate(df: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """Rows with ``problem``: MISSING, WRONG_DIMENSION, NOT_FINITE, DUPLICATE_ID or null."""
    v = F.col(vector)
    problem = (
        F.when(v.isNull() | F.col(key).isNull(), "MISSING")
        .when(F.size(v) != dimension, "WRONG_DIMENSION")
        .when(F.exists(v, lambda x: ~finite(x.cast("double"))), "NOT_FINITE")
        .when(F.count("*").over(Window.partitionBy(key)) > 1, "DUPLICATE_ID")
    )
    return df.withColumn("problem", problem)


def unit(v: Column) -> Column:
    """A vector over its length; a zero vector is an error."""
    size = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(size > 0, size).otherwise(F.raise_error(F.lit("zero vector")).cast("double")))


def hashed_subset(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashed ids."""
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(most)


def spaced(df: DataFrame, keys: tuple[str, ...], order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced in order, the first and last among them; a key spans many tasks."""
    ranked = running_sum(df, keys, (order,), F.lit(1)).withColumn("_i", F.col("running") - 1).withColumnRenamed("total", "_n")
    # i is taken when some step k falls on it: floor(k (n - 1) / (most - 1)) = i
    k = F.ceil(F.col("_i") * (most - 1) / (F.col("_n") - 1))
    taken = (F.col("_n") <= most) | (F.floor(k * (F.col("_n") - 1) / F.lit(most - 1)) == F.col("_i"))
    return ranked.where(taken).select(*df.columns)


def moments(df: DataFrame, keys: tuple[str, ...], vector: str) -> DataFrame:
    """Per key: centroid and population variance by dimension, as arrays."""
    each = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.var_pop(F.col("x").cast("double")).alias("v"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "m", "v")))
    return each.groupBy(*keys).agg(rows.alias("_r")).select(*keys, F.transform("_r", lambda r: r["m"]).alias("centroid"), F.transform("_r", lambda r: r["v"]).alias("variance"))


def vector_profile(df: DataFrame, keys: tuple[str, ...], vector: str) -> DataFrame:
    """Per key: count, centroid, variance, and summaries of norms and of distances from the centroid (structs)."""
    base = moments(df, keys, vector)
    measured = df.join(F.broadcast(base.select(*keys, "centroid")), list(keys)).select(*keys, norm(F.col(vector)).alias("norm"), F.sqrt(F.aggregate(F.zip_with(vector, "centroid", lambda x, c: (x.cast("double") - c) ** 2), F.lit(0.0), lambda s, x: s + x)).alias("radial"))
    rows = profile.numeric_profile(profile.long_form(measured, ("norm", "radial"), keys), (*keys, "feature"))
    summary = F.struct(*profile.SUMMARY)
    sides = rows.groupBy(*keys).agg(*(F.first(F.when(F.col("feature") == f, summary), ignorenulls=True).alias(f) for f in ("norm", "radial")))
    rms = measured.groupBy(*keys).agg(F.sqrt(F.avg(F.col("radial") ** 2)).alias("rms_radius"))
    return base.join(sides, list(keys)).join(rms, list(keys))


#: Dimensions up to which a covariance is computed, and columns of one tile of it.
COVARIANCE_DIMENSIONS, COVARIANCE_TILE = 512, 128


def covariance(df: DataFrame, vector: str, most: int = COVARIANCE_DIMENSIONS, tile: int = COVARIANCE_TILE) -> DataFrame:
    """Population covariance (i, j, value) by partial Gram matrices: each task ships one matrix, whatever its rows.

    A task holds one matrix of at most ``most`` squared numbers and hands it over in tiles of columns, so no frame is
    larger than a tile. Vectors of more than ``most`` dimensions have no covariance: the result is empty.
    """

    def gram(batches):
        total, sums, n = None, None, 0
        for pdf in batches:
            if len(pdf) and len(pdf["v"].iloc[0]) <= most:
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                if total is None:
                    total, sums = np.zeros((x.shape[1], x.shape[1])), np.zeros(x.shape[1])
                total += x.T @ x
                sums += x.sum(0)
                n += len(x)
        for a in range(0, len(sums) if n else 0, tile):
            for b in range(0, len(sums), tile):
                part = total[a : a + tile, b : b + tile]
                i, j = (x.ravel() for x in np.indices(part.shape))
                yield pd.DataFrame({"i": i + a, "j": j + b, "xx": part.ravel(), "xi": sums[i + a], "xj": sums[j + b], "n": n})

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(gram, "i int, j int, xx double, xi double, xj double, n long")
    return parts.groupBy("i", "j").agg((F.sum("xx") / F.sum("n") - F.sum("xi") * F.sum("xj") / (F.sum("n") * F.sum("n"))).alias("value"))


def covariance_commitment(matrix: DataFrame) -> DataFrame:
    """One hash over the cells of a covariance, rounded to twelve digits so that the order of sums does not show; null without cells."""
    cell = F.concat_ws("|", F.col("i").cast("string"), F.col("j").cast("string"), F.format_string("%.12e", public(F.col("value"))))
    found = profile.commitment(matrix, (), cell)
    return found.select(F.when(F.col("samples") > 0, F.col("commitment")).alias("commitment"), F.coalesce("samples", F.lit(0)).alias("cells"))


def vector_digest(vector: Column) -> Column:
    """A digest of a vector's numbers in order; null for a null vector."""
    return F.when(vector.isNotNull(), F.sha2(F.array_join(F.transform(vector, lambda x: F.format_string("%.17g", x.cast("double"))), ","), 256))


def _differs(small: Column, gap: Column, epsilon: float) -> Column:
    """A scale without extent over which there is a gap: no ratio can be given, and the sides differ."""
    return (small <= epsilon) & (gap > epsilon)


def _ratio(gap: Column, scale: Column, epsilon: float) -> Column:
    """gap / scale; 0 where both vanish, null where only the scale does."""
    return F.when(scale > epsilon, public(gap / scale)).when(gap <= epsilon, F.lit(0.0))


def _directions(a: Column, b: Column, epsilon: float) -> tuple[Column, Column]:
    """Cosine distance, 0 for two vectors without length and null where only one has none; and whether that is so."""
    short = (norm(a) <= epsilon).cast("int") + (norm(b) <= epsilon).cast("int")
    distance = F.least(F.lit(2.0), F.greatest(F.lit(0.0), cosine_distance(a, b)))
    return F.when(short == 2, F.lit(0.0)).when(short == 0, public(distance)), short == 1


def moved(profiles: DataFrame, keys: tuple[str, ...], policy: VectorPolicy = POLICY, epsilon: float = 1e-12) -> DataFrame:
    """Centroid, dispersion and variance features of two roles' profiles, with their metrics and states.

    A metric is null where its scale vanishes although the sides differ (a centroid without length, windows of constant
    vectors): such a feature is SHIFTED, whatever its other metrics say.
    """
    both = compare.side_by_side(profiles, keys)
    r, c = F.col("r.centroid"), F.col("c.centroid")
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (y - x) ** 2), F.lit(0.0), lambda s, x: s + x))
    gap = apart(r, c)
    pooled = F.sqrt((F.col("r.rms_radius") ** 2 + F.col("c.rms_radius") ** 2) / 2)
    rv, cv = F.col("r.variance"), F.col("c.variance")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    cosine, degenerate = _directions(r, c, epsilon)
    variance_cosine, variance_degenerate = _directions(rv, cv, epsilon)
    longer = F.greatest(norm(rv), norm(cv))
    total_gap = F.abs(total(cv) - total(rv))
    one_total = (F.least(total(rv), total(cv)) <= epsilon) & (total_gap > epsilon)
    smd, quantile = compare.smd("r.radial", "c.radial"), compare.quantile_shift("r.radial", "c.radial")
    flat = both.select(
        *keys,
        F.col("r.norm.count").alias("n_ref"),
        F.col("c.norm.count").alias("n_cur"),
        cosine.alias("centroid_cosine"),
        _ratio(gap, pooled, epsilon).alias("centroid_shift"),
        smd.alias("radial_smd"),
        quantile.alias("radial_quantile"),
        compare.median_change("r.radial", "c.radial").alias("radial_median"),
        _ratio(apart(rv, cv), longer, epsilon).alias("variance_l2"),
        variance_cosine.alias("variance_cosine"),
        F.when(~one_total, public(total_gap / F.greatest(total(rv), total(cv), F.lit(epsilon)))).alias("variance_total"),
        (degenerate | _differs(pooled, gap, epsilon)).alias("centroid_degenerate"),
        (smd.isNull() | quantile.isNull()).alias("dispersion_degenerate"),
        (variance_degenerate | _differs(longer, apart(rv, cv), epsilon)).alias("variance_degenerate"),
    )
    over = lambda t, *names: sum((F.when(F.col(n) >= t, 1).otherwise(0) for n in names), F.lit(0))
    enough = F.coalesce((F.col("n_ref") >= policy.support) & (F.col("n_cur") >= policy.support), F.lit(False))

    def state(feature: str, hit: Column) -> Column:
        shifted = F.coalesce(F.col(f"{feature}_degenerate"), F.lit(False)) | F.coalesce(hit, F.lit(False))
        return F.when(~enough, "INSUFFICIENT").when(shifted, "SHIFTED").otherwise("STABLE")

    moved_far = (F.col("centroid_cosine") >= policy.centroid_cosine) & (F.col("centroid_shift") >= policy.centroid_shift)
    return (
        flat.withColumn("centroid_state", state("centroid", moved_far))
        .withColumn("dispersion_state", state("dispersion", over(policy.dispersion, "radial_smd", "radial_quantile", "radial_median") >= 2))
        .withColumn("variance_state", state("variance", over(policy.variance, "variance_l2", "variance_cosine", "variance_total") >= 2))
    )


def _window(df: DataFrame, key: str, vector: str, most: int | None) -> DataFrame:
    """Rows for pairwise work: all, or ``most`` of each role, evenly spaced, where a policy caps them."""
    return pairwise._plain(df if most is None else spaced(df, ("role",), key, most), key, vector)


def _bandwidth(distinct: DataFrame, policy: VectorPolicy, fixed: float | None) -> tuple[float, bool]:
    if fixed is not None:
        if not fixed > 0 or fixed == float("inf"):
            raise ValueError("a fixed bandwidth is a positive number")
        return fixed, False
    middle = pairwise.median_of_distinct(distinct)
    return (policy.fallback_bandwidth, True) if middle is None or middle <= 1e-12 else (round(middle, 12), False)


def bandwidth(df: DataFrame, key: str, vector: str, most: int | None = None, policy: VectorPolicy = POLICY, fixed: float | None = None) -> DataFrame:
    """One row: the median squared distance between different rows of both windows, or the fallback, or a fixed value."""
    value, fallback = _bandwidth(pairwise.distinct(_window(df, key, vector, most)), policy, fixed)
    return df.sparkSession.createDataFrame([(value, fallback)], "bandwidth double, fallback boolean")


def mmd(df: DataFrame, key: str, vector: str, most: int | None = None, policy: VectorPolicy = POLICY, fixed: float | None = None) -> DataFrame:
    """One row: biased MMD squared of the roles REFERENCE and CURRENT under an RBF kernel, over all rows (or ``most`` a role).

    The bandwidth is the median squared distance, or ``fixed``.
    """
    distinct = pairwise.distinct(_window(df, key, vector, most))
    value, _ = _bandwidth(distinct, policy, fixed)
    means = pairwise.kernel_of_distinct(distinct, value).groupBy().pivot("pair", ["RR", "CC", "CR"]).agg(F.sum("k") / F.sum("n"))
    found = public(F.greatest(F.lit(0.0), F.col("RR") + F.col("CC") - 2 * F.col("CR")))
    return means.select(found.alias("mmd")).withColumn("state", F.when(F.col("mmd") >= policy.mmd, "SHIFTED").otherwise("STABLE"))


def nearest_support(df: DataFrame, key: str, vector: str, most: int | None = None, policy: VectorPolicy = POLICY) -> DataFrame:
    """One row: median distance of current rows to the nearest reference over that of reference rows to each other.

    ``compared`` is the share of all pairs whose distance was taken.
    """
    one = pairwise.support(cut(_window(df, key, vector, most), "pairwise"))
    ratio = F.when(F.col("base") > 1e-12, public(F.col("observed") / F.col("base"))).when(F.col("observed") <= 1e-12, F.lit(1.0))
    return one.withColumn("ratio", ratio).withColumn("state", F.when(F.col("ratio").isNull() | (F.col("ratio") >= policy.nearest_ratio), "SHIFTED").otherwise("STABLE")).select("ratio", "mean", "q95", "compared", "state")


__all__ = ["bandwidth", "covariance", "dot", "hashed_subset", "mean_vector", "mmd", "moments", "moved", "nearest_support", "spaced", "unit", "validate", "vector_profile"]
