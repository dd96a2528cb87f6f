"""Window profiles in long form: one row per segment, role and feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.columns import canonical
from proofline.operators.quantiles import with_quantiles

#: Statistics of a summary, in order.
SUMMARY = ("count", "minimum", "maximum", "mean", "std", "median", "q05", "q25", "q75", "q95")


def long_form(df: DataFrame, features: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """(keep..., feature, value) of some numeric columns; null and non-finite values are left out."""
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features)))
    return df.select(*keep, rows.alias("_r")).select(*keep, "_r.feature", "_r.value").where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")


def numeric_profile(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Summary of ``value`` by key, with exact quantiles and population deviation."""
    places = {"median": 0.5, "q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95}
    plain = (F.count("value").alias("count"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return with_quantiles(values, keys, F.col("value"), places, *plain)


def unit_bin(value: Column, bins: int) -> Column:
    """Bin 0 .. bins - 1 of a value in [0, 1], the right edge closed; null outside."""
    return F.when((value >= 0) & (value <= 1), F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int"))


def histogram(values: DataFrame, keys: tuple[str, ...], bins: int) -> DataFrame:
    """Counts of ``value`` in equal bins over [0, 1] by key, as (keys..., bin, n); values outside are dropped, empty bins absent."""
    return values.withColumn("bin", unit_bin(F.col("value"), bins)).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def dense(hist: DataFrame, keys: tuple[str, ...], bins: int) -> DataFrame:
    """A histogram's counts as one array per key."""
    return hist.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0).cast("long"))).alias("counts"))


def category_counts(df: DataFrame, keys: tuple[str, ...], value: str, most: int, other: str = "OTHER") -> DataFrame:
    """Counts of a column's values by key; beyond ``most`` values the first most - 1 by name stay and the rest are summed."""
    counts = df.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("UNKNOWN")).alias("value")).agg(F.count("*").alias("n"))
    by_name = Window.partitionBy(*keys).orderBy("value")
    ranked = counts.withColumn("_r", F.row_number().over(by_name)).withColumn("_k", F.count("*").over(Window.partitionBy(*keys)))
    return ranked.withColumn("value", F.when((F.col("_k") > most) & (F.col("_r") >= most), F.lit(other)).otherwise(F.col("value"))).groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def window_status(df: DataFrame, keys: tuple[str, ...], path: str, code: str, most: int) -> DataFrame:
    """Counts and status of a window of samples, of which the first ``most`` by path are taken.

    ``code`` is a failure code or null. UNAVAILABLE without a usable sample, PARTIAL when samples were left out or
    failed, else COMPLETE. The rank at which a window ends is found by counting paths, not by collecting them.
    """
    rank = Window.partitionBy(*keys).orderBy(path)
    taken = df.withColumn("_in", F.row_number().over(rank) <= most)
    found = taken.groupBy(*keys).agg(F.count("*").alias("discovered"), F.count_if("_in").alias("selected"), F.count_if(F.col("_in") & F.col(code).isNull()).alias("profiled"), F.count_if(F.col("_in") & F.col(code).isNotNull()).alias("failed"))
    found = found.withColumn("skipped", F.col("discovered") - F.col("selected"))
    status = F.when(F.col("profiled") == 0, "UNAVAILABLE").when((F.col("failed") > 0) | (F.col("skipped") > 0), "PARTIAL").otherwise("COMPLETE")
    notes = F.filter(F.array(F.when(F.col("failed") > 0, "FAILED_SAMPLES"), F.when(F.col("skipped") > 0, "WINDOW_TRUNCATED")), lambda x: x.isNotNull())
    return found.withColumn("status", status).withColumn("limitations", F.array_join(notes, ","))


def failures(df: DataFrame, keys: tuple[str, ...], path: str, code: str, shown: int = 20) -> DataFrame:
    """Failure counts by code, with the first ``shown`` failed paths of each key in order of path and code."""
    bad = df.where(F.col(code).isNotNull()).select(*keys, F.col(path).alias("path"), F.col(code).alias("code"))
    return bad.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("path", "code"))).where(F.col("rank") <= shown)


def commitment(df: DataFrame, keys: tuple[str, ...], identity: Column) -> DataFrame:
    """A hash of the multiset of identities by key, whatever their order; duplicates count.

    Identities are hashed and counted, and the hashes form a tree by their first 6 and 3 hex digits: a node is the
    hash of its children in order. An inner node has at most 4,096 children and a leaf a sixteen-millionth of the
    distinct hashes, so no list grows with the window; copies are a count.
    """
    hashed = df.select(*keys, F.sha2(F.coalesce(identity, F.lit("")), 256).alias("h"))
    level = hashed.groupBy(*keys, "h").agg(F.count("*").alias("n")).withColumn("t", F.concat_ws("*", "h", F.col("n").cast("string")))
    node = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "t"))), lambda s: s["t"]), ","), 256)
    for digits in (6, 3):
        level = level.groupBy(*keys, F.substring("h", 1, digits).alias("p")).agg(node.alias("t"), F.sum("n").alias("n")).withColumnRenamed("p", "h")
    return level.groupBy(*keys).agg(node.alias("commitment"), F.sum("n").alias("samples"))


def profile_id(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with an id over some of its columns as texts, so equal data has an equal id in either role."""
    text = {f: F.coalesce(F.format_string("%.12e", f) if dict(df.dtypes)[f] == "double" else F.col(f).cast("string"), F.lit("null")) for f in fields}
    return df.withColumn("profile_id", F.sha2(canonical(**text), 256))
