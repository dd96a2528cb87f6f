"""Exact quantiles by key without holding a key's values in one buffer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.relational import running_sum
from proofline.session import cut

#: Values of a key up to which its quantiles are taken from one buffer; beyond, error of the sketch as a share of the
#: rows (its inverse), and how many errors a bracket reaches to either side.
PLAIN = 100_000
ACCURACY = 10_000
REACH = 4


def _beside(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each key (one in all without keys); null keys match."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(named, match, "left").drop(*(f"_right_{k}" for k in keys))


def with_quantiles(df: DataFrame, keys: tuple[str, ...], value: Column, quantiles: dict[str, float], *aggregates: Column, plain: int | None = None) -> DataFrame:
    """``aggregates`` by key, and interpolated quantiles of ``value`` by name, exactly as ``percentile`` gives them.

    The values are counted first. Where no key has more than ``plain`` (``PLAIN``) of them, one aggregation gives all.
    Else a sketch of bounded size brackets each quantile, a second pass counts what lies below a bracket and the
    different values inside it, and these are ranked by range partitions, so a task orders a partition's share of a
    thousandth of the rows and no buffer holds a key. Nulls are left out; without values a quantile is null. Keys may
    be null; without keys there is one row, also for an empty table.
    """
    rows = df.withColumn("_value", value)
    largest = rows.groupBy(*keys).agg(F.count("_value").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if largest <= (PLAIN if plain is None else plain):
        return rows.groupBy(*keys).agg(*aggregates, *(F.percentile(F.col("_value").cast("double"), F.lit(q)).alias(n) for n, q in quantiles.items()))
    return _bracketed(rows, keys, quantiles, aggregates)


def _bracketed(rows: DataFrame, keys: tuple[str, ...], quantiles: dict[str, float], aggregates: tuple[Column, ...]) -> DataFrame:
    """Quantiles of keys of any size: brackets, counts, ranks."""
    names, qs = list(quantiles), list(quantiles.values())
    slack = REACH / ACCURACY
    ends = [max(0.0, q - slack) for q in qs] + [min(1.0, q + slack) for q in qs]
    sketch = F.percentile_approx("_value", F.array(*map(F.lit, ends)), ACCURACY)
    # written, since it is read for the brackets and for the result
    first = cut(rows.groupBy(*keys).agg(*aggregates, F.count("_value").alias("_n"), F.min("_value").alias("_min"), F.max("_value").alias("_max"), sketch.alias("_ends")), "quantiles")
    # up to 20,000 rows the whole range is the bracket, as the sketch's ranks are too coarse there
    few = F.col("_n") <= 2 * ACCURACY
    low = [F.when(few, F.col("_min")).otherwise(F.get("_ends", F.lit(i))) for i in range(len(qs))]
    high = [F.when(few, F.col("_max")).otherwise(F.get("_ends", F.lit(i + len(qs)))) for i in range(len(qs))]
    bounds = first.select(*keys, "_n", F.array(*low).alias("_low"), F.array(*high).alias("_high"))

    v, at = F.col("_value"), lambda c, i: F.get(c, F.lit(i))
    marks = F.explode(F.array(*(F.when(v <= at("_high", i), F.struct(F.lit(i).alias("i"), F.when(v >= at("_low", i), v).alias("x"))) for i in range(len(qs)))))
    marked = _beside(rows.select(*keys, "_value").where("_value IS NOT NULL"), bounds, keys).select(*keys, "_n", marks.alias("_m"))
    counts = marked.where("_m IS NOT NULL").groupBy(*keys, "_m.i", "_m.x").agg(F.count("*").alias("c"), F.max("_n").alias("n"))
    # what lies below a bracket has no value and comes first
    ranked = running_sum(counts, (*keys, "i"), ("x",), F.col("c")).withColumnRenamed("running", "_end")
    ranked = ranked.withColumn("_place", F.get(F.array(*map(F.lit, qs)), F.col("i")) * (F.col("n") - 1))
    holds = lambda rank: F.max(F.when((F.col("_end") - F.col("c") <= rank) & (rank < F.col("_end")), F.col("x")))
    found = ranked.groupBy(*keys, "i").agg(holds(F.floor("_place")).alias("a"), holds(F.ceil("_place")).alias("b"), F.max(F.col("_place") - F.floor("_place")).alias("t"))
    between = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(F.col("a") * (1 - F.col("t")) + F.col("b") * F.col("t"))
    wide = found.withColumn("_q", between).groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)))
    return _beside(first.drop("_n", "_min", "_max", "_ends"), wide, keys)
