"""Generic table operations: listings, search, idempotent ingest, named differences, state logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import cut


def paginate(df: DataFrame, filters: dict, order: tuple[str, ...], offset: int, limit: int) -> DataFrame:
    """A page of the rows that equal all given values, in a total order, with the ``total`` that match."""
    matched = reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in filters.items() if v is not None), df)
    total = matched.agg(F.count("*").alias("total"))
    return matched.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def search(df: DataFrame, text: str, columns: tuple[str, ...], filters: dict | None = None) -> DataFrame:
    """Rows whose columns hold a text in any case, and equal all given values."""
    found = df.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), (filters or {}).items(), found)


def ingest_status(incoming: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """Incoming rows with ``status``: CREATED, EXISTS for equal content under the key, CONFLICT for other content.

    Of incoming rows that share a key the smallest content stands for it; of equal ones the first by the other columns
    (maps aside) is the one that is created.
    """
    known = stored.select(F.col(key), F.col(content).alias("_stored")).dropDuplicates([key])
    others = [name for name, kind in incoming.dtypes if name not in (key, content) and "map<" not in kind]
    first = Window.partitionBy(key).orderBy(content, *others)
    ranked = incoming.withColumn("_first", F.min(content).over(Window.partitionBy(key))).withColumn("_n", F.row_number().over(first))
    base = F.coalesce("_stored", "_first")
    status = F.when(F.col(content) != base, "CONFLICT").when(F.col("_stored").isNotNull() | (F.col("_n") > 1), "EXISTS").otherwise("CREATED")
    return ranked.join(known, key, "left").withColumn("status", status).drop("_stored", "_first", "_n")


def named_diff(before: DataFrame, after: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Rows by key that differ between two tables: ADDED, REMOVED or CHANGED with the columns that do. Null keys match."""
    a = before.select(*(F.col(k).alias(f"_a{k}") for k in keys), F.struct(*columns).alias("before"))
    b = after.select(*keys, F.struct(*columns).alias("after"))
    on = reduce(lambda x, y: x & y, (F.col(f"_a{k}").eqNullSafe(F.col(k)) for k in keys))
    both = a.join(b, on, "full_outer").select(*(F.coalesce(F.col(k), F.col(f"_a{k}")).alias(k) for k in keys), "before", "after")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in columns)))
    kind = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED").otherwise("CHANGED")
    found = both.withColumn("change", kind).withColumn("columns", F.when(F.col("change") == "CHANGED", changed).otherwise(F.array().cast("array<string>")))
    return found.where((F.col("change") != "CHANGED") | (F.size("columns") > 0))


def duplicates(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def current_state(log: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The last row of each key of an event log."""
    last = F.max(F.struct(*order, F.struct(*(c for c in log.columns if c not in (key, *order))).alias("_rest")))
    return log.groupBy(key).agg(last.alias("_l")).select(key, *(f"_l.{c}" for c in order), "_l._rest.*")


def transitions(log: DataFrame, key: str, order: tuple[str, ...], state: str, legal: dict[str | None, tuple[str, ...]]) -> DataFrame:
    """Events with the state before and whether the step is legal; None is the state before the first event."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    allowed: Column = F.lit(False)
    for start, ends in legal.items():
        here = before.isNull() if start is None else before == start
        allowed = allowed | F.coalesce(here & F.col(state).isin(*ends), F.lit(False))
    return log.withColumn("before", before).withColumn("is_legal", allowed)


def running_sum(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], amount: Column) -> DataFrame:
    """``df`` with ``running``, the sum of ``amount`` up to and with each row in order within its key, and ``total``, the key's.

    Rows are range-partitioned by key and order and written down with the partition they are in; a partition starts at
    the sum of those before it. So a key of any size is spread over tasks, and only one row for each key and partition
    meets in one place. Rows that tie in order are summed one after another in no set order. Null keys are a key.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_amount", amount).repartitionByRange(width, *keys, *order)
    parts = cut(ranged.withColumn("_part", F.spark_partition_id()), "running")
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col("_part").alias("_at"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias("total"),
    )
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_part") == F.col("_at"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn("running", F.sum("_amount").over(inside)).join(starts, on)
    return summed.select(*df.columns, (F.col("running") + F.col("_start")).alias("running"), "total")


def lookup(keys: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Many point lookups at once: the asked keys with the stored row, or nulls."""
    return keys.select(key).distinct().join(stored, key, "left")


def next_sequence(stored: DataFrame, sequence: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The number after the highest, by key."""
    return stored.groupBy(*keys).agg((F.coalesce(F.max(sequence), F.lit(0)) + 1).alias("next"))
