"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, passed through up to ``passes`` times. A copy's
virtual finish time is the source's cumulative size, through that copy, over the source's target. All copies are sorted
by finish time, and the mix takes them in that order while their cumulative size is within the total budget. A source
so ends within a document of its target, and within what whole documents at the end of other queues leave unspent.

Targets: sources in code-point order (null last) weigh 1, 2, ..., ``cycle``, repeating, and share the total size; a
target stops at ``passes`` times its source's size and the excess goes to the others by weight.

Both orders, of the queues and of the copies, are range partitions over the whole table: each partition sums what it
holds, the partitions' totals are summed by themselves, and nothing else meets. So no source is a group, and rows that
are alike in all columns are dealt on by their row number. The cut is one row.

Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a source; repeated rows
each count; rows that share an id are ordered by a hash of all their columns, so reruns agree; an empty table gives no
rows; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.session import cut, ship

SEED = 20_240_607


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, passes: int = 3, cycle: int = 3) -> DataFrame:
    """Per source (``source``, ``source_size``): its weight and target.

    The common level is the largest one at which no source that is below its ceiling has to give: sources are ranked
    by ceiling over weight, and the level is what the capped ones leave, over the weight of the rest.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy((F.col("ceiling") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = (
        sources.withColumn("weight", ((F.row_number().over(in_order) - 1) % cycle + 1).cast("double"))
        .withColumn("ceiling", F.col("source_size").cast("double") * passes)
        .withColumn("_full", F.coalesce(F.sum("ceiling").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_total", F.sum("source_size").over(every).cast("double"))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_weights"))
        # the first source, by ratio, whose ceiling is above the level: all before it are full
        .withColumn("_rank", F.row_number().over(by_ratio))
        .withColumn("_fits", F.when(F.col("ceiling") >= F.col("_level") * F.col("weight"), F.struct("_rank", "_level")))
        .withColumn("_at", F.coalesce(F.min("_fits").over(every)["_level"], F.lit(float("inf"))))
    )
    return ranked.select("source", "source_size", "weight", F.least(F.col("ceiling"), F.when(F.col("_at") == float("inf"), F.col("ceiling")).otherwise(F.col("_at") * F.col("weight"))).alias("target"))


def _summed(batches: Iterable[pa.RecordBatch], size: str, by: str | None) -> Iterator[pa.RecordBatch]:
    """Sorted rows with ``_part``, the partition, and ``_sum``, the running sum of ``size`` in it, per run of ``by``."""
    part, total, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sums = np.cumsum(batch.column(batch.schema.get_field_index(size)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        if by is None:
            sums += total
        else:
            column = batch.column(batch.schema.get_field_index(by))
            codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            before = np.where(begins > 0, sums[begins - 1], 0)
            if last is not None and column[0].as_py() == last[0]:
                before[0] = -total
            sums -= np.repeat(before, np.diff(np.concatenate([begins, [len(sums)]])))
            last = (column[-1].as_py(),)
        total = int(sums[-1])
        columns = [*batch.columns, pa.array(np.full(len(sums), part, dtype=np.int64)), pa.array(sums)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_sum"])


def _in_order(df: DataFrame, order: list[Column], size: str, by: str | None, name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written down with the columns of ``_summed``."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_sum", T.LongType())])
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(dealt.mapInArrow(lambda it: _summed(it, size, by), schema), name)


def mix(
    df: DataFrame, source: str = "source", size: str = "size", key: str = "doc_id", passes: int = 3, cycle: int = 3, seed: int = SEED
) -> DataFrame:
    """``df`` with ``source_size``, ``target``, ``copies`` (times the mix takes the document) and ``taken`` (its size times copies)."""
    own = {"source_size", "target", "copies", "taken", "_name", "_bare", "_turn", "_tie", "_row", "_part", "_sum", "_done", "_of", "_in", "_offset"}
    rows = df.select(*(c for c in df.columns if c.lower() not in own))
    shuffled = rows.withColumns(
        {
            "_bare": F.col(source).isNull(),
            "_name": F.coalesce(F.col(source).cast("string"), F.lit("")),
            "_turn": F.xxhash64(F.col(key), F.lit(seed)),
            "_tie": F.xxhash64(*rows.columns),
            "_row": F.monotonically_increasing_id(),
        }
    )
    queues = _in_order(shuffled, [F.col(c) for c in ("_bare", "_name", "_turn", "_tie", "_row")], size, source, "mix-queues")
    # what each partition holds of each source: a row for each partition and for each source
    sums = queues.groupBy("_part", F.col(source).alias("source")).agg(F.max("_sum").alias("s"))
    offsets = sums.withColumn("_offset", F.sum("s").over(Window.partitionBy("source").orderBy("_part")) - F.col("s"))
    aims = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), passes, cycle)
    aimed = offsets.join(aims, offsets["source"].eqNullSafe(aims["source"]))
    aimed = cut(aimed.select(offsets["source"].alias("_of"), F.col("_part").alias("_in"), "_offset", "source_size", "target"), "mix-targets")
    placed = queues.join(aimed, F.col(source).eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")))
    placed = placed.withColumn("_done", F.col("_offset") + F.col("_sum"))

    def finish(j: int | Column) -> Column:
        through = F.col("_done") + F.lit(j).cast("long") * F.col("source_size")
        return F.try_divide(through.cast("double"), F.col("target"))

    place = lambda f: F.struct(f.alias("f"), "_bare", "_name", "_done")
    copies = placed.where(F.col(size) > 0).select(F.explode(F.array(*(place(finish(j)) for j in range(passes)))).alias("at"), F.col(size).cast("long").alias("size"))
    ordered = _in_order(copies.select("at.*", "size"), [F.col(c) for c in ("f", "_bare", "_name", "_done")], "size", None, "mix-order")
    parts = ordered.groupBy("_part").agg(F.max("_sum").alias("s"))
    before = parts.select(F.col("_part").alias("_in"), (F.sum("s").over(Window.orderBy("_part")) - F.col("s")).alias("_offset"))
    budget = sums.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    within = ordered.join(before, F.col("_part") == F.col("_in")).where(F.col("_offset") + F.col("_sum") <= budget)
    end = within.agg(F.max(place(F.col("f"))).alias("end")).first()["end"]
    if end is None:
        count = F.lit(0)
    else:
        last = F.struct(F.lit(end["f"]).alias("f"), F.lit(end["_bare"]).alias("_bare"), F.lit(end["_name"]).alias("_name"), F.lit(end["_done"]).cast("long").alias("_done"))
        count = sum((F.when((F.col(size) > 0) & (place(finish(j)) <= last), 1).otherwise(0) for j in range(passes)), F.lit(0))
    decided = placed.withColumn("copies", count.cast("int")).withColumn("taken", F.coalesce(F.col("copies") * F.col(size), F.lit(0)).cast("long"))
    return decided.select(*rows.columns, "source_size", "target", "copies", "taken")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by their number of words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # a range partition reads its input twice: the words are counted before
    sizes = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken")
