"""Draining a stream of audit intents into hash chains, exactly once.

Each micro-batch goes through ``foreachBatch``: intents that are new join those the batch before held back, deliverable
ones become records after the heads of their chains, and records, heads and what is still held are written to folders of
this batch. Everything a batch reads was written by the batch before it, and nothing depends on the clock, so a batch
that is run again (Spark repeats one whose end was not recorded) overwrites its folders with the same rows: the key of
a delivery is (chain, batch). The marker of a batch is written last; readers see batches with a marker only.

A chain whose oldest pending intent can't be delivered is held back until an intent of the same key replaces it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from proofline.operators import audit

INTENT = ("chain", "event_key", "event_type", "asset_type", "asset_id", "payload_json", "payload_hash", "created_at", "ts")
_HEADS = "chain string, audit_sequence long, record_hash string"


class Store:
    """The folders of a drain: ``records``, ``heads`` and ``held``, each by batch, and the markers of finished batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, part: str, batch: int) -> str:
        return f"{self.path}/{part}/batch={batch:012d}"

    def write(self, df: DataFrame, part: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.at(part, batch))

    def read(self, part: str, batch: int, schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.at(part, batch))

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def finish(self, batch: int) -> None:
        fs, where = self._fs(self.at("finished", batch))
        fs.create(where, True).close()

    def finished(self) -> list[int]:
        """Numbers of the batches that have a marker: one listing on the driver, an entry a batch."""
        fs, where = self._fs(f"{self.path}/finished")
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where)) if fs.exists(where) else []

    def records(self, schema: T.StructType | str) -> DataFrame:
        """The log: records of all finished batches."""
        folders = [self.at("records", b) for b in self.finished()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def record_schema(spark: SparkSession, intents: T.StructType) -> T.StructType:
    """Columns of the records that intents of a schema become."""
    return audit.build(spark.createDataFrame([], intents), "chain", ("created_at", "event_key"), keep=("event_key", "payload_hash")).schema


def deliver(store: Store, rows: DataFrame, batch: int, before_marker: Callable[[int], None] | None = None) -> None:
    """One micro-batch. Intents whose key was delivered before are left out; of several with one key the first counts.

    A key that was delivered for another payload stays delivered: the difference is reported by ``audit.stage``.
    """
    spark = store.spark
    intents = rows.select(*INTENT)
    done = store.finished()
    if done and batch < done[-1]:
        raise ValueError(f"batch {batch} comes after batch {done[-1]}: the checkpoint is not that of this store")
    earlier = [b for b in done if b < batch]
    schema = record_schema(spark, intents.schema)
    if earlier:
        waiting = store.read("held", earlier[-1], intents.schema).withColumn("_turn", F.lit(0)).unionByName(intents.withColumn("_turn", F.lit(1)))
        heads = store.read("heads", earlier[-1], _HEADS)
        log = spark.read.schema(schema).parquet(*(store.at("records", b) for b in earlier))
        waiting = waiting.join(log.select("event_key"), "event_key", "left_anti")
    else:
        waiting = intents.withColumn("_turn", F.lit(1))
        heads = spark.createDataFrame([], _HEADS)
    sound = F.col("payload_hash").eqNullSafe(F.sha2("payload_json", 256))
    # an intent that can be delivered replaces a held one of its key that cannot
    first = Window.partitionBy("event_key").orderBy(sound.desc(), "_turn", "created_at", "payload_hash")
    once = waiting.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_turn")
    judged = audit.judged(once.withColumn("status", F.lit("PENDING"))).drop("status")
    held_from = Window.partitionBy("chain").orderBy("created_at", "event_key").rowsBetween(Window.unboundedPreceding, 0)
    turned = judged.withColumn("_held", F.count("problem").over(held_from) > 0).drop("problem")
    store.write(turned, "judged", batch)
    turned = store.read("judged", batch, turned.schema)
    body = turned.where(~F.col("_held")).drop("_held").withColumn("payload_json", F.coalesce(F.get_json_object("payload_json", "$.payload"), F.lit("null")))
    store.write(audit.build(body, "chain", ("created_at", "event_key"), heads, ("event_key", "payload_hash")), "records", batch)
    store.write(turned.where("_held").select(*INTENT), "held", batch)
    now = audit.heads(store.read("records", batch, schema))
    store.write(now.unionByName(heads.join(now.select("chain"), "chain", "left_anti")), "heads", batch)
    if before_marker:
        before_marker(batch)
    store.finish(batch)


def drain_stream(intents: DataFrame, path: str, checkpoint: str, before_marker: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Start draining a streaming table of intents (``INTENT`` columns) into the store at ``path``."""
    store = Store(intents.sparkSession, path)
    writer = intents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: deliver(store, rows, batch, before_marker))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
