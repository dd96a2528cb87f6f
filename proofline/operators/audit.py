"""Hash-chained audit logs: build, verify, outbox and checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.functions.columns import canonical
from proofline.functions.policies import GENESIS
from proofline.operators.relational import running_sum


def utc_text(ts: Column) -> Column:
    """A time in UTC to the microsecond. The session's time zone has to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


_FIELDS = ("asset_id", "asset_type", "audit_id", "event_type", "payload_json", "previous_hash", "sequence", "timestamp")


def record_hash() -> Column:
    """A record's hash over its eight fields in canonical form."""
    return F.sha2(canonical(**{f: F.col(f) for f in _FIELDS}), 256)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole chains in order, with ``_first``, ``_head`` and ``_tail``: links and hashes in place of those three."""
    before = ""
    for batch in batches:
        links, hashes = [], []
        start, first, head, tail = (batch.column(c).to_pylist() for c in ("previous_hash", "_first", "_head", "_tail"))
        for i in range(batch.num_rows):
            before = start[i] if first[i] else before
            links.append(before)
            before = hashlib.sha256((head[i] + before + tail[i]).encode()).hexdigest()
            hashes.append(before)
        kept = [c for c in batch.schema.names if c not in ("previous_hash", "_first", "_head", "_tail")]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(links, pa.string()), pa.array(hashes, pa.string())], [*kept, "previous_hash", "current_hash"])


def build(events: DataFrame, chain: str, order: tuple[str, ...], after: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Audit records of events: ids, sequence and hashes, each over the one before.

    ``events`` has chain, order columns, event_type, asset_type, asset_id, payload_json and ts. A hash chain is
    sequential by nature, chains are independent of each other: rows come sorted by chain and order and pass one by one,
    so a task holds a batch of rows and the hash before it, however many chains there are and however long one is. The
    canonical text around that hash is prepared as columns; the fold only hashes. Chains continue after the ``heads``
    given in ``after``, and the columns in ``keep`` are carried along.
    """
    by = tuple(f"_o{i}" for i in range(len(order)))
    fields = ("event_type", "asset_type", "asset_id", "payload_json", *keep)
    rows = events.select(F.col(chain).alias("chain"), *fields, *(F.col(o).alias(i) for o, i in zip(order, by)), utc_text(F.col("ts")).alias("timestamp"))
    if after is None:
        rows = rows.withColumn("_start", F.lit(0)).withColumn("previous_hash", F.lit(GENESIS))
    else:
        rows = rows.join(after.select("chain", F.col("audit_sequence").alias("_start"), F.col("record_hash").alias("previous_hash")), "chain", "left")
        rows = rows.fillna({"_start": 0, "previous_hash": GENESIS})
    # the sort is the window's own, so Spark leaves it out; it states what the fold relies on
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("chain").orderBy(*by))).sortWithinPartitions("chain", *by)
    sequence = (F.col("_rank") + F.col("_start")).cast("long")
    rows = ranked.select("chain", *fields, sequence.alias("sequence"), "timestamp", "previous_hash", (F.col("_rank") == 1).alias("_first")).withColumn("audit_id", F.format_string("AUD-%08d", "sequence"))
    ahead, behind = (canonical(**{f: F.col(f) for f in _FIELDS if f != "previous_hash" and (f < "previous_hash") == side}) for side in (True, False))
    head = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"previous_hash":"'))
    rows = rows.withColumns({"_head": ahead, "_tail": F.concat(F.lit('",'), F.substring(behind, 2, 1 << 30))}).withColumn("_head", head)
    rows = rows.select("chain", *fields, "sequence", "timestamp", "audit_id", "previous_hash", "_first", "_head", "_tail")
    text = T.StructType([T.StructField(c, T.StringType()) for c in ("previous_hash", "current_hash")])
    return rows.mapInArrow(_hashed, T.StructType([*rows.drop("previous_hash", "_first", "_head", "_tail").schema.fields, *text.fields]))


def verify(log: DataFrame) -> DataFrame:
    """Per chain: VALID or COMPROMISED, and the first broken record with the first check that it fails.

    All rows are checked side by side: the payload is canonical JSON, the link is the hash of the record before, the
    sequence has no gap, and the hash is the record's own. A record's place in its chain comes from range partitions,
    the record before from a join on that place, and the first break is a minimum; so one chain of any length is the
    work of all tasks.
    """
    own = F.coalesce(F.col("current_hash").eqNullSafe(record_hash()), F.lit(False))
    sound = F.col("payload_json").isNotNull() & F.try_parse_json("payload_json").isNotNull()
    checked = log.select("chain", "sequence", "audit_id", "previous_hash", "current_hash", sound.alias("_sound"), own.alias("_own"))
    placed = running_sum(checked, ("chain",), ("sequence", "audit_id"), F.lit(1)).withColumnRenamed("running", "_at").drop("total")
    before = placed.select(F.col("chain").alias("_chain"), (F.col("_at") + 1).alias("_next"), F.col("current_hash").alias("_before"))
    linked = placed.join(before, F.col("chain").eqNullSafe(F.col("_chain")) & (F.col("_at") == F.col("_next")), "left")
    broken = (
        F.when(~F.col("_sound"), "AUDIT_RECORD_MALFORMED")
        .when(~F.col("previous_hash").eqNullSafe(F.coalesce("_before", F.lit(GENESIS))), "AUDIT_CHAIN_LINK_FAILURE")
        .when(F.col("sequence") != F.col("_at"), "AUDIT_SEQUENCE_VIOLATION")
        .when(~F.col("_own"), "AUDIT_RECORD_TAMPERING")
    )
    found = linked.withColumn("_broken", broken)
    first = F.min_by(F.struct("audit_id", "_broken"), F.when(F.col("_broken").isNotNull(), F.col("_at")))
    summed = found.groupBy("chain").agg(F.count("*").alias("records"), F.count("_broken").alias("_n"), first.alias("f"))
    state = F.when(F.col("_n") == 0, "VALID").otherwise("COMPROMISED")
    shown = lambda c: F.when(F.col("_n") > 0, F.col(f"f.{c}"))
    return summed.select("chain", "records", state.alias("status"), shown("audit_id").alias("first_broken"), shown("_broken").alias("code"))


def stage(intents: DataFrame, outbox: DataFrame) -> DataFrame:
    """What becomes of intents against an outbox, by event_key: CREATED, EXISTS for the same payload, CONFLICT for another.

    The first intent of a key (by ``intent_id``) stands for it; later ones are compared with it.
    """
    hashed = intents.withColumn("payload_hash", F.sha2("payload_json", 256))
    first = hashed.groupBy("event_key").agg(F.min(F.struct("intent_id", "payload_hash"))["payload_hash"].alias("first_hash"), F.min("intent_id").alias("first_id"))
    known = outbox.select("event_key", F.col("payload_hash").alias("stored"))
    joined = hashed.join(first, "event_key").join(known, "event_key", "left")
    base = F.coalesce("stored", "first_hash")
    status = F.when(F.col("payload_hash") != base, "CONFLICT").when(F.col("stored").isNotNull() | (F.col("intent_id") != F.col("first_id")), "EXISTS").otherwise("CREATED")
    return joined.select("intent_id", "event_key", "payload_hash", status.alias("status"))


def outbox_status(outbox: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pending and delivered intents and the oldest pending one."""
    pending = F.col("status") == "PENDING"
    return outbox.groupBy(*keys).agg(F.count_if(pending).alias("pending"), F.count_if(F.col("status") == "DELIVERED").alias("delivered"), F.min(F.when(pending, F.col("created_at"))).alias("oldest_pending"))


def heads(log: DataFrame) -> DataFrame:
    """The last record of each chain."""
    return log.groupBy("chain").agg(F.max(F.struct("sequence", "current_hash", "audit_id")).alias("h")).select("chain", F.col("h.sequence").alias("audit_sequence"), F.col("h.current_hash").alias("record_hash"))


def checkpoint_hash() -> Column:
    """A checkpoint's hash over its place, the record's hash and the checkpoint before."""
    return F.sha2(canonical(audit_sequence=F.col("audit_sequence"), previous_checkpoint_hash=F.col("previous_checkpoint_hash"), record_hash=F.col("record_hash")), 256)


def checkpoints(log: DataFrame, every: int) -> DataFrame:
    """Checkpoints of chains at every ``every``-th record, each linked to the one before by its record's hash."""
    at = log.where(F.col("sequence") % every == 0).select("chain", F.col("sequence").alias("audit_sequence"), F.col("current_hash").alias("record_hash"))
    link = F.coalesce(F.lag("record_hash").over(Window.partitionBy("chain").orderBy("audit_sequence")), F.lit(GENESIS))
    return at.withColumn("previous_checkpoint_hash", link).withColumn("checkpoint_hash", checkpoint_hash())


def verify_checkpoints(points: DataFrame, log: DataFrame) -> DataFrame:
    """Each checkpoint against its chain: its own hash, its link, the chain's length, and the record it names."""
    link = F.coalesce(F.lag("record_hash").over(Window.partitionBy("chain").orderBy("audit_sequence")), F.lit(GENESIS))
    linked = points.withColumn("_link", link)
    joined = linked.join(log.select("chain", F.col("sequence").alias("audit_sequence"), F.col("current_hash").alias("_now")), ["chain", "audit_sequence"], "left")
    status = (
        F.when(~F.col("checkpoint_hash").eqNullSafe(checkpoint_hash()), "CHECKPOINT_TAMPERED")
        .when(~F.col("previous_checkpoint_hash").eqNullSafe(F.col("_link")), "CHECKPOINT_CHAIN_BROKEN")
        .when(F.col("_now").isNull(), "HISTORY_SHORTER")
        .when(F.col("_now") != F.col("record_hash"), "HEAD_MISMATCH")
        .otherwise("VALID")
    )
    return joined.select("chain", "audit_sequence", status.alias("status"))


def judged(outbox: DataFrame) -> DataFrame:
    """Pending intents with ``problem``, the first thing that forbids delivery, or null.

    Where the outbox has event_type, asset_type and asset_id, the body has to name the same ones.
    """
    problem = F.when(~F.col("payload_hash").eqNullSafe(F.sha2("payload_json", 256)), "PAYLOAD_HASH_MISMATCH").when(F.try_parse_json("payload_json").isNull(), "PAYLOAD_MALFORMED").when(F.col("event_key").isNull(), "KEY_MISSING")
    for c in ("event_type", "asset_type", "asset_id"):
        if c in outbox.columns:
            problem = problem.when(~F.get_json_object("payload_json", f"$.{c}").eqNullSafe(F.col(c)), "BODY_MISMATCH")
    return outbox.where("status = 'PENDING'").withColumn("problem", problem)


def drainable(outbox: DataFrame) -> DataFrame:
    """The same in order of creation."""
    return judged(outbox).orderBy("created_at", "event_key")


def drain(outbox: DataFrame, log: DataFrame, delivered: DataFrame, chain: str = "chain") -> DataFrame:
    """The records that delivering the outbox now appends to the log, with the event_key of each.

    Pending intents go in order of creation; the first of a chain that can't be delivered holds back all behind it.
    Those whose key ``delivered`` names are left out, so a drain that is run again delivers nothing twice.
    """
    before = Window.partitionBy(chain).orderBy("created_at", "event_key").rowsBetween(Window.unboundedPreceding, 0)
    waiting = judged(outbox.join(delivered.select("event_key"), "event_key", "left_anti"))
    free = waiting.withColumn("_held", F.count("problem").over(before)).where(F.col("_held") == 0)
    body = free.withColumn("payload_json", F.coalesce(F.get_json_object("payload_json", "$.payload"), F.lit("null")))
    return build(body, chain, ("created_at", "event_key"), heads(log), ("event_key",))


def checkpoint_refusals(log: DataFrame, pending: DataFrame, latest: DataFrame) -> DataFrame:
    """For each chain, why no checkpoint is made now, or null: intents pending, or the head already has one."""
    waiting = pending.groupBy("chain").agg(F.count("*").alias("_pending"))
    joined = heads(log).join(waiting, "chain", "left").join(latest.select("chain", F.col("record_hash").alias("_last")), "chain", "left")
    reason = F.when(F.coalesce("_pending", F.lit(0)) > 0, "INTENTS_PENDING").when(F.col("_last").eqNullSafe(F.col("record_hash")), "HEAD_UNCHANGED")
    return joined.withColumn("reason", reason).drop("_pending", "_last")
