"""Catalogue: structured streams, run to the end of their input, and time-windowed profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators import profile
from proofline.plans import gates, runs
from proofline.session import cut, shared_dir, table
from proofline.sources import ledger, sinks
from proofline.streaming import acceptance, outbox, windows

#: Seconds for which the query with a retention remembers what it accepted.
RETAIN_S = 6 * 3600


def finished(stream: DataFrame, name: str) -> DataFrame:
    """The rows of a stream in append mode once its input is used up; sink and checkpoint are in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def receipt_accept_stream(spark, sf_dir):
    rows = cut(runs._receipts(spark, sf_dir), "receipts")
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    return finished(acceptance.accept_stream(stream), "accepted")


def receipt_accept_retained(spark, sf_dir):
    """Acceptance that forgets nonces and hashes after ``RETAIN_S`` seconds; the highest sequence stays."""
    rows = cut(runs._receipts(spark, sf_dir), "receipts")
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    return finished(acceptance.accept_stream(stream, RETAIN_S), "retained")


def outbox_drain_stream(spark, sf_dir):
    """Pending intents drained in three runs of one stream, each over the orders that came since the run before."""
    intents = gates._outbox(spark, sf_dir).where("status = 'PENDING'").withColumn("chain", F.col("chain").cast("string")).select(*outbox.INTENT)
    at = f"{shared_dir(spark).rstrip('/')}/drain-{uuid.uuid4().hex}"
    most = intents.agg(F.max("created_at")).first()[0] or 0
    stream = None
    for i in range(3):
        # the first run has no lower bound, so keys below zero drain, too
        part = intents.where(F.col("created_at") <= (i + 1) * most // 3)
        part = part.where(F.col("created_at") > i * most // 3) if i else part
        part.write.mode("append").parquet(f"{at}/in")
        stream = stream if stream is not None else spark.readStream.schema(intents.schema).parquet(f"{at}/in")
        outbox.drain_stream(stream, f"{at}/store", f"{at}/checkpoint").awaitTermination()
    log = outbox.Store(spark, f"{at}/store").records(outbox.record_schema(spark, intents.schema))
    return log.select("chain", "event_key", "sequence", "audit_id", "payload_json")


def ledger_ingest(spark, sf_dir):
    """Two ingests into one ledger: what became of the second's rows, and the version that the table has then."""
    c = table(spark, sf_dir, "customer")
    first = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("body"))
    second = c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "other").otherwise(F.col("c_name")).alias("body"))
    at = f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    sinks.append_created(first, at, "c_custkey", "body")
    status = sinks.append_created(second, at, "c_custkey", "body")
    stored = ledger.read(spark, at, first.schema).select("c_custkey", F.col("body").alias("stored"))
    return status.join(stored, "c_custkey", "left").select("c_custkey", "status", "stored", F.lit(ledger.version(at)).alias("version"))


def windowed_profile(spark, sf_dir):
    """The numeric profile with an hour as the segment."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.window("ts", "1 hour")["start"])
    values = profile.long_form(e, ("value",), ("hour", "event_type"))
    found = profile.numeric_profile(values, ("hour", "event_type", "feature"))
    return found.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "count", F.round("mean", 6).alias("mean"), F.round("q95", 6).alias("q95"))


def windowed_counts_stream(spark, sf_dir):
    """Counts by hour and type on a stream with a watermark; the last, still open hours stay in its state."""
    schema = table(spark, sf_dir, "events").schema
    # the folder is named so that only Spark has to reach it
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(cut(table(spark, sf_dir, "events"), "events").inputFiles()[0].rsplit("/", 1)[0])
    return finished(windows.counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "30 minutes", "event_type"), "hours").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


#: The fold of ``runs.FOLD`` with the time of each accepted value, so that only what is recent enough counts.
_RETAINED = f"""RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
q AS (SELECT user_id::VARCHAR AS stream_key, event_id, n, ts, sha256((CASE WHEN n % 13 = 0 THEN n - 1 ELSE n END) || '|' || user_id) AS h, 'n' || (CASE WHEN n % 11 = 0 THEN n - 2 ELSE n END) AS nonce,
  CASE WHEN n % 7 = 0 THEN n - 3 ELSE n END AS s, CASE WHEN event_id % 31 = 0 THEN 400 WHEN event_id % 37 = 0 THEN -60 ELSE 5 END AS age, event_id % 29 <> 0 AS ok FROM e),
f AS (SELECT DISTINCT stream_key, 0::BIGINT AS n, NULL::BIGINT AS receipt_id, []::STRUCT(x VARCHAR, h VARCHAR, t TIMESTAMP)[] AS seen, NULL::BIGINT AS top, NULL::VARCHAR AS reasons FROM q
  UNION ALL SELECT stream_key, n, receipt_id, CASE WHEN r = '' THEN list_append(seen, {{'x': nonce, 'h': h, 't': ts::TIMESTAMP}}) ELSE seen END, CASE WHEN r = '' THEN s ELSE top END, r FROM (
    SELECT stream_key, n, event_id AS receipt_id, seen, top, nonce, h, s, ts, concat_ws(',', CASE WHEN NOT ok THEN 'CHECKS_INVALID' END, CASE WHEN age > 300 THEN 'STALE_RECEIPT' WHEN age < -30 THEN 'FUTURE_TIMESTAMP' END,
      CASE WHEN len(list_filter(recent, lambda v: v.x = nonce)) > 0 THEN 'NONCE_REUSE' END, CASE WHEN len(list_filter(recent, lambda v: v.h = h)) > 0 THEN 'REPLAY_DETECTED' END,
      CASE WHEN s = top THEN 'DUPLICATE_SEQUENCE' WHEN s < top THEN 'SEQUENCE_REGRESSION' END) AS r
    FROM (SELECT f.stream_key, q.n, q.event_id, seen, top, nonce, h, s, q.ts, ok, age, list_filter(seen, lambda v: q.ts::TIMESTAMP - v.t <= INTERVAL {RETAIN_S} SECOND) AS recent FROM f JOIN q ON q.stream_key = f.stream_key AND q.n = f.n + 1))),
w AS (SELECT stream_key, receipt_id, CASE WHEN reasons = '' THEN 'ACCEPT' ELSE 'REJECT' END AS status, reasons FROM f WHERE n > 0)"""

QUERIES = {
    "receipt_accept_stream": (receipt_accept_stream, f"WITH {runs.FOLD} SELECT * FROM w"),
    "receipt_accept_retained": (receipt_accept_retained, f"WITH {_RETAINED} SELECT * FROM w"),
    "outbox_drain_stream": (
        outbox_drain_stream,
        """WITH w AS (SELECT o_custkey AS chain, o_orderkey AS k, sum((o_orderkey % 40 = 3 OR o_orderkey % 45 = 2)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS held FROM orders WHERE o_orderstatus = 'O'),
d AS (SELECT chain, k, row_number() OVER (PARTITION BY chain ORDER BY k) AS sequence FROM w WHERE held = 0)
SELECT chain::VARCHAR AS chain, 'e' || k AS event_key, sequence, printf('AUD-%08d', sequence) AS audit_id, '{"s":"O"}' AS payload_json FROM d""",
    ),
    "ledger_ingest": (
        ledger_ingest,
        """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CONFLICT' WHEN c_custkey % 2 = 0 THEN 'EXISTS' ELSE 'CREATED' END AS status, c_name AS stored, 2 AS version FROM customer""",
    ),
    "windowed_profile": (windowed_profile, "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS q95 FROM events WHERE value IS NOT NULL GROUP BY ALL"),
    "windowed_counts_stream": (windowed_counts_stream, "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE GROUP BY ALL"),
}
