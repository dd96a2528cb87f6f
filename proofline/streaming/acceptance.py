"""Receipt acceptance with replay protection: one rule, in batch and on a stream.

A receipt is accepted when its checks hold, it is fresh, and neither its nonce, its hash nor its sequence was accepted
before or is behind. A rejected receipt changes nothing. Order is arrival: (received_at, receipt_id).

What was accepted is remembered for ever, or for ``retain_s`` seconds of arrival time. A replay of the receipt itself
is stale after the freshness bound anyway, and the highest sequence is never forgotten; so a retention above
``MAX_AGE_S`` plus ``MAX_SKEW_S`` only forgets nonces that come back in receipts with a higher sequence.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MAX_AGE_S, MAX_SKEW_S = 300, 30
INPUT = ("stream_key", "receipt_id", "receipt_hash", "nonce", "sequence", "issued_at", "received_at", "checks_valid")
OUTPUT = "stream_key string, receipt_id long, status string, reasons string"
_OUTCOME = Row("stream_key", "receipt_id", "status", "reasons")
#: The store that keeps map states on disk, one entry a key.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of arrival that leave a stream's state together.
BUCKET_S = 60
#: Nonces and hashes on one page of a stream's state.
PAGE = 16


def judge(checks_valid: Any, age_s: float, sequence: int, nonce_known: bool, hash_known: bool, highest: int | None) -> list[str]:
    """Why a receipt of that age is refused; none: accepted.

    Sequences at or below the highest are refused, so accepted ones only rise and equality is the one duplicate that
    the highest shows; an older one shows as a regression.
    """
    reasons = [] if checks_valid is True or checks_valid == 1 else ["CHECKS_INVALID"]
    reasons += ["STALE_RECEIPT"] if age_s > MAX_AGE_S else ["FUTURE_TIMESTAMP"] if age_s < -MAX_SKEW_S else []
    reasons += ["NONCE_REUSE"] if nonce_known else []
    reasons += ["REPLAY_DETECTED"] if hash_known else []
    if highest is not None and sequence <= highest:
        reasons.append("DUPLICATE_SEQUENCE" if sequence == highest else "SEQUENCE_REGRESSION")
    return reasons


class _Accepted:
    """Nonces and hashes of one key with the time they were accepted, forgotten in order of time."""

    def __init__(self, retain_s: float | None):
        self.retain = None if retain_s is None else timedelta(seconds=retain_s)
        self.nonces: dict[str, datetime] = {}
        self.hashes: dict[str, datetime] = {}
        self.order: deque = deque()
        self.highest: int | None = None

    def verdict(self, r: Any) -> list[str]:
        while self.retain is not None and self.order and r.received_at - self.order[0][0] > self.retain:
            at, nonce, digest = self.order.popleft()
            for known, value in ((self.nonces, nonce), (self.hashes, digest)):
                if known.get(value) == at:
                    del known[value]
        age_s = (r.received_at - r.issued_at).total_seconds()
        reasons = judge(r.checks_valid, age_s, r.sequence, r.nonce in self.nonces, r.receipt_hash in self.hashes, self.highest)
        if not reasons:
            self.nonces[r.nonce] = self.hashes[r.receipt_hash] = r.received_at
            if self.retain is not None:
                self.order.append((r.received_at, r.nonce, r.receipt_hash))
            self.highest = int(r.sequence)
        return reasons


def accept_batch(receipts: DataFrame, retain_s: float | None = None) -> DataFrame:
    """Verdicts of a whole table.

    A stream of receipts (one key) is sequential by nature, keys are independent: rows come sorted by key and arrival
    and pass one by one, so a task holds what a key remembers, never its history of rows.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, memory = None, _Accepted(retain_s)
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if r.stream_key != key:
                    key, memory = r.stream_key, _Accepted(retain_s)
                reasons = memory.verdict(r)
                out.append((r.stream_key, r.receipt_id, "REJECT" if reasons else "ACCEPT", ",".join(reasons)))
            yield pd.DataFrame(out, columns=["stream_key", "receipt_id", "status", "reasons"])

    in_order = receipts.select(*INPUT).repartition("stream_key").sortWithinPartitions("stream_key", "received_at", "receipt_id")
    return in_order.mapInPandas(run, OUTPUT)


def _named(kind: str, value: str | None) -> str:
    """A nonce (``n``) or hash (``h``) as it is remembered; the null one has a name of its own."""
    return kind.upper() if value is None else kind + value


class _Pages:
    """What a key remembers on a stream, ``{named value: microseconds of arrival}``, as pages of a map state.

    A page holds about ``PAGE`` values. Linear hashing says which page a value is in: pages are split one at a time as
    values come and merged as they go, so a value is sought in one page however many there are. A batch reads a page
    once and writes it once, whatever the number of its values that it asks for.
    """

    def __init__(self, state, pages: int, values: int):
        self.state, self.pages, self.values, self.fresh = state, pages, values, values == 0
        self.open: dict[int, dict[str, int]] = {}
        self.changed: set[int] = set()

    def number(self, value: str) -> int:
        low = 1 << self.pages.bit_length() - 1
        at = zlib.crc32(value.encode("utf-8", "surrogatepass")) & 2 * low - 1
        return at if at < self.pages else at - low

    def page(self, number: int) -> dict[str, int]:
        if number not in self.open:
            stored = None if self.fresh else self.state.getValue((number,))
            self.open[number] = json.loads(stored[0]) if stored else {}
        return self.open[number]

    def get(self, value: str) -> int | None:
        return self.page(self.number(value)).get(value)

    def put(self, value: str, at_us: int) -> None:
        number = self.number(value)
        page = self.page(number)
        self.values += value not in page
        page[value] = at_us
        self.changed.add(number)

    def fit(self) -> None:
        """As many pages as the values need: split where they are more, merge where they are a quarter of that."""
        if self.fresh:  # nothing is stored, all values are on the one page: dealt at once
            values, self.pages, self.open = self.open.get(0, {}), max(1, -(-self.values // PAGE)), {}
            for v, at in values.items():
                self.open.setdefault(self.number(v), {})[v] = at
            self.changed = set(self.open)
        while self.values > PAGE * self.pages:
            split = self.pages - (1 << self.pages.bit_length() - 1)
            page = self.page(split)
            self.pages += 1
            self.open[self.pages - 1] = {v: at for v, at in page.items() if self.number(v) != split}
            self.open[split] = {v: at for v, at in page.items() if self.number(v) == split}
            self.changed |= {split, self.pages - 1}
        while self.pages > 1 and 4 * self.values < PAGE * self.pages:
            last = self.page(self.pages - 1)
            self.pages -= 1
            into = self.pages - (1 << self.pages.bit_length() - 1)
            self.page(into).update(last)
            self.open[self.pages] = {}
            self.changed |= {into, self.pages}

    def write(self) -> None:
        for number in sorted(self.changed):
            if self.open[number]:
                self.state.updateValue((number,), (json.dumps(self.open[number]),))
            elif not self.fresh:
                self.state.removeKey((number,))
        self.open, self.changed, self.fresh = {}, set(), False

    def forget(self, gone: Callable[[int], bool]) -> int:
        """Drop the values whose time is ``gone``, a page at a time; returns the earliest time that is left."""
        earliest = None
        for number in range(self.pages):
            page = self.page(number)
            kept = {v: at for v, at in page.items() if not gone(at)}
            earliest = min((at for at in (earliest, *kept.values()) if at is not None), default=None)
            if len(kept) < len(page):
                self.values -= len(page) - len(kept)
                self.open[number] = kept
                self.changed.add(number)
            self.write()
        self.fit()
        self.write()
        return earliest


class Acceptance(StatefulProcessor):
    """The same with the state of a key in a store: its nonces and hashes in pages, and the highest sequence.

    Each call to the store is a message, so a batch asks for pages, not for values (``_Pages``), and asks nothing of a
    key that has accepted nothing yet; it costs what it holds, however much was accepted before. With a retention, a key
    has one timer, which drops what is old by the watermark. It comes when the first value may go, then after a quarter of
    the retention at least, so a value is read a bounded number of times. (``highest`` has other columns than it had
    when values were entries, so Spark refuses a checkpoint of that time instead of forgetting what it holds.)
    """

    def __init__(self, retain_s: float | None):
        self.retain_s = retain_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "page int", "entries string")
        self.highest = handle.getValueState("highest", "sequence long, pages int, entries long, newest_us long")

    def _known(self, at_us: int | None, now_us: int) -> bool:
        return at_us is not None and (self.retain_s is None or now_us - at_us <= self.retain_s * 1e6)

    def _until(self, at_us: int) -> int:
        """The end, in milliseconds, of the bucket in which an entry may be forgotten."""
        ms = int(at_us / 1000 + self.retain_s * 1000)
        return (ms // (BUCKET_S * 1000) + 1) * BUCKET_S * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        highest, pages, entries, newest = self.highest.get() or (None, 1, 0, 0)
        memory = _Pages(self.seen, pages, entries)
        accepted = []
        # the rows of one key in one micro-batch
        for now, ident, age_us, valid, sequence, nonce, digest, *_ in sorted((tuple(r[1:]) for r in rows), key=itemgetter(0, 1)):
            named = (_named("n", nonce), _named("h", digest))
            reasons = judge(valid, age_us / 1e6, sequence, *(self._known(memory.get(v), now) for v in named), highest)
            if not reasons:
                for v in named:
                    memory.put(v, now)
                highest = int(sequence)
                accepted.append(now)
            yield _OUTCOME(key[0], ident, "REJECT" if reasons else "ACCEPT", ",".join(reasons))
        if accepted:
            memory.fit()
            memory.write()
            self.highest.update((highest, memory.pages, memory.values, max(newest, *accepted)))
            # a key has a timer while it has entries
            if self.retain_s is not None and entries == 0:
                self.handle.registerTimer(self._until(min(accepted)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        highest, pages, entries, newest = self.highest.get()
        now = timerValues.getCurrentWatermarkInMs()
        if self._until(newest) <= now:
            self.seen.clear()
            self.highest.update((highest, 1, 0, newest))
            return iter(())
        memory = _Pages(self.seen, pages, entries)
        earliest = memory.forget(lambda at_us: self._until(at_us) <= now)
        self.highest.update((highest, memory.pages, memory.values, newest))
        self.handle.registerTimer(max(self._until(earliest), now + int(self.retain_s * 250)))
        return iter(())

    def close(self) -> None:
        pass


def accept_stream(receipts: DataFrame, retain_s: float | None = None, late: str = "1 hour") -> DataFrame:
    """Verdicts on a streaming table, in append mode; sets the session's state store to one that keeps maps.

    With a retention, arrival time carries a watermark, and receipts more than ``late`` behind the newest are not
    judged (so they are not accepted); without one, every receipt is judged and the state only grows.
    """
    receipts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    now, age = F.unix_micros("received_at"), F.unix_micros("received_at") - F.unix_micros("issued_at")
    if retain_s is not None:
        receipts = receipts.withWatermark("received_at", late)
    # in the order that ``handleInputRows`` takes; times as numbers, which Python reads faster, but for the watermark's
    rows = receipts.select("stream_key", now.alias("now"), "receipt_id", age.alias("age_us"), "checks_valid", F.col("sequence").cast("long").alias("sequence"), "nonce", "receipt_hash", *(["received_at"] if retain_s is not None else []))
    mode = "None" if retain_s is None else "EventTime"
    return rows.groupBy("stream_key").transformWithState(Acceptance(retain_s), T.StructType.fromDDL(OUTPUT), "Append", mode)


def classify(outcomes: DataFrame) -> DataFrame:
    """Outcomes with their event: accepted, replay, failed checks, or refused otherwise."""
    has = lambda x: F.array_contains(F.split("reasons", ","), x)
    event = F.when(F.col("status") == "ACCEPT", "RECEIPT_ACCEPTED").when(has("REPLAY_DETECTED") | has("NONCE_REUSE"), "REPLAY_ATTEMPT").when(has("CHECKS_INVALID"), "VERIFICATION_FAILED").otherwise("RECEIPT_REFUSED")
    return outcomes.withColumn("event", event)


def verify(receipts: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Digest checks of receipts: for each part ``<part>_hash`` against the hash of ``<part>`` (null: unavailable).

    The verdict is REJECT when a check or the signature fails, REVIEW when one is unavailable, else ACCEPT; a null
    signature result counts as failed.
    """
    check = lambda p: F.when(F.col(p).isNull(), "UNAVAILABLE").when(F.sha2(F.col(p).cast("binary"), 256) == F.col(f"{p}_hash"), "VALID").otherwise("INVALID")
    signature = F.when(F.coalesce("signature_valid", F.lit(False)), "VALID").otherwise("INVALID")
    names = [*parts, "signature"]
    checked = receipts.withColumn("checks", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(check, parts), signature)))
    values = F.map_values("checks")
    return checked.withColumn("status", F.when(F.array_contains(values, "INVALID"), "REJECT").when(F.array_contains(values, "UNAVAILABLE"), "REVIEW").otherwise("ACCEPT"))


def verify_links(receipts: DataFrame) -> DataFrame:
    """Receipts of a stream key in order of issue, each against the hash of the one before: ``linked`` or not."""
    from pyspark.sql import Window

    before = F.lag("receipt_hash").over(Window.partitionBy("stream_key").orderBy("sequence", "receipt_id"))
    return receipts.withColumn("linked", F.col("previous_receipt_hash").eqNullSafe(before))


def attack_findings(outcomes: DataFrame) -> DataFrame:
    """Findings of refused receipts: one per receipt and kind of attack, all critical."""
    from proofline.functions.columns import canonical

    kinds = {"REPLAY_DETECTED": "REPLAY_DETECTED", "NONCE_REUSE": "REPLAY_DETECTED", "MODEL_INVALID": "MODEL_SUBSTITUTION", "OUTPUT_INVALID": "OUTPUT_TAMPERING", "CHECKS_INVALID": "OUTPUT_TAMPERING"}
    category = F.coalesce(*(F.when(F.col("attack") == a, F.lit(c)) for a, c in kinds.items()))
    rows = outcomes.where("status = 'REJECT'").withColumn("attack", F.explode(F.split("reasons", ","))).withColumn("category", category).where("category IS NOT NULL").select("stream_key", "receipt_id", "category").distinct()
    ident = F.upper(F.substring(F.sha2(canonical(category=F.col("category"), receipt=F.col("receipt_id").cast("string"), stream=F.col("stream_key")), 256), 1, 16))
    return rows.withColumns({"finding_id": F.concat(F.lit("F-INFERENCE-"), ident), "severity": F.lit("CRITICAL"), "confidence": F.lit(1.0), "recommendation": F.lit("REJECT")})
