"""State and sinks: acceptance with bounded state, exactly-once drains, racing writers, windows with rejects."""

import hashlib
import json
import random
import struct
import threading
import zlib
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from proofline.operators import audit
from proofline.plans import streams
from proofline.session import ship
from proofline.sources import image_window, ledger, sinks
from proofline.streaming import acceptance, outbox

RECEIPT = "stream_key string, receipt_id long, receipt_hash string, nonce string, sequence long, issued_at timestamp, received_at timestamp, checks_valid boolean"


# ---------------------------------------------------------------- acceptance


def receipts(hours: int, seed: int = 1) -> list[tuple]:
    """Two streams; nonces come back after a few minutes or hours, some receipts are sent again."""
    rng, rows, start = random.Random(seed), [], datetime(2024, 1, 1)
    for i in range(hours * 12):
        at = start + timedelta(minutes=5 * i, seconds=rng.randint(0, 60))
        again = rng.random()
        back = rng.choice([1, 2, 30])
        nonce = f"n{i - back}" if again < 0.2 and i >= back else f"n{i}"
        digest = f"h{i - back}" if 0.2 <= again < 0.3 and i >= back else f"h{i}"
        rows.append((f"s{i % 2}", i, digest, nonce, i, at - timedelta(seconds=5), at, rng.random() > 0.05))
    return rows


def replayed(rows: list[tuple], retain_s: float | None) -> dict[int, tuple[str, str]]:
    """Verdicts one by one against everything accepted within the retention."""
    seen: dict[str, list[tuple]] = {}
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[6], r[1])):
        done = seen.setdefault(r[0], [])
        kept = [d for d in done if retain_s is None or (r[6] - d[6]).total_seconds() <= retain_s]
        reasons = [] if r[7] else ["CHECKS_INVALID"]
        reasons += ["NONCE_REUSE"] * any(d[3] == r[3] for d in kept) + ["REPLAY_DETECTED"] * any(d[2] == r[2] for d in kept)
        top = max((d[4] for d in done), default=None)
        reasons += ["DUPLICATE_SEQUENCE"] * (top == r[4]) + ["SEQUENCE_REGRESSION"] * (top is not None and r[4] < top)
        out[r[1]] = ("REJECT" if reasons else "ACCEPT", ",".join(reasons))
        if not reasons:
            done.append(r)
    return out


@pytest.mark.parametrize("retain_s", [None, 3600.0])
def test_acceptance_state_shrinks_and_verdicts_hold(spark, tmp_path, retain_s):
    ship(spark)
    rows = receipts(30)
    want = replayed(rows, retain_s)
    batch = acceptance.accept_batch(spark.createDataFrame(rows, RECEIPT), retain_s).collect()
    assert {r.receipt_id: (r.status, r.reasons) for r in batch} == want
    stream = acceptance.accept_stream(spark.readStream.schema(RECEIPT).parquet(str(tmp_path / "in")), retain_s) if (tmp_path / "in").mkdir() is None else None
    held = []
    for i in range(5):  # each part arrives after the one before was judged
        spark.createDataFrame(rows[i * 72 : (i + 1) * 72], RECEIPT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    got = {r.receipt_id: (r.status, r.reasons) for r in spark.read.schema(acceptance.OUTPUT).parquet(str(tmp_path / "out")).collect()}
    assert got == want
    if retain_s is None:
        assert held[-1] > 4 * held[0] * 0.8 and held == sorted(held)
    else:
        # an hour of retention and an hour of lateness hold about two hours of the six that a part has
        assert held[-1] < held[0] * 1.3 and max(held) < 200, held
        assert any(v != replayed(rows, None)[k] for k, v in want.items())


def test_retention_forgets_in_order_of_time():
    memory = acceptance._Accepted(100)
    row = lambda i, nonce, at: type("R", (), {"nonce": nonce, "receipt_hash": f"h{i}", "sequence": i, "checks_valid": True, "issued_at": at, "received_at": at})()
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    assert memory.verdict(row(1, "a", at(0))) == [] and memory.verdict(row(2, "a", at(100))) == ["NONCE_REUSE"]
    assert memory.verdict(row(3, "a", at(101))) == [] and memory.verdict(row(4, "a", at(150))) == ["NONCE_REUSE"]
    assert len(memory.nonces) == len(memory.order) == 1


class Stored(dict):
    """A map, value or timer state that counts the messages it would take."""

    calls = 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return Stored()

    def getValue(self, key):
        self.calls += 1
        return dict.get(self, key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.pop(key, None)

    def get(self):
        return dict.get(self, "value")

    def update(self, value):
        self["value"] = value


def test_stream_asks_its_state_for_pages_not_for_values():
    state, processor = Stored(), acceptance.Acceptance(None)
    processor.init(state)
    rng, sent, got = random.Random(3), [], {}
    for batch in range(4):
        rows = [(60_000_000 * i, i, 5_000_000, rng.random() > 0.1, i, f"n{rng.randrange(i + 5)}", f"h{rng.randrange(i + 500)}") for i in range(batch * 300, batch * 300 + 300)]
        sent += rows
        before = state.calls
        got |= {r.receipt_id: (r.status, r.reasons) for r in processor.handleInputRows(("k",), iter(("k", *r) for r in rows), None)}
        # a call for each value that is asked for, and one for each that is accepted, would be four a receipt
        assert state.calls - before < (150 if batch else 40), (batch, state.calls - before)
    at = lambda us: datetime(2024, 1, 1) + timedelta(microseconds=us)
    want = replayed([("k", i, digest, nonce, sequence, at(now - age), at(now), valid) for now, i, age, valid, sequence, nonce, digest in sent], None)
    assert got == want and len(set(want.values())) > 3


def test_pages_hold_what_a_dictionary_holds():
    state, known, rng = Stored(), {}, random.Random(5)
    pages, values = 1, 0
    for batch in range(60):
        memory = acceptance._Pages(state, pages, values)
        for _ in range(rng.choice([1, 3, 200])):
            value = rng.choice([acceptance._named("n", None), f"n{rng.randrange(3000)}", f"h\ud800{rng.randrange(3000)}"])
            assert memory.get(value) == known.get(value)
            memory.put(value, batch)
            known[value] = batch
        memory.fit()
        memory.write()
        if batch % 20 == 19:
            earliest = memory.forget(lambda at: at < batch - 1)
            known = {v: at for v, at in known.items() if at >= batch - 1}
            assert earliest == min(known.values())
        pages, values = memory.pages, memory.values
        assert values == len(known) and len(state) <= pages <= max(1, 4 * values / acceptance.PAGE)
        assert {v: at for (text,) in state.values() for v, at in json.loads(text).items()} == known


# ---------------------------------------------------------------- outbox

INTENT = "chain string, event_key string, event_type string, asset_type string, asset_id string, payload_json string, payload_hash string, created_at long, ts timestamp"


def intent(chain: str, k: int, bad: bool = False, key: str | None = None, payload: str = "{}") -> tuple:
    body = f'{{"asset_id":"a{k}","asset_type":"t","event_type":"E","payload":{payload}}}'
    return (chain, key or f"e{chain}{k}", "E", "t", f"a{k}", body, "x" if bad else hashlib.sha256(body.encode()).hexdigest(), k, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=k))


def test_drain_survives_a_crash_between_write_and_marker(spark, tmp_path):
    ship(spark)
    parts = [
        [intent("p", 1), intent("p", 2), intent("q", 1)],
        [intent("p", 3), intent("q", 2, bad=True), intent("q", 3), intent("p", 1)],
        [intent("q", 4), intent("p", 4)],
        [intent("q", 2), intent("r", 9)],  # the sound intent of a held key: what waits behind it goes, too
    ]
    source, store, check = (str(tmp_path / x) for x in ("in", "store", "ck"))
    crashed = []

    def crash(batch: int) -> None:
        if batch in (1, 3) and batch not in crashed:
            crashed.append(batch)
            raise RuntimeError("lost")

    stream = None
    for part in parts:
        spark.createDataFrame(part, INTENT).coalesce(1).write.mode("append").parquet(source)
        stream = stream or spark.readStream.schema(INTENT).parquet(source)
        for _ in range(2):
            query = outbox.drain_stream(stream, store, check, crash)
            try:
                query.awaitTermination()
            except Exception as e:
                assert "lost" in str(e)
    assert crashed == [1, 3]
    schema = outbox.record_schema(spark, spark.createDataFrame([], INTENT).schema)
    log = outbox.Store(spark, store).records(schema)
    got = [(r.chain, r.sequence, r.event_key) for r in log.orderBy("chain", "sequence").collect()]
    assert got == [("p", i, f"ep{i}") for i in (1, 2, 3, 4)] + [("q", i, f"eq{i}") for i in (1, 2, 3, 4)] + [("r", 1, "er9")]
    assert {(r.chain, r.records, r.status) for r in audit.verify(log).collect()} == {("p", 4, "VALID"), ("q", 4, "VALID"), ("r", 1, "VALID")}
    with pytest.raises(ValueError, match="checkpoint"):
        outbox.deliver(outbox.Store(spark, store), spark.createDataFrame(parts[0], INTENT), 0)


def test_records_without_a_marker_are_not_seen(spark, tmp_path):
    ship(spark)
    store = outbox.Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([intent("p", 1)], INTENT)
    with pytest.raises(RuntimeError):
        outbox.deliver(store, rows, 0, lambda b: (_ for _ in ()).throw(RuntimeError("lost")))
    schema = outbox.record_schema(spark, rows.schema)
    assert store.finished() == [] and store.records(schema).count() == 0
    outbox.deliver(store, rows, 0)
    assert store.finished() == [0] and store.records(schema).count() == 1


def test_drain_query_leaves_no_order_out(spark, tmp_path):
    """Keys below zero are orders like others; many chains, one of them long, and deliveries in all three runs."""
    ship(spark)
    k = F.col("id") * 7 - 3000
    chain = F.when(F.col("id") % 4 == 0, 1).otherwise(F.col("id") % 97 + 2)
    orders = spark.range(1500).select(k.alias("o_orderkey"), chain.alias("o_custkey"), F.when(F.col("id") % 5 == 2, "F").otherwise("O").alias("o_orderstatus"), F.timestamp_seconds("id").alias("o_orderdate"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    query, sql = streams.QUERIES["outbox_drain_stream"]
    base = duckdb.connect()
    base.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = base.execute(sql).fetchall()
    assert {max(0, int(row[1][1:])) * 3 // (1499 * 7 - 3000) for row in want} >= {0, 1, 2} and any(row[1].startswith("e-") for row in want)
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(want)


# ---------------------------------------------------------------- ledger


def test_second_writer_of_a_version_is_refused(spark, tmp_path):
    ship(spark)
    at = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, body string")
    ledger.write(rows(("a", "1")), at, 0)
    with pytest.raises(Exception, match=ledger.REFUSED):
        ledger.write(rows(("a", "2"), ("b", "2")), at, 0)
    assert [tuple(r) for r in ledger.read(spark, at, "id string, body string").collect()] == [("a", "1")]
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 1 and ledger.version(at) == 1
    own = spark.read.format(ledger.FORMAT).schema("id string, body string").option("path", at).load()
    assert [tuple(r) for r in own.collect()] == [("a", "1")]
    with pytest.raises(Exception, match="append-only"):
        rows(("a", "1")).write.format(ledger.FORMAT).option("path", at).mode("overwrite").save()


def test_two_writers_of_one_key(spark, tmp_path, monkeypatch):
    ship(spark)
    at = str(tmp_path / "t")
    # the other writer commits after the verdicts of the first were taken
    real, rival = ledger.write, iter([[("k", "theirs"), ("x", "1")], [("k2", "same")]])

    def late(df, path, base):
        for other in [next(rival, None)]:
            if other:
                real(spark.createDataFrame(other, "id string, body string"), path, base)
        real(df, path, base)

    monkeypatch.setattr(ledger, "write", late)
    mine = spark.createDataFrame([("k", "mine"), ("k2", "same"), ("k3", "new")], "id string, body string")
    got = {r.id: r.status for r in sinks.append_created(mine, at, "id", "body").collect()}
    assert got == {"k": "CONFLICT", "k2": "EXISTS", "k3": "CREATED"}
    assert sorted(tuple(r) for r in ledger.read(spark, at, mine.schema).collect()) == [("k", "theirs"), ("k2", "same"), ("k3", "new"), ("x", "1")]


def test_threads_create_a_key_once(spark, tmp_path):
    ship(spark)
    at, got = str(tmp_path / "t"), []

    def writer(body: str) -> None:
        df = spark.createDataFrame([("k", body), (body, body)], "id string, body string")
        got.extend((body, r.id, r.status) for r in sinks.append_created(df, at, "id", "body").collect())

    threads = [threading.Thread(target=writer, args=(f"b{i}",)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(s for _, i, s in got if i == "k") == ["CONFLICT", "CONFLICT", "CREATED"]
    assert ledger.read(spark, at, "id string, body string").count() == 4 and ledger.version(at) == 3


# ---------------------------------------------------------------- image windows


def png(width: int, height: int, colour: int = 2, bits: int = 8, frames: int | None = None) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    animation = chunk(b"acTL", struct.pack(">II", frames, 0)) if frames else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + animation + chunk(b"IDAT", zlib.compress(b"\0" * 4)) + chunk(b"IEND", b"")


def tiff(pages: int, photometric: int = 1) -> bytes:
    out, at = b"II*\0" + struct.pack("<I", 8), 8
    for p in range(pages):
        tags = [(256, 4, 5), (257, 4, 6), (258, 3, 8), (262, 3, photometric)]
        at += 2 + 12 * len(tags) + 4
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0 if p == pages - 1 else at)
    return out


def jpeg(parts: int = 3) -> bytes:
    return b"\xff\xd8" + b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * parts, 8, 7, 9, parts) + b"\0" * 3 * parts + b"\xff\xda\0\x02data\xff\xd9"


def webp(frames: int) -> bytes:
    body = b"WEBPVP8X" + struct.pack("<I", 10) + b"\x02\0\0\0" + b"\x03\0\0" + b"\x04\0\0" + b"".join(b"ANMF" + struct.pack("<I", 4) + b"abcd" for _ in range(frames))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp(bits: int, table: bytes = b"") -> bytes:
    data = b"\0" * 64
    return b"BM" + struct.pack("<IHHI", 54 + len(table) + 64, 0, 0, 54 + len(table)) + struct.pack("<IiiHHIIiiII", 40, 2, -2, 1, bits, 0, 0, 0, 0, 0, 0) + table + data


def test_window_of_all_codes(spark, tmp_path):
    ship(spark)
    root, outside = tmp_path / "w", tmp_path / "outside"
    for d in (root / "sub", root / ".hidden", outside):
        d.mkdir(parents=True)
    good = {
        "a.png": (png(3, 2), ("PNG", "RGB", 3, 2)),
        "sub/b.JPG": (jpeg(), ("JPEG", "RGB", 9, 7)),
        "grey.jpeg": (jpeg(1), ("JPEG", "L", 9, 7)),
        "one.tif": (tiff(1), ("TIFF", "L", 5, 6)),
        "one.webp": (webp(1), ("WEBP", "RGB", 4, 5)),
        "c.bmp": (bmp(24), ("BMP", "RGB", 2, 2)),
        "named.png": (jpeg(), ("JPEG", "RGB", 9, 7)),
    }
    bad = {
        "two.tiff": (tiff(2), "UNSUPPORTED_MULTIFRAME"),
        "moving.png": (png(3, 2, frames=3), "UNSUPPORTED_MULTIFRAME"),
        "moving.webp": (webp(2), "UNSUPPORTED_MULTIFRAME"),
        "palette.png": (png(3, 2, colour=3), "UNSUPPORTED_IMAGE_MODE"),
        "print.jpg": (jpeg(4), "UNSUPPORTED_IMAGE_MODE"),
        "palette.bmp": (bmp(8, b"\1\2\3\0" * 4), "UNSUPPORTED_IMAGE_MODE"),
        "wide.png": (png(60_000, 60_000), "RESOURCE_LIMIT"),
        "nothing.png": (png(0, 5), "RESOURCE_LIMIT"),
        "big.png": (png(3, 2) + b"\0" * 3000, "RESOURCE_LIMIT"),
        "cut.png": (png(3, 2)[:-9], "INVALID_IMAGE"),
        "empty.jpg": (b"", "INVALID_IMAGE"),
        "text.bmp": (b"hello", "INVALID_IMAGE"),
        "loop.tif": (tiff(2)[:-4] + struct.pack("<I", 8), "INVALID_IMAGE"),
    }
    for name, (raw, _) in (good | bad).items():
        (root / name).write_bytes(raw)
    for name in ("note.txt", ".dot.png", ".hidden/x.png"):
        (root / name).write_bytes(png(1, 1))
    (outside / "o.png").write_bytes(png(1, 1))
    (root / "link.png").symlink_to(outside / "o.png")
    (root / "folder").symlink_to(outside)
    got = {r.path: r for r in image_window.scan(spark, str(root), max_bytes=3000, content=True).collect()}
    assert got.keys() == (good | bad).keys() | {"link.png", "folder"}
    for name, (raw, want) in good.items():
        r = got[name]
        assert (r.format, r.mode, r.width, r.height) == want and r.failure_code is None and bytes(r.content) == raw
        assert r.sha256 == hashlib.sha256(raw).hexdigest() and r.byte_size == len(raw) and r.frames == 1
    for name, (_, code) in bad.items():
        assert got[name].failure_code == code and got[name].content is None, name
    assert got["link.png"].failure_code == got["folder"].failure_code == "SYMLINK_REJECTED"
    with pytest.raises(Exception, match="no real folder|NotADirectory"):
        image_window.scan(spark, str(root / "folder")).collect()


def test_window_changes_while_it_is_read(tmp_path):
    root, outside = tmp_path / "w", tmp_path / "outside"
    (root / "d").mkdir(parents=True)
    outside.mkdir()
    for at in (root / "d", root, outside):
        for name in ("x.png", "y.png", "z.png"):
            (at / name).write_bytes(png(1, 1))

    class Racing(image_window.WindowReader):
        def load(self, path):
            raw = super().load(path)
            if path.name == "x.png":
                path.write_bytes(raw + b"more")
            return raw

    reader = Racing(str(root), 1000, 1000, False)
    (part,) = reader.partitions()
    # after the walk: a folder becomes a link to elsewhere, a file becomes a link, a file goes
    (root / "d").rename(tmp_path / "gone")
    (root / "d").symlink_to(outside)
    (root / "y.png").unlink()
    (root / "y.png").symlink_to(outside / "y.png")
    (root / "z.png").unlink()
    got = {r[0]: r[8] for r in reader.read(part)}
    assert got == {"d/x.png": "PATH_ESCAPE_REJECTED", "d/y.png": "PATH_ESCAPE_REJECTED", "d/z.png": "PATH_ESCAPE_REJECTED", "x.png": "FILE_CHANGED", "y.png": "SYMLINK_REJECTED", "z.png": "IO_ERROR"}
    assert set(got.values()) < set(image_window.CODES)
