"""File sources, sinks, image features and streams on fixtures written here."""

import json
import struct
import zlib

import numpy as np
import pytest

from proofline.catalogue import queries
from proofline.operators import annotations, images
from proofline.plans import runs
from proofline.session import ship
from proofline.sources import files, sinks
from proofline.streaming import acceptance

SF = "/root/testdata/sf0.001"


def png(path, pixels):
    """A PNG of rows of grey (2-D) or RGB (3-D) bytes."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    ship(spark)
    noise = np.random.default_rng(1).integers(0, 256, (40, 60)).astype(np.uint8)
    png(tmp_path / "a.png", np.full((8, 8), 128, dtype=np.uint8))
    png(tmp_path / "b.png", np.dstack([np.full((8, 16), v, dtype=np.uint8) for v in (255, 0, 0)]))
    png(tmp_path / "c.png", noise)
    png(tmp_path / "d.png", np.clip(noise.astype(int) + 2, 0, 255).astype(np.uint8))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / ".hidden.png").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.images(spark, str(tmp_path)).collect()}
    assert {k: r.failure_code for k, r in rows.items()} == {"a.png": None, "b.png": None, "c.png": None, "d.png": None, "bad.png": "UNDECODABLE"}
    got = {r.path.rsplit("/", 1)[1]: r for r in images.features(files.images(spark, str(tmp_path))).collect()}
    assert abs(got["a.png"].brightness - 128 / 255) < 1e-9 and got["a.png"].contrast < 1e-9 and got["a.png"].entropy == 0 and got["a.png"].mode_group == "GREY"
    assert abs(got["b.png"].brightness - 0.2126) < 1e-9 and got["b.png"].saturation == 1 and got["b.png"].aspect_ratio == 2
    assert bin(int(got["c.png"].signature, 16) ^ int(got["d.png"].signature, 16)).count("1") <= 6 and got["c.png"].sharpness > 0.01
    found = {r.path.rsplit("/", 1)[1]: r for r in files.identity(files.scan(spark, str(tmp_path))).collect()}
    assert found["bad.png"].byte_size == 12 and "empty.png" not in found


def test_annotations(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "x.jpg", "width": 10, "height": 10}, {"id": 1, "file_name": "y.jpg"}, {"id": 2, "file_name": "z.jpg", "width": 5, "height": 5}], "categories": [{"id": 1, "name": "car"}], "annotations": [{"id": 1, "image_id": 2, "category_id": 1, "bbox": [1, 2, 3, 3]}, {"id": 2, "image_id": 2, "category_id": 9, "bbox": [1, 2, 9, 4]}, {"id": 3, "image_id": 7, "category_id": 1, "bbox": [1, 2]}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    parts = files.coco(spark, str(tmp_path / "c.json"))
    found = {(r.violation, r.subject) for r in annotations.reference_violations(parts["images"], parts["categories"], parts["annotations"]).collect()}
    assert found == {("DUPLICATE_IMAGE_ID", "1"), ("ORPHAN_IMAGE", "7"), ("ORPHAN_CATEGORY", "9")}
    boxes = {r.id: r.problem for r in annotations.box_violations(parts["annotations"], parts["images"]).collect()}
    assert boxes == {2: "BOX_OUTSIDE_IMAGE", 3: "BOX_MALFORMED"}
    assert {r.sample_id: r.labels for r in files.coco_samples(parts).collect()}["z.jpg"] == ["car"]
    (tmp_path / "one.txt").write_text("0 .5 .5 .1 .1\n\n3 .5 .5 .1 .1\n0 .5 .5 .1\n0 x .5 .1 .1\n1 1.5 .5 .1 .1\n")
    lines = annotations.parse_label_lines(files.yolo_lines(spark, str(tmp_path)), 2)
    assert sorted(str(r.problem) for r in lines.collect()) == ["BOX_OUTSIDE_UNIT", "CLASS_OUT_OF_RANGE", "NOT_NUMERIC", "None", "TOKEN_COUNT"]
    stems = spark.createDataFrame([("one",), ("two",), ("two",)], "stem string")
    pairs = annotations.pairing_violations(stems, files.yolo_lines(spark, str(tmp_path)).select("stem").distinct())
    assert {(r.violation, r.stem) for r in pairs.collect()} == {("DUPLICATE_IMAGE_STEM", "two"), ("MISSING_LABEL", "two")}


def test_findings_and_sink(spark, tmp_path):
    good = {"finding_id": "F-1", "module": "dataset_integrity", "asset_type": "sample", "asset_id": "a", "category": "C", "severity": "LOW", "confidence": 0.5, "reason": "r", "evidence": ["e"], "recommendation": "REVIEW", "limitations": []}
    lines = [good, good | {"finding_id": " "}, good | {"severity": "BAD"}, good | {"confidence": 1.5}, good | {"evidence": []}]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    got = sorted(str(r.problem) for r in files.read_findings(spark, str(tmp_path / "f.json")).cache().collect())
    assert got == ["BLANK_FINDING_ID", "CONFIDENCE_OUT_OF_RANGE", "EVIDENCE_COUNT", "MALFORMED", "None", "UNKNOWN_SEVERITY"]
    at = str(tmp_path / "store")
    batch = lambda rows: spark.createDataFrame(rows, "id string, body string")
    first = {(r.id, r.status) for r in sinks.append_created(batch([("a", "1"), ("a", "1"), ("b", "2")]), at, "id", "body").collect()}
    second = {(r.id, r.status) for r in sinks.append_created(batch([("a", "1"), ("b", "9"), ("c", "3")]), at, "id", "body").collect()}
    assert first == {("a", "CREATED"), ("a", "EXISTS"), ("b", "CREATED")} and second == {("a", "EXISTS"), ("b", "CONFLICT"), ("c", "CREATED")}
    assert spark.read.parquet(at).count() == 3
    with pytest.raises(Exception, match="not finite"):
        sinks.write_report(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "r"))


def test_paired_windows(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"descriptor": {"name": "d", "dimension": 2}, "reference": [{"sample_id": "a", "vec": [1, 2]}], "current": [{"sample_id": "b", "vec": [3, 4]}, {"sample_id": "c", "vec": [5, 6]}]}))
    assert [(r.role, r.pos, r.sample_id) for r in files.paired_windows(spark, str(tmp_path / "p.json")).orderBy("role", "pos").collect()] == [("CURRENT", 0, "b"), ("CURRENT", 1, "c"), ("REFERENCE", 0, "a")]


def test_paired_problems(spark, tmp_path):
    good = {"descriptor": {"name": "d", "dimension": 2}, "reference": [{"sample_id": "a", "vec": [1, 2]}], "current": [{"sample_id": "b", "vec": [3, 4]}]}
    many = [{"sample_id": str(i), "vec": [0, 0]} for i in range(129)]
    cases = {
        "good": (good, None),
        "more": ({**good, "extra": 1}, "WRONG_KEYS"),
        "none": ({**good, "current": []}, "WINDOW_SIZE"),
        "many": ({**good, "current": many}, "WINDOW_SIZE"),
        "wide": ({**good, "descriptor": {"name": "d", "dimension": 65}}, "DIMENSION_OUT_OF_RANGE"),
        "short": ({**good, "current": [{"sample_id": "b", "vec": [3]}]}, "DIMENSION_MISMATCH"),
        "null": ({**good, "current": [{"sample_id": "b", "vec": [3, None]}]}, "NOT_FINITE"),
        "twice": ({**good, "reference": good["reference"] * 2}, "DUPLICATE_SAMPLE_ID"),
    }
    for name, (content, _) in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    (tmp_path / "broken.json").write_text("{")
    got = {r.file.rsplit("/", 1)[1][:-5]: r.problem for r in files.paired_problems(spark, str(tmp_path)).collect()}
    assert got == {"broken": "MALFORMED", **{name: problem for name, (_, problem) in cases.items()}}


def test_strict_reports_look_inside(spark, tmp_path):
    for i, bad in enumerate(("array(1D, double('NaN'))", "named_struct('a', array(double('Infinity')))", "map('k', float('-Infinity'))")):
        with pytest.raises(Exception, match="not finite"):
            sinks.write_report(spark.sql(f"SELECT {bad} AS x"), str(tmp_path / str(i)))
    sinks.write_report(spark.sql("SELECT array(1D, NULL) AS x, named_struct('a', 2D) AS y, CAST(NULL AS DOUBLE) AS z"), str(tmp_path / "ok"))
    assert json.loads(spark.read.text(str(tmp_path / "ok")).head().value) == {"x": [1.0, None], "y": {"a": 2.0}, "z": None}


def expected_acceptance(rows):
    """Receipts one by one, against everything accepted so far."""
    seen, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.stream_key, r.received_at, r.receipt_id)):
        done = seen.setdefault(r.stream_key, [])
        age = (r.received_at - r.issued_at).total_seconds()
        bad = not r.checks_valid or age > 300 or age < -30 or any(r.nonce == d.nonce or r.receipt_hash == d.receipt_hash or r.sequence <= d.sequence for d in done)
        out[r.receipt_id] = "REJECT" if bad else "ACCEPT"
        if not bad:
            done.append(r)
    return out


def test_acceptance_in_batch_and_on_a_stream(spark):
    rows = runs._receipts(spark, SF).collect()
    want = expected_acceptance(rows)
    batch = {r.receipt_id: r for r in queries()["receipt_accept"](spark, SF).collect()}
    assert {k: r.status for k, r in batch.items()} == want and len(set(want.values())) == 2
    reasons = {x for r in batch.values() for x in r.reasons.split(",")}
    assert {"CHECKS_INVALID", "STALE_RECEIPT", "FUTURE_TIMESTAMP", "NONCE_REUSE", "SEQUENCE_REGRESSION", ""} <= reasons
    stream = queries()["receipt_accept_stream"](spark, SF).collect()
    assert {r.receipt_id: (r.status, r.reasons) for r in stream} == {k: (r.status, r.reasons) for k, r in batch.items()}


def test_stream_across_batches(spark, tmp_path):
    ship(spark)
    rows = runs._receipts(spark, SF).orderBy("received_at", "receipt_id").collect()
    schema = runs._receipts(spark, SF).schema
    for i in range(4):  # files arrive in order of time, one per batch
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = acceptance.accept_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.receipt_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == expected_acceptance(rows)
