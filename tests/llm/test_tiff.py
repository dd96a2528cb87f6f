import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofline.llm import tiff


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.text(alphabet="ab c", max_size=3000).map(str.encode)))
def test_schemes_round_trip(data):
    assert tiff.unpackbits(tiff.packbits(data), len(data)) == data
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_lzw_table_fills_and_known_vector():
    data = random.Random(1).randbytes(60_000) + b"abc" * 9000
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data
    # the example of the format's specification: 7 7 7 8 8 7 7 6 6 with 9-bit codes
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("predictor", [1, 2])
def test_files_round_trip(scheme, tiled, predictor):
    payload = tiff.padded(b"some text, \xff\x00 more " * 60_000)
    found = list(tiff.read(tiff.write(payload, scheme, tiled, predictor)))
    assert len(found) == -(-len(payload) // (tiff.LINE * tiff.PAGE_LINES)) and [p[0] for p in found] == list(range(len(found)))
    assert b"".join(p[7] for p in found) == payload


def test_big_endian_colour_strip():
    pixels = np.arange(4 * 3 * 3, dtype=np.uint8).tobytes()
    fields = [(256, 3, 4), (257, 3, 3), (259, 3, 1), (273, 4, 8), (277, 3, 3), (278, 3, 3), (279, 4, len(pixels))]
    at = 8 + len(pixels)
    rows = [struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields]
    rows.insert(2, struct.pack(">HHII", 258, 3, 3, at + 6 + 12 * 8))
    data = struct.pack(">2sHI", b"MM", 42, at) + pixels + struct.pack(">H", 8) + b"".join(rows) + struct.pack(">I", 0) + struct.pack(">HHH", 8, 8, 8)
    assert list(tiff.read(data)) == [(0, 4, 3, 3, 1, 1, False, pixels, None)]


def test_bad_media(spark):
    good = tiff.write(tiff.padded(b"x" * 5000), tiff.LZW, False, 1)
    loop = bytearray(good)
    (at,) = struct.unpack_from("<I", good, 4)
    (n,) = struct.unpack_from("<H", good, at)
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    rows = [(1, None), (2, b""), (3, b"GIF89a.."), (4, good[:-20]), (5, bytes(loop)), (6, good), (6, good), (7, good[:9] + b"\xff\xff\xff" + good[12:])]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None, 0) for i, m in rows], "doc_id long, media binary, PAGE int")
    found = tiff.pages(df).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 3, 4, 5, 6, 6, 7]
    assert all((r.samples is None) == (r.error is not None) for r in found)
    assert all(r.error for r in found if r.doc_id <= 4) and not any(r.error for r in found if r.doc_id in (5, 6))
    assert tiff.pages(df.limit(0)).count() == 0


def test_hostile_headers_and_bombs():
    """A header can't claim more than the file holds, and a strip is inflated no further than its samples."""
    bomb = zlib.compress(bytes(200_000_000), 9)
    for size, wide in ((64, 8), (64, 60_000), (64, 0)):
        at = 8 + len(bomb)
        fields = [(256, 4, wide), (257, 4, wide), (258, 3, 8), (259, 3, 8), (273, 4, 8), (278, 4, wide), (279, 4, len(bomb))]
        rows = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in fields)
        found = list(tiff.read(struct.pack("<2sHI", b"II", 42, at) + bomb + struct.pack("<H", len(fields)) + rows + struct.pack("<I", 0)))
        assert len(found) == 1 and (found[0][7] == bytes(size) if wide == 8 else found[0][8])


def test_query_against_brute_force(spark, tmp_path):
    texts = ["", None, "a", "é" * 288, "é" * 289, "word " * 300_000, "x" * 576, "same", "same"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in tiff.query(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert found[0][1:] == found[1][1:] and found[7][1:] == found[8][1:]


def test_feature_depends_on_every_page(spark, tmp_path):
    head = "first page " * 60_000
    texts = [head + " " * 300_000 + "z" * 300_000, head + "z" * 300_000 + " " * 300_000, "short text " * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.feature for r in tiff.query(spark, str(tmp_path)).collect()}
    assert found[0] != found[1]
    for i, text in enumerate(texts):
        values = np.frombuffer(tiff.padded(text.encode()), dtype=np.uint8)
        cells = [int(c.sum()) * 1000 // len(c) for c in np.array_split(values.astype(np.int64), 64)]
        bits = sum(1 << k for k, c in enumerate(cells) if c > sorted(cells)[32])
        assert found[i] == f"pages={-(-len(values) // (tiff.LINE * tiff.PAGE_LINES))};mean={int(values.sum(dtype=np.int64)) * 1000 // len(values)};hash={bits:016x}"
