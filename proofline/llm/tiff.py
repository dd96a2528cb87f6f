"""TIFF media columns: image directories walked, strips and tiles decoded, predictors undone, one row per page.

``pages`` reads any binary column of 8-bit TIFF files (either byte order; strips or tiles; uncompressed, PackBits, LZW
or deflate; horizontal predictor) and emits one row per page. ``store`` writes payload bytes losslessly as such files;
the form (compression, strips or tiles, predictor) follows from the payload alone.

Defined cases: a null or empty medium, or one that is no TIFF, gives one row with page 0, null samples and ``error``;
a damaged page gives a row with ``error`` and the walk goes on, as does one whose header claims more samples than the
file's bytes can hold; directories that loop end the walk; repeated rows are
read one by one; an empty table gives no rows; input columns that clash with the results' are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of the format: compression schemes and field tags.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_SIZE, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_SIZE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
_FIELD = {1: "B", 3: "H", 4: "I"}

UNIT = 576
LINE = 192
PAGE_LINES = 256
#: No scheme makes more of a byte of a file than this (LZW: about 1,300; deflate: 1,032).
EXPANSION = 2_048

# ---------------------------------------------------------------- compression schemes


def packbits(data: bytes) -> bytes:
    """Runs of three or more as pairs, the rest as literals of at most 128 bytes."""
    values = np.frombuffer(data, dtype=np.uint8)
    out, edges = [], np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]) if len(values) else np.zeros(1, dtype=np.int64)
    long = np.flatnonzero(np.diff(edges) >= 3)

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            out.append(bytes([min(128, b - i) - 1]) + data[i : min(i + 128, b)])

    done = 0
    for k in long.tolist():
        a, b = int(edges[k]), int(edges[k + 1])
        literal(done, a)
        for i in range(a, b, 128):
            n = min(128, b - i)
            out.append(bytes([257 - n, data[a]]) if n > 1 else bytes([0, data[a]]))
        done = b
    literal(done, len(data))
    return b"".join(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, have = [], 0, 0
    while have < size and i < len(data):
        n = data[i]
        if n < 128:
            part = data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            part = data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            part, i = b"", i + 1
        have += len(part)
        out.append(part)
    return b"".join(out)


_CLEAR, _END, _FIRST, _FULL = 256, 257, 258, 4094


def _width(n: np.ndarray | int):
    """Bits of the n-th code after a clear code (the first one has number 0): one code earlier than strictly needed."""
    return 9 + (n >= 254) + (n >= 766) + (n >= 1790)


def lzw(data: bytes) -> bytes:
    """LZW as the format has it: most significant bit first, a clear code at the start and whenever the table is full."""
    codes, numbers, table = [_CLEAR], [0], {}
    size, number, code = _FIRST, 0, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        found = table.get(key)
        if found is not None:
            code = found
            continue
        codes.append(code)
        numbers.append(number)
        number += 1
        table[key] = size
        size += 1
        if size == _FULL:
            codes.append(_CLEAR)
            numbers.append(number)
            table, size, number = {}, _FIRST, 0
        code = byte
    if code >= 0:
        codes.append(code)
        numbers.append(number)
        number += 1
    codes.append(_END)
    numbers.append(number)
    value, bits = np.array(codes, dtype=np.int64), _width(np.array(numbers))
    at = np.cumsum(bits) - bits
    flags = np.zeros(int(bits.sum()), dtype=np.uint8)
    for j in range(12):
        own = bits > j
        flags[at[own] + j] = value[own] >> (bits[own] - 1 - j) & 1
    return np.packbits(flags).tobytes()


_SCHEDULE = _width(np.arange(_FULL))
_SCHEDULE_AT = np.cumsum(_SCHEDULE) - _SCHEDULE


def unlzw(data: bytes, size: int) -> bytes:
    """The codes between two clear codes have widths known beforehand, so they are cut out together, then followed."""
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    total, at, have, out = len(data) * 8, 0, 0, []
    single = [bytes([i]) for i in range(256)]
    while at + 9 <= total and have < size:
        starts = at + _SCHEDULE_AT
        n = int(np.searchsorted(starts + _SCHEDULE, total, side="right"))
        codes = (words[starts[:n] >> 3] << (starts[:n] & 7).astype(np.uint32)).astype(np.uint32) >> (32 - _SCHEDULE[:n]).astype(np.uint32)
        stop = np.flatnonzero((codes == _CLEAR) | (codes == _END))
        ended = len(stop) == 0 or codes[stop[0]] == _END
        k = int(stop[0]) if len(stop) else n
        table, before = [*single, b"", b""], b""
        add, put = table.append, out.append
        for code in codes[:k].tolist():
            if code < len(table):
                entry = table[code]
                if before:
                    add(before + entry[:1])
            elif before:
                entry = before + before[:1]
                add(entry)
            else:
                raise ValueError("LZW code before its entry")
            put(entry)
            have += len(entry)
            before = entry
        if ended:
            break
        at = int(starts[k] + _SCHEDULE[k])
    return b"".join(out)


def _pack(scheme: int, data: bytes) -> bytes:
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 6)}[scheme](data)


def _unpack(scheme: int, data: bytes, size: int) -> bytes:
    if scheme == NONE:
        out = data
    elif scheme == PACKBITS:
        out = unpackbits(data, size)
    elif scheme == LZW:
        out = unlzw(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {scheme} is not supported")
    if len(out) < size:
        raise ValueError(f"{len(out)} of {size} bytes in a strip or tile")
    return out[:size]


# ---------------------------------------------------------------- writing


def write(payload: bytes, scheme: int, tiled: bool, predictor: int) -> bytes:
    """Bytes, a multiple of ``LINE``, as the samples of a grey multi-page file."""
    lines = np.frombuffer(payload, dtype=np.uint8).reshape(-1, LINE)
    body, size, pages = [struct.pack("<2sHI", b"II", 42, 0)], 8, []
    for top in range(0, len(lines), PAGE_LINES):
        page = lines[top : top + PAGE_LINES]
        if tiled:
            padded = np.zeros((-(-len(page) // 64) * 64, LINE), dtype=np.uint8)
            padded[: len(page)] = page
            parts = [padded[y : y + 64, x : x + 64] for y in range(0, len(padded), 64) for x in range(0, LINE, 64)]
        else:
            parts = [page[y : y + 96] for y in range(0, len(page), 96)]
        if predictor == 2:
            parts = [np.diff(p, axis=1, prepend=np.uint8(0)) for p in parts]
        stored = [_pack(scheme, np.ascontiguousarray(p).tobytes()) for p in parts]
        at = size + np.cumsum([0, *(len(s) for s in stored)])
        body += stored
        fields = [(WIDTH, 4, [LINE]), (HEIGHT, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        sizes = [len(s) for s in stored]
        fields += [(TILE_W, 4, [64]), (TILE_H, 4, [64]), (TILE_AT, 4, at[:-1].tolist()), (TILE_SIZE, 4, sizes)] if tiled else [(ROWS, 4, [96]), (STRIP_AT, 4, at[:-1].tolist()), (STRIP_SIZE, 4, sizes)]
        size = int(at[-1])
        if size % 2:
            body.append(b"\0")
            size += 1
        pages.append((len(body), size, sorted(fields)))
        room = 6 + 12 * len(fields) + sum(4 * len(v) for _, _, v in fields if len(v) > 1)
        body.append(b"\0" * room)
        size += room
    for k, (slot, at, fields) in enumerate(pages):
        following, extra_at, rows, extra = pages[k + 1][1] if k + 1 < len(pages) else 0, at + 6 + 12 * len(fields), [], b""
        for tag, kind, values in fields:
            packed = struct.pack(f"<{len(values)}{_FIELD[kind]}", *values)
            if len(packed) > 4:
                rows.append(struct.pack("<HHII", tag, kind, len(values), extra_at + len(extra)))
                extra += packed
            else:
                rows.append(struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        body[slot] = struct.pack("<H", len(fields)) + b"".join(rows) + struct.pack("<I", following) + extra
    body[0] = struct.pack("<2sHI", b"II", 42, pages[0][1])
    return b"".join(body)


def padded(text: bytes) -> bytes:
    """A text's payload: bytes 255 appended up to a positive multiple of ``UNIT``."""
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(payload: bytes) -> bytes:
    """A payload in the form that its checksum names."""
    pick = zlib.crc32(payload)
    scheme = (PACKBITS, LZW, DEFLATE)[pick % 3]
    return write(payload, scheme, bool(pick // 3 % 2), 2 if scheme != PACKBITS and pick // 6 % 2 else 1)


# ---------------------------------------------------------------- reading


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in _FIELD:
            one = struct.calcsize(_FIELD[kind])
            where = at + 10 + 12 * k
            if one * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            fields[tag] = list(struct.unpack_from(f"{order}{count}{_FIELD[kind]}", data, where))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, f: dict[int, list[int]]) -> tuple:
    width, height, deep = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, [1])[0]
    scheme, predictor = f.get(COMPRESSION, [NONE])[0], f.get(PREDICTOR, [1])[0]
    if set(f.get(BITS, [1])) != {8} or (deep > 1 and f.get(PLANAR, [1])[0] != 1) or predictor not in (1, 2):
        raise ValueError("only 8-bit chunky samples with predictor 1 or 2 are supported")
    tiled = TILE_AT in f
    w, h = (f[TILE_W][0], f[TILE_H][0]) if tiled else (width, min(height, f.get(ROWS, [height])[0]))
    if min(width, height, deep, w, h) < 1:
        raise ValueError("a page, strip or tile without samples")
    if max(width * height, w * h) * deep > EXPANSION * len(data):
        raise ValueError(f"{width} x {height} x {deep} samples can't come from {len(data)} bytes")
    out = np.zeros((height, width, deep), dtype=np.uint8)
    across = -(-width // w)
    for k, (at, size) in enumerate(zip(f[TILE_AT if tiled else STRIP_AT], f[TILE_SIZE if tiled else STRIP_SIZE], strict=True)):
        y, x = k // across * h, k % across * w
        lines = h if tiled else min(h, height - y)
        part = np.frombuffer(_unpack(scheme, data[at : at + size], lines * w * deep), dtype=np.uint8).reshape(lines, w, deep)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        out[y : y + lines, x : x + w] = part[: height - y, : width - x]
    return width, height, deep, scheme, predictor, tiled, out.tobytes(), None


_NO_PAGE = (None,) * 7


def read(data: bytes | None) -> Iterator[tuple]:
    """The pages of a file: (page, width, height, samples_per_pixel, compression, predictor, tiled, samples, error)."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get((data or b"")[:4])
    if order is None or len(data) < 8:
        yield (0, *_NO_PAGE, "not a TIFF file")
        return
    (at,), seen, page = struct.unpack_from(order + "I", data, 4), set(), 0
    while at and at not in seen:
        seen.add(at)
        try:
            fields, following = _directory(data, order, at)
        except (struct.error, MemoryError, OverflowError) as e:
            yield (page, *_NO_PAGE, f"directory: {e}")
            return
        try:
            yield (page, *_page(data, fields))
        except (KeyError, ValueError, IndexError, struct.error, zlib.error, MemoryError) as e:
            yield (page, *_NO_PAGE, f"{type(e).__name__}: {e}")
        at, page = following, page + 1


_RESULT = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("page", "width", "height", "samples_per_pixel", "compression", "predictor")), T.StructField("tiled", T.BooleanType()), T.StructField("samples", T.BinaryType()), T.StructField("error", T.StringType())])
_ARROW = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.string()]
#: Sample bytes per output batch.
_FLUSH = 8 << 20


def paged(batches: Iterable[pa.RecordBatch], media: str) -> Iterator[pa.RecordBatch]:
    """One row per page, with the other columns repeated; pages of a file follow each other."""
    names = {f.name for f in _RESULT}
    for batch in batches:
        keep = [i for i, n in enumerate(batch.schema.names) if n.lower() not in names and n != media]
        column, rows, pages, size = batch.column(batch.schema.get_field_index(media)), [], [], 0

        def flush(batch=batch, keep=keep, rows=rows, pages=pages):
            took = pa.array(rows, pa.int32())
            out = [batch.column(i).take(took) for i in keep] + [pa.array(v, t) for v, t in zip(zip(*pages), _ARROW, strict=True)]
            return pa.RecordBatch.from_arrays(out, [*(batch.schema.names[i] for i in keep), *_RESULT.names])

        for i in range(batch.num_rows):
            for page in read(column[i].as_py()):
                rows.append(i)
                pages.append(page)
                size += len(page[7] or b"")
                if size > _FLUSH:
                    yield flush()
                    rows.clear()
                    pages.clear()
                    size = 0
        if rows:
            yield flush()


def pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of each file in a binary column; the other columns stay, the files do not."""
    kept = [f for f in df.schema.fields if f.name.lower() not in {f.name for f in _RESULT} and f.name != media]
    return df.mapInArrow(lambda it: paged(it, media), T.StructType([*kept, *_RESULT.fields]))


def stored(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches whose text column becomes ``media``, with the sizes and hash that describe the stored form."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            raw = [x.encode("utf-8") if x is not None else b"" for x in part.column(at).to_pylist()]
            media = [store(padded(x)) for x in raw]
            own = {"n_bytes": pa.array([len(x) for x in raw], pa.int64()), "media_bytes": pa.array([len(m) for m in media], pa.int64()), "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]), "media": pa.array(media, pa.binary())}
            keep = [i for i, n in enumerate(part.schema.names) if n.lower() not in own and i != at]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *own.values()], [*(part.schema.names[i] for i in keep), *own])


def store_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its text column stored as a TIFF column ``media`` (null texts as empty ones)."""
    own = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("media", T.BinaryType())])
    kept = [f for f in df.schema.fields if f.name.lower() not in own.names and f.name != text]
    return df.mapInArrow(lambda it: stored(it, text), T.StructType([*kept, *own.fields]))


class _Reading:
    """What is folded over the pages of one file: 64 cells of equal size span the payload, on however many pages it lies."""

    def __init__(self, head: tuple):
        self.head, self.sha, self.size, self.tail, self.pages, self.sums = head, hashlib.sha256(), 0, b"", 0, 0
        self.cell, self.cells = max(UNIT, -(-head[1] // UNIT) * UNIT) // 64, np.zeros(64, dtype=np.int64)

    def add(self, samples: bytes) -> None:
        self.sha.update(samples)
        first, self.size = self.size, self.size + len(samples)
        if self.size > 64 * self.cell:
            raise ValueError(f"document {self.head[0]} has more samples than its payload")
        self.tail = (self.tail + samples[-32:])[-32:]
        self.pages += 1
        values = np.frombuffer(samples, dtype=np.uint8)
        self.sums += int(values.sum(dtype=np.int64))
        if len(values):
            k = np.arange(first // self.cell, (self.size - 1) // self.cell + 1)
            self.cells[k] += np.add.reduceat(values, np.maximum(k * self.cell - first, 0), dtype=np.int64)

    def row(self) -> tuple:
        cells = (self.cells * 1000 // self.cell).tolist()
        mean = sorted(cells)[32]
        bits = sum(1 << i for i, c in enumerate(cells) if c > mean)
        return (*self.head, self.size, self.sha.hexdigest(), zlib.crc32(self.tail), f"pages={self.pages};mean={self.sums * 1000 // max(1, self.size)};hash={bits:016x}")


def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest columns of each file from its pages, which follow each other; page 0 opens a file."""
    names = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    now, done = None, []
    for batch in batches:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        heads = zip(*(column[n].to_pylist() for n in names[:4]))
        for i, (head, page, error) in enumerate(zip(heads, column["page"].to_pylist(), column["error"].to_pylist())):
            if error is not None:
                raise ValueError(f"page {page} of document {head[0]} can't be read back: {error}")
            if page == 0:
                done += [now.row()] if now else []
                now = _Reading(head)
            now.add(column["samples"][i].as_py())
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), kinds)], names)
            done = []
    done += [now.row()] if now else []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), kinds)], names)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents stored as TIFF files, read back page by page, and digested."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pages(store_texts(docs)).mapInArrow(folded, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
