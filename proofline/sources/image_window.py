"""Image windows as a Python data source: every image file below a folder, with a reject code where it can't be used.

The driver walks the folder (names and kinds only) and deals the files into partitions; tasks look at each file again
before they open it, hash it as a stream, read its structure and look at its size and time once more. Links are never
followed, and what resolves outside the folder when it is read is rejected even if it did not when it was listed.

Structure is read from headers, chunks and directories of the formats (sizes, mode, number of frames, ends and checks
where the format has them); pixels are decoded by ``files.images``. The folder has to be mounted on all machines.
"""

from __future__ import annotations

import hashlib
import os
import stat
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from proofline.sources.ledger import local

FORMAT = "proofline_images"
SCHEMA = "path string, byte_size long, sha256 string, format string, mode string, width long, height long, frames int, failure_code string, content binary"
#: The extensions of a window, its reject codes, and the modes that features are defined for.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
CODES = ("SYMLINK_REJECTED", "PATH_ESCAPE_REJECTED", "RESOURCE_LIMIT", "INVALID_IMAGE", "UNSUPPORTED_IMAGE_MODE", "UNSUPPORTED_MULTIFRAME", "IO_ERROR", "FILE_CHANGED")
MODES = ("1", "L", "I", "F", "RGB", "RGBA")
#: Files of one partition, and characters of a reported path.
FILES, PATH_LENGTH = 256, 256


class Invalid(ValueError):
    """A file that is no readable image."""


# ---------------------------------------------------------------- structure: (format, mode, width, height, frames)


def _png(raw: bytes) -> tuple[str, str, int, int, int]:
    at, head, frames, ended = 8, None, 1, False
    while at + 12 <= len(raw) and not ended:
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(raw) or zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise Invalid("chunk")
        if kind == b"IHDR" and size >= 13:
            head = struct.unpack_from(">IIBB", body)
        elif kind == b"acTL" and size >= 4:
            frames = struct.unpack_from(">I", body)[0]
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise Invalid("no header or no end")
    width, height, bits, colour = head
    mode = {0: "1" if bits == 1 else "I" if bits == 16 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(colour)
    if mode is None:
        raise Invalid("colour type")
    return "PNG", mode, width, height, frames


def _jpeg(raw: bytes) -> tuple[str, str, int, int, int]:
    at, frames = 2, 1
    if b"\xff\xd9" not in raw[-64:]:
        raise Invalid("no end of image")
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            raise Invalid("marker")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = struct.unpack_from(">H", raw, at + 2)[0]
        if marker == 0xE2 and raw[at + 4 : at + 8] == b"MPF\0":
            frames = 2  # an index of several images follows
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 10 > len(raw):
                break
            height, width, parts = struct.unpack_from(">HHB", raw, at + 5)
            mode = {1: "L", 3: "RGB", 4: "CMYK"}.get(parts)
            if mode is None:
                raise Invalid("components")
            return "JPEG", mode, width, height, frames
        if marker == 0xDA:
            break
        at += 2 + size
    raise Invalid("no frame header")


def _bmp(raw: bytes) -> tuple[str, str, int, int, int]:
    if len(raw) < 30:
        raise Invalid("header")
    offset, size = struct.unpack_from("<II", raw, 10)
    if size == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", raw, 18)
    else:
        width, height, _, bits = struct.unpack_from("<iiHH", raw, 18)
    packing = struct.unpack_from("<I", raw, 30)[0] if size >= 40 and len(raw) >= 34 else 0
    height = abs(height)
    if bits not in (1, 4, 8, 16, 24, 32) or width < 0 or (not packing and offset + (width * bits + 31) // 32 * 4 * height > len(raw)):
        raise Invalid("data")
    if bits <= 8:
        step = 3 if size == 12 else 4
        table = raw[14 + size : offset]
        grey = all(table[i] == table[i + 1] == table[i + 2] for i in range(0, len(table) - 2, step))
        mode = ("1" if bits == 1 else "L") if grey else "P"
    else:
        mode = "RGBA" if packing == 3 and bits == 32 else "RGB"
    return "BMP", mode, width, height, 1


def _tiff(raw: bytes) -> tuple[str, str, int, int, int]:
    order = "<" if raw[:2] == b"II" else ">"
    at, seen, first = struct.unpack_from(order + "I", raw, 4)[0], set(), None
    while at:
        if at in seen or at + 2 > len(raw):
            raise Invalid("directory")
        seen.add(at)
        count = struct.unpack_from(order + "H", raw, at)[0]
        end = at + 2 + 12 * count
        if end + 4 > len(raw):
            raise Invalid("directory")
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            width = {1: 1, 3: 2, 4: 4}.get(kind)
            if width:
                place = at + 10 + 12 * i
                place = place if n * width <= 4 else struct.unpack_from(order + "I", raw, place)[0]
                if place + n * width > len(raw):
                    raise Invalid("values")
                tags[tag] = struct.unpack_from(f"{order}{min(n, 8)}{ {1: 'B', 2: 'H', 4: 'I'}[width]}", raw, place)
        first = first or tags
        at = struct.unpack_from(order + "I", raw, end)[0]
    if not first or 256 not in first or 257 not in first:
        raise Invalid("no size")
    one = lambda tag, default: first.get(tag, (default,))[0]
    bits, parts, sample = one(258, 1), one(277, 1), one(339, 1)
    mode = {0: None, 1: None, 2: {3: "RGB", 4: "RGBA"}.get(parts, "?") if bits == 8 else "?", 3: "P", 5: "CMYK", 6: "RGB"}.get(one(262, 1), "?")
    if mode is None:
        mode = "LA" if parts == 2 else {(1, 1): "1", (8, 1): "L", (16, 1): "I", (32, 1): "I", (32, 2): "I", (32, 3): "F"}.get((bits, sample), "?")
    return "TIFF", mode, one(256, 0), one(257, 0), len(seen)


def _webp(raw: bytes) -> tuple[str, str, int, int, int]:
    if struct.unpack_from("<I", raw, 4)[0] + 8 > len(raw):
        raise Invalid("length")
    kind = raw[12:16]
    if kind == b"VP8 " and raw[23:26] == b"\x9d\x01\x2a":
        width, height = (x & 0x3FFF for x in struct.unpack_from("<HH", raw, 26))
        return "WEBP", "RGB", width, height, 1
    if kind == b"VP8L" and raw[20] == 0x2F:
        bits = struct.unpack_from("<I", raw, 21)[0]
        return "WEBP", "RGBA" if bits >> 28 & 1 else "RGB", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 1
    if kind == b"VP8X":
        width, height = (int.from_bytes(raw[i : i + 3], "little") + 1 for i in (24, 27))
        at, frames = 12, 0
        while at + 8 <= len(raw):
            name, size = struct.unpack_from("<4sI", raw, at)
            frames += name == b"ANMF"
            at += 8 + size + (size & 1)
        return "WEBP", "RGBA" if raw[20] & 0x10 else "RGB", width, height, max(1, frames)
    raise Invalid("chunk")


def structure(raw: bytes) -> tuple[str, str, int, int, int]:
    """(format, mode, width, height, frames) of an image by its bytes, whatever its name; raises ``Invalid``."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:3] == b"\xff\xd8\xff":
            return _jpeg(raw)
        if raw[:2] == b"BM":
            return _bmp(raw)
        if raw[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(raw)
        if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            return _webp(raw)
    except (struct.error, IndexError) as e:
        raise Invalid("truncated") from e
    raise Invalid("no known format")


# ---------------------------------------------------------------- the source


class Files(InputPartition):
    """Files to read, and those that the walk rejected with their codes; paths are relative to the folder."""

    def __init__(self, names: list[str], rejected: list[tuple[str, str]]):
        self.names, self.rejected = names, rejected


def shown(path: str) -> str:
    """A path for reports: no control characters, bounded."""
    return "".join(c if c >= " " and c != "\x7f" else "?" for c in path)[:PATH_LENGTH]


class WindowReader(DataSourceReader):
    """Walks on the driver, reads in tasks."""

    def __init__(self, root: str, max_bytes: int, max_pixels: int, content: bool):
        self.root, self.max_bytes, self.max_pixels, self.content = root, max_bytes, max_pixels, content

    def partitions(self) -> list[Files]:
        root = local(self.root)
        if not root.exists():
            raise FileNotFoundError(f"no folder {self.root}")
        if root.is_symlink() or not root.is_dir():
            raise NotADirectoryError(f"{self.root} is no real folder")
        names, rejected = [], []
        for current, folders, files in os.walk(root, followlinks=False):
            inner = os.path.relpath(current, root)
            inner = "" if inner == "." else inner + "/"
            folders[:] = sorted(f for f in folders if not f.startswith("."))
            for link in [f for f in folders if os.path.islink(os.path.join(current, f))]:
                folders.remove(link)
                rejected.append((inner + link, "SYMLINK_REJECTED"))
            for name in sorted(files):
                if not name.startswith(".") and name.lower().endswith(EXTENSIONS):
                    if os.path.islink(os.path.join(current, name)):
                        rejected.append((inner + name, "SYMLINK_REJECTED"))
                    else:
                        names.append(inner + name)
        names.sort()
        dealt = [Files(names[i : i + FILES], []) for i in range(0, len(names), FILES)]
        return dealt + [Files([], rejected[i : i + FILES]) for i in range(0, len(rejected), FILES)] or [Files([], [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for name, code in partition.rejected:
            yield (shown(name), None, None, None, None, None, None, None, code, None)
        for name in partition.names:
            row = self._row(name)
            if row is not None:
                yield row

    def _row(self, name: str) -> tuple | None:
        root = local(self.root)
        path = root / name
        size = digest = None
        found: tuple = (None,) * 5
        raw = None

        def failed(code: str) -> tuple:
            return (shown(name), size, digest, *found, code, None)

        try:
            before = path.lstat()
            size = before.st_size
            if stat.S_ISLNK(before.st_mode):
                return failed("SYMLINK_REJECTED")
            if not path.resolve(strict=True).is_relative_to(root.resolve(strict=True)):
                return failed("PATH_ESCAPE_REJECTED")
            if not stat.S_ISREG(before.st_mode):
                return None
            if size > self.max_bytes:
                return failed("RESOURCE_LIMIT")
            raw = self.load(path)
            after = path.lstat()
        except OSError:
            return failed("IO_ERROR")
        if (before.st_size, before.st_mtime_ns, before.st_ino) != (after.st_size, after.st_mtime_ns, after.st_ino) or len(raw) != size:
            return failed("FILE_CHANGED")
        digest = hashlib.sha256(raw).hexdigest()
        try:
            found = structure(raw)
        except Invalid:
            return failed("INVALID_IMAGE")
        _, mode, width, height, frames = found
        if width <= 0 or height <= 0 or width * height > self.max_pixels:
            return failed("RESOURCE_LIMIT")
        if frames != 1:
            return failed("UNSUPPORTED_MULTIFRAME")
        if mode not in MODES:
            return failed("UNSUPPORTED_IMAGE_MODE")
        return (shown(name), size, digest, *found, None, raw if self.content else None)

    def load(self, path: Path) -> bytes:
        """All bytes of a file; at most ``max_bytes`` were announced, so one more shows that it grew."""
        with open(os.open(path, os.O_RDONLY | os.O_NOFOLLOW), "rb") as source:
            return source.read(self.max_bytes + 1)


class Window(DataSource):
    """``proofline_images``: options ``path``, ``maxBytes``, ``maxPixels``, ``content`` (true: with the bytes of usable files)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WindowReader:
        o = self.options
        return WindowReader(o["path"], int(o.get("maxBytes", 64 << 20)), int(o.get("maxPixels", 50_000_000)), o.get("content", "false").lower() == "true")


def scan(spark: SparkSession, folder: str, max_bytes: int = 64 << 20, max_pixels: int = 50_000_000, content: bool = False) -> DataFrame:
    """Every image file of a window (``SCHEMA``), usable or with a code of ``CODES``."""
    spark.dataSource.register(Window)
    return spark.read.format(FORMAT).option("path", folder).option("maxBytes", max_bytes).option("maxPixels", max_pixels).option("content", str(content).lower()).load()
