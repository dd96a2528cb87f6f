"""An append-only table with versions: a Python data source whose commit is refused when another writer was first.

Layout: Parquet files in the folder itself, which tasks write and nobody changes; ``_versions/<n>.json`` names the files
that version n added. A write starts from a version; its tasks write files of their own, and its one commit creates the
marker of the next version exclusively, so of two writers that start from one version the second is refused and its
files go. Readers see what markers name. The folder has to be a path that the driver and all executors share and that
creates files exclusively (a local disk in tests, a POSIX mount on a cluster).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "proofline_ledger"
REFUSED = "LEDGER_VERSION_TAKEN"


def local(path: str) -> Path:
    """The folder of a path with or without a file scheme."""
    plain = path[5:] if path.startswith("file:") else path
    if "://" in plain:
        raise ValueError(f"a ledger needs a mounted folder, not {path}")
    return Path("/" + plain.lstrip("/")) if path.startswith("file:") else Path(plain)


def version(path: str) -> int:
    """The newest version; 0 where nothing was written."""
    folder = local(path) / "_versions"
    return max((int(p.stem) for p in folder.glob("*.json")), default=0) if folder.is_dir() else 0


def files(path: str, at: int) -> list[str]:
    """Files of the table as of a version, in order of commit."""
    folder = local(path)
    return [str(folder / name) for n in range(1, at + 1) for name in json.loads((folder / "_versions" / f"{n:012d}.json").read_text())["files"]]


@dataclass
class Wrote(WriterCommitMessage):
    """What a task wrote."""

    name: str | None
    rows: int


class LedgerWriter(DataSourceArrowWriter):
    """One file a task, one marker a write."""

    def __init__(self, path: str, base: int):
        self.path, self.base = path, base

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        name, rows, writer = f"{self.base + 1:012d}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if writer is None:
                where = local(self.path) / name
                where.parent.mkdir(parents=True, exist_ok=True)
                writer = pq.ParquetWriter(where, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return Wrote(None, 0)
        writer.close()
        return Wrote(name, rows)

    def commit(self, messages: list[Wrote | None]) -> None:
        wrote = [m for m in messages if m is not None and m.name]
        body = json.dumps({"files": sorted(m.name for m in wrote), "rows": sum(m.rows for m in wrote)}).encode()
        folder = local(self.path) / "_versions"
        folder.mkdir(parents=True, exist_ok=True)
        # a marker appears whole: it is written aside, and the link to its name is what can fail
        aside = folder / f".{uuid.uuid4().hex}"
        aside.write_bytes(body)
        try:
            os.link(aside, folder / f"{self.base + 1:012d}.json")
        except FileExistsError:
            self.abort(messages)
            raise RuntimeError(f"{REFUSED}: version {self.base + 1} of {self.path} is another writer's") from None
        finally:
            aside.unlink()

    def abort(self, messages: list[Wrote | None]) -> None:
        for m in messages:
            if m is not None and m.name:
                (local(self.path) / m.name).unlink(missing_ok=True)


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class LedgerReader(DataSourceReader):
    """The files of one version, a partition each."""

    def __init__(self, path: str, at: int, schema: T.StructType):
        self.path, self.at, self.names = path, at, schema.names

    def partitions(self) -> list[_File]:
        return [_File(name) for name in files(self.path, self.at)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from pq.ParquetFile(partition.name).iter_batches(columns=self.names)


class Ledger(DataSource):
    """``proofline_ledger``: options ``path``, ``base`` (the version a write starts from), ``version`` (the one to read)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        raise ValueError("a ledger is read with a schema")

    def writer(self, schema: T.StructType, overwrite: bool) -> LedgerWriter:
        if overwrite:
            raise ValueError("a ledger is append-only")
        return LedgerWriter(self.options["path"], int(self.options.get("base", version(self.options["path"]))))

    def reader(self, schema: T.StructType) -> LedgerReader:
        return LedgerReader(self.options["path"], int(self.options.get("version", version(self.options["path"]))), schema)


def write(df: DataFrame, path: str, base: int) -> None:
    """Append ``df`` as version ``base + 1``; raises where that version exists."""
    df.sparkSession.dataSource.register(Ledger)
    df.write.format(FORMAT).option("path", path).option("base", base).mode("append").save()


def read(spark: SparkSession, path: str, schema: T.StructType | str, at: int | None = None) -> DataFrame:
    """The table as of a version (the newest by default), through Spark's own Parquet reader where it has files."""
    found = files(path, version(path) if at is None else at)
    return spark.read.schema(schema).parquet(*(f"file://{f}" for f in found)) if found else spark.createDataFrame([], schema)
