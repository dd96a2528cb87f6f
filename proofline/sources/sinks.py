"""Sinks: immutable appends and strict reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.operators.relational import ingest_status
from proofline.session import cut, drop
from proofline.sources import ledger


def append_created(incoming: DataFrame, path: str, key: str, content: str, tries: int = 8) -> DataFrame:
    """Append the rows that are new under their key to a ledger (``sources.ledger``); what became of every row.

    Verdicts are taken against one version and written down; the rows are appended on top of that version only. Where
    another writer was first, the verdicts are taken again, so of two writers of one key the second gets EXISTS or
    CONFLICT, never both CREATED.
    """
    for _ in range(tries):
        base = ledger.version(path)
        stored = ledger.read(incoming.sparkSession, path, incoming.schema, base)
        status = cut(ingest_status(incoming, stored, key, content), "ingest")
        created = status.where("status = 'CREATED'").select(*incoming.columns)
        if not created.limit(1).count():
            return status
        try:
            ledger.write(created, path, base)
            return status
        except Exception as e:
            if ledger.REFUSED not in str(e):
                raise
            drop(status)
    raise RuntimeError(f"{tries} other writers were first at {path}")


def _strict(c: Column, kind: T.DataType) -> Column:
    """Whether all numbers inside a value of any depth are finite; null counts as such."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        ok = ~F.isnan(c) & (F.abs(c) < float("inf"))
    elif isinstance(kind, T.ArrayType):
        ok = F.forall(c, lambda x: _strict(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        ok = F.forall(F.map_values(c), lambda x: _strict(x, kind.valueType))
    elif isinstance(kind, T.StructType):
        ok = reduce(lambda a, f: a & _strict(c[f.name], f.dataType), kind.fields, F.lit(True))
    else:
        return F.lit(True)
    return F.coalesce(ok, F.lit(True))


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines; NaN and infinite numbers are refused, in lists, maps and structs too."""
    checked = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        refused = F.raise_error(F.lit(f"{f.name} is not finite")).cast(f.dataType)
        checked.append(F.when(_strict(c, f.dataType), c).otherwise(refused).alias(f.name))
    df.select(*checked).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
