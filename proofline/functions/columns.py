"""Column helpers that the operators share. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "...[truncated]"
ID_PREFIX = {"dataset_integrity": "DATASET", "model_integrity": "MODEL", "inference_integrity": "INFERENCE", "distribution_shift": "SHIFT"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it in ``body`` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def public(x: Column, digits: int = 12) -> Column:
    """A metric's public form: rounded, with negative zero as zero."""
    return F.round(x, digits) + F.lit(0.0)


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def canonical(**fields: Column) -> Column:
    """JSON text with sorted keys, without spaces, nulls included."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def finding_id(module: Column, category: Column, asset_id: Column, key: Column) -> Column:
    """The deterministic id of a finding: its module's prefix and 24 hex digits over what identifies it."""
    prefix = F.coalesce(*(F.when(module == m, F.lit(p)) for m, p in ID_PREFIX.items()))
    body = canonical(asset_id=asset_id, category=category, module=module, stable_evidence_key=F.array_sort(key))
    return F.concat(F.lit("F-"), prefix, F.lit("-"), F.substring(F.sha2(body, 256), 1, 24))


def bounded_text(x: Column, most: int = 512) -> Column:
    """A text of at most ``most`` characters, marked where it was cut."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - len(MARK)), F.lit(MARK))).otherwise(x)


def bounded_list(xs: Column, most: int = 20, width: int = 512) -> Column:
    """The first ``most`` texts of a list, each bounded."""
    return F.transform(F.slice(xs, 1, most), lambda x: bounded_text(x, width))


def masked(path: Column) -> Column:
    """A path with control characters shown as question marks."""
    return F.regexp_replace(path, r"[\x00-\x1f\x7f]", "?")


def basename(path: Column) -> Column:
    """The last part of a path of either slash."""
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def unsafe_path(path: Column) -> Column:
    """Whether a relative path would leave its root: absolute, on a drive, or with a parent step."""
    plain = F.regexp_replace(path, r"\\", "/")
    return plain.startswith("/") | plain.rlike("^[A-Za-z]:") | plain.rlike(r"(^|/)\.\.(/|$)")


def is_sha256(x: Column) -> Column:
    """64 lower-case hex digits."""
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def strict_base64(x: Column, most: int) -> Column:
    """Bytes of a base64 text; null when it is malformed or longer than ``most`` bytes."""
    raw = F.try_to_binary(x, F.lit("base64"))
    return F.when(F.length(raw) <= most, raw)


def evidence_value(evidence: Column, key: str) -> Column:
    """The value of the first ``key=value`` item of an evidence list."""
    return F.substring(F.get(F.filter(evidence, lambda e: e.startswith(f"{key}=")), F.lit(0)), len(key) + 2, 1 << 20)


def product(xs: Column) -> Column:
    """Product of longs; null when it overflows or a factor is negative or null."""
    return F.when(F.forall(xs, lambda x: x.isNotNull() & (x >= 0)), F.aggregate(xs, F.lit(1).cast("long"), lambda a, x: F.try_multiply(a, x.cast("long"))))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null when a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.lit(1.0) - dot(a, b) / size)


def entropy(p: Column) -> Column:
    """Normalised base-2 entropy of a probability vector: 0 for one class."""
    bits = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))
    return F.when(F.size(p) > 1, bits / F.log2(F.size(p).cast("double"))).otherwise(F.lit(0.0))


def margin(p: Column) -> Column:
    """Largest minus second probability; null for one class."""
    return F.when(F.size(p) > 1, let(F.sort_array(p, asc=False), lambda s: F.get(s, F.lit(0)) - F.get(s, F.lit(1))))


def median_signature(v: Column) -> Column:
    """64 bits, first element first: whether each is above the median of all but the first."""
    middle = F.get(F.sort_array(F.slice(v, 2, 63)), F.lit(31))
    return let(middle, lambda m: F.aggregate(v, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > m, F.lit(1)).otherwise(F.lit(0)).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))
