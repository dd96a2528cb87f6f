import hashlib
import math
import random

import numpy as np
import pytest

from proofline.llm import suffix_dedup
from proofline.session import ship

LENGTH = suffix_dedup.LENGTH


def brute(rows, bucket=lambda row: 0):
    """Every window of every document in order, with all windows seen so far."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, bucket(r), (r[1] or "").encode())):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - LENGTH + 1):
            window = raw[i : i + LENGTH]
            if window in seen:
                gone[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = some(60), some(18)
    out = [(i, some(40) + " " + passage + " " + some(20)) for i in range(60)]
    out += [(100 + i, passage[: 90 + i]) for i in range(30)]
    out += [(200, None), (201, ""), (202, "short"), (203, "ab" * 400), (204, "x" * 99), (205, "x" * 100), (206, "x" * 101), (207, "x" * 1000)]
    out += [(300 + i, "same " * 50) for i in range(5)] + [(300, "same " * 50), (301, None)]
    out += [(400, (some(50) + "\n" + line + "\n") * 4), (401, line + line), (402, passage + passage)]
    out += [(500, passage + "q"), (500, "a" + passage), (None, passage), (None, None)]
    return out


@pytest.mark.parametrize(("bucket_bytes", "fan_in"), [(1 << 20, 4096), (2000, 4096), (1500, 3)])
def test_against_brute_force(spark, bucket_bytes, fan_in):
    ship(spark)
    data = rows()
    df = spark.createDataFrame([(d, t, "x") for d, t in data], "doc_id long, text string, N_BYTES string")
    found = suffix_dedup.dedup(df, bucket_bytes=bucket_bytes, fan_in=fan_in).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found]
    buckets = max(1, math.ceil(sum(len((t or "").encode()) for _, t in data) / bucket_bytes))
    named = df.select("doc_id", "text", suffix_dedup.bucket_of("doc_id", "text", buckets).alias("b")).collect()
    bucket = {(r.doc_id, r.text): r.b for r in named}
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(brute(data, lambda r: bucket[r[0], r[1]]), key=order)
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_one_id_on_all_rows_is_spread(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string")
    n = df.groupBy(suffix_dedup.bucket_of("doc_id", "text", 10).alias("b")).count().collect()
    assert len(n) == 10 and max(r["count"] for r in n) < 80


@pytest.mark.parametrize(("letters", "length", "seed"), [(2, 100, 1), (4, 100, 2), (250, 37, 3), (2, 8, 4), (3, 163, 5)])
def test_deep_shallow_is_a_sort(letters, length, seed):
    """All groups in the order of their bytes, with long common prefixes that part at every depth."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, letters, 400).astype(np.uint8)
    copies = [base.copy() for _ in range(50)]
    for i, c in enumerate(copies[1:]):
        if i % 3:
            c[rng.integers(0, 400, 1 + i % 2)] ^= 1
    data = np.concatenate([*copies, rng.integers(0, letters, 4000).astype(np.uint8)])
    start = np.concatenate([np.arange(0, 230, 7) + 400 * k for k in range(50)] + [np.arange(20_000, 23_000, 11)])
    size, group = np.full(len(start), length), np.where(start < 20_000, start % 400, 999)
    order, fresh = suffix_dedup.deep_shallow(data, start, size, group)
    key = lambda i: (group[i], data[start[i] : start[i] + length].tobytes(), i)
    assert order.tolist() == sorted(range(len(start)), key=key)
    assert fresh.tolist() == [k == 0 or key(order[k])[:2] != key(order[k - 1])[:2] for k in range(len(order))]
    seen, want = set(), []
    for i in range(len(start)):
        want.append(key(i)[:2] in seen)
        seen.add(key(i)[:2])
    assert suffix_dedup.repeats(data, start, length, group).tolist() == want
    none = np.zeros(0, dtype=np.int64)
    assert not len(suffix_dedup.repeats(data, none, LENGTH, none))
