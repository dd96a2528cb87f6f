"""Pairwise metrics over whole windows and quantiles of large keys, against NumPy; work of single tasks is bounded."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.operators import pairwise, quantiles, vectors
from proofline.operators.relational import running_sum
from proofline.session import ship


def windows(spark, reference: np.ndarray, current: np.ndarray):
    ship(spark)
    rows = [("REFERENCE", i, v.tolist()) for i, v in enumerate(reference)] + [("CURRENT", i, v.tolist()) for i, v in enumerate(current)]
    return spark.createDataFrame(rows, "role string, id long, v array<double>").repartition(4)


def brute(reference: np.ndarray, current: np.ndarray) -> dict[str, float]:
    every = np.vstack([reference, current])
    d = ((every[:, None, :] - every[None, :, :]) ** 2).sum(-1)
    n = len(reference)
    middle = np.median(d[np.triu_indices(len(d), 1)])
    k = np.exp(-d / (2 * middle))
    own, other = np.sqrt(d[:n, :n]), np.sqrt(d[n:, :n]).min(1)
    np.fill_diagonal(own, np.inf)
    return {"median": middle, "mmd": k[:n, :n].mean() + k[n:, n:].mean() - 2 * k[n:, :n].mean(), "base": np.median(own.min(1)), "observed": np.median(other), "mean": other.mean(), "q95": np.quantile(other, 0.95), "own": own.min(1), "other": other}


def test_metrics_of_more_rows_than_any_cap(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 20, (12, 6))
    reference = centres[rng.integers(0, 12, 2300)] + rng.normal(0, 1, (2300, 6))
    current = centres[rng.integers(0, 6, 400)] + rng.normal(0.5, 1, (400, 6))
    df, want = windows(spark, reference, current), brute(reference, current)
    (row,) = vectors.mmd(df, "id", "v").collect()
    assert row.mmd == pytest.approx(want["mmd"], rel=1e-8) and row.state == "STABLE"
    assert vectors.bandwidth(df, "id", "v").first().bandwidth == pytest.approx(want["median"], rel=1e-10)
    near = {(r.role, int(r.id)): r.d for r in pairwise.nearest_reference(pairwise._plain(df, "id", "v"), tile=150).collect()}
    assert len(near) == 2700
    for role, values in (("REFERENCE", want["own"]), ("CURRENT", want["other"])):
        assert np.allclose([near[role, i] for i in range(len(values))], values)
    (row,) = vectors.nearest_support(df, "id", "v").collect()
    assert row.ratio == pytest.approx(want["observed"] / want["base"]) and (row.mean, row.q95) == (pytest.approx(want["mean"]), pytest.approx(want["q95"]))
    # clusters far apart: the triangle inequality leaves most cells unvisited
    assert row.compared < 0.35


def test_ties_copies_and_small_windows(spark):
    same = np.ones((30, 3))
    df = windows(spark, same, same[:5])
    assert vectors.bandwidth(df, "id", "v").first().asDict() == {"bandwidth": 1.0, "fallback": True}
    assert vectors.mmd(df, "id", "v").first().mmd == 0.0
    row = vectors.nearest_support(df, "id", "v").first()
    assert (row.ratio, row.mean, row.state) == (1.0, 0.0, "STABLE")
    one = windows(spark, np.zeros((1, 2)), np.ones((1, 2)))
    near = {r.role: r.d for r in pairwise.nearest_reference(pairwise._plain(one, "id", "v")).collect()}
    assert near == {"REFERENCE": None, "CURRENT": pytest.approx(2**0.5)}
    assert vectors.mmd(windows(spark, same, same + 3), "id", "v", fixed=2.0).first().mmd == pytest.approx(2 - 2 * np.exp(-27 / 4))
    with pytest.raises(ValueError):
        vectors.mmd(df, "id", "v", fixed=0.0)


def test_median_narrows_in_several_passes(spark):
    rng = np.random.default_rng(8)
    # most distances are tiny against the largest, so the first histogram puts nearly all into one slot
    rows = np.vstack([rng.normal(0, 1e-4, (300, 2)), [[1e3, 1e3], [-1e3, 0]]])
    plain = pairwise._plain(windows(spark, rows[:150], rows[150:]), "id", "v")
    d = ((rows[:, None, :] - rows[None, :, :]) ** 2).sum(-1)
    want = np.median(d[np.triu_indices(len(d), 1)])
    assert pairwise.median_distance(plain, tile=64, ordered=50) == pytest.approx(want, rel=1e-6)


def test_tiles_hold_bounded_groups(spark):
    rng = np.random.default_rng(1)
    plain = pairwise._plain(windows(spark, rng.normal(size=(900, 2)), rng.normal(size=(100, 2))), "id", "v")
    shapes = pairwise.tiles(plain, lambda d, a, b: __import__("pyarrow").table({"x": [d.shape[0]], "y": [d.shape[1]], "n": [int((d == d).sum())]}), "x long, y long, n long", tile=100).collect()
    assert max(max(r.x, r.y) for r in shapes) < 160 and sum(r.n for r in shapes) == 1000 * 999 // 2


@pytest.mark.parametrize("n", [3, 5000])
def test_quantiles_of_large_keys_equal_percentile(spark, n):
    rng = np.random.default_rng(n)
    values = [(k, float(x)) for k, m in (("a", n), ("b", 3), (None, n // 2)) for x in (rng.integers(0, 9, m) if k is None else rng.lognormal(0, 3, m))] + [("c", None)]
    df = spark.createDataFrame(values, "k string, v double")
    qs = {"low": 0.01, "middle": 0.5, "high": 0.999}
    for keys in (("k",), ()):
        want = {tuple(r[k] for k in keys): [r[q] for q in qs] for r in df.groupBy(*keys).agg(*(F.percentile("v", F.lit(q)).alias(name) for name, q in qs.items())).collect()}
        for plain in (0, 10**6):
            got = {tuple(r[k] for k in keys): [r[q] for q in qs] for r in quantiles.with_quantiles(df, keys, F.col("v"), qs, F.count("*").alias("n"), plain=plain).collect()}
            assert got.keys() == want.keys()
            for key, row in want.items():
                assert got[key] == [x if x is None else pytest.approx(x) for x in row]


def test_ranks_of_one_key_are_spread(spark):
    """What one task orders is a partition's share, though all rows have one key."""
    rows = spark.range(40_000).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("x"))
    ranked = running_sum(rows, ("k",), ("x",), F.lit(1)).withColumn("_task", F.spark_partition_id())
    sizes = [r["count"] for r in ranked.groupBy("_task").count().collect()]
    assert ranked.agg(F.max("running")).first()[0] == 40_000 and len(sizes) >= 4 and max(sizes) < 20_000


def test_wide_covariance_in_tiles(spark):
    ship(spark)
    x = np.random.default_rng(4).normal(size=(40, 300))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    got = np.zeros((300, 300))
    for r in vectors.covariance(df, "v").collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, np.cov(x, rowvar=False, ddof=0))
    assert vectors.covariance(df, "v", most=299).count() == 0
    one, two = (vectors.covariance_commitment(vectors.covariance(d, "v", tile=t)).first() for d, t in ((df, 128), (df.repartition(1), 64)))
    assert one.cells == 300 * 300 and one.commitment == two.commitment
    none = vectors.covariance_commitment(vectors.covariance(df, "v", most=2)).first()
    assert (none.commitment, none.cells) == (None, 0)


def test_vector_digests(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 1.0]), (4, None)], "id long, v array<double>")
    d = {r.id: r.d for r in df.select("id", vectors.vector_digest(F.col("v")).alias("d")).collect()}
    assert d[1] == d[2] != d[3] and d[4] is None


def test_rows_are_sent_to_a_bounded_number_of_places(spark, monkeypatch):
    """Blocks smaller than groups: the same sums and neighbours, and replicas that don't grow with the rows."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 3))
    plain = pairwise._plain(windows(spark, x[:400], x[400:]), "id", "v")
    shapes = pairwise.tiles(plain, lambda d, a, b: __import__("pyarrow").table({"k": ["all"], "n": [int((d == d).sum())]}), "k string, n long", tile=10, by="k").collect()
    assert len(shapes) == pairwise.GROUPS * (pairwise.GROUPS + 1) // 2 and sum(r.n for r in shapes) == 600 * 599 // 2
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    assert pairwise.median_distance(plain, tile=10) == pytest.approx(np.median(d[np.triu_indices(600, 1)]))
    np.fill_diagonal(d, np.inf)
    want = np.sqrt(d[:, :400].min(1))
    for part in (1 << 16, 30):
        monkeypatch.setattr(pairwise, "PART", part)
        got = sorted(r.d for r in pairwise.nearest_reference(plain, tile=16, pivots=20).collect())
        assert got == pytest.approx(sorted(want))


def test_copies_cost_no_pairs(spark):
    """400,000 rows of 60 vectors: pairs of copies are counted, not compared (all pairs took over a quarter of an hour)."""
    ship(spark)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    at = F.array(*(F.array(*map(F.lit, v.tolist())) for v in x))
    k = F.pmod(F.xxhash64("id"), F.lit(60 * 60))
    # the lower of two numbers, so that the vectors are not equally frequent
    df = spark.range(400_000).select("id", F.least((k % 60), F.floor(k / 60)).cast("int").alias("at")).select("id", "at", F.get(at, F.col("at")).alias("v"), F.when((F.col("id") + F.col("at")) % 3 == 0, "REFERENCE").otherwise("CURRENT").alias("role"))
    w = np.zeros((60, 2))
    for r in df.groupBy("at", "role").count().collect():
        w[r["at"], int(r.role == "CURRENT")] = r["count"]
    d, all_ = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), w.sum(1)
    pairs = np.outer(all_, all_)[np.triu_indices(60, 1)]
    values, n = np.concatenate([[0.0], d[np.triu_indices(60, 1)]]), np.concatenate([[(all_ * (all_ - 1) / 2).sum()], pairs])
    order = np.argsort(values)
    total, ends = n.sum(), np.cumsum(n[order])
    middle = np.mean([values[order][np.searchsorted(ends, r, side="right")] for r in ((total - 1) // 2, total // 2)])
    a, b = w[:, 0] / w[:, 0].sum(), w[:, 1] / w[:, 1].sum()
    kernel = np.exp(-d / (2 * middle))
    start = time.monotonic()
    assert vectors.bandwidth(df, "id", "v").first().bandwidth == pytest.approx(middle, rel=1e-10)
    assert vectors.mmd(df, "id", "v").first().mmd == pytest.approx((a - b) @ kernel @ (a - b), abs=1e-11)
    assert time.monotonic() - start < 240


def test_median_is_exact_whatever_the_sample_says(spark, monkeypatch):
    rng = np.random.default_rng(12)
    far, mixed = rng.normal(size=(700, 5)) + 1e4, rng.normal(size=(700, 5)) * np.where(np.arange(700) % 5 == 0, 1e3, 1e-2)[:, None]
    # of whole numbers many distances are equal, also the middle ones
    for x, close in ((far, 1e-9), (mixed, 1e-9), (np.unique(rng.integers(0, 4, (900, 6)).astype(float), axis=0), 1e-12)):
        plain = pairwise._plain(windows(spark, x[:300], x[300:]), "id", "v")
        d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)[np.triu_indices(len(x), 1)]
        assert pairwise.median_distance(plain, tile=300) == pytest.approx(np.median(d), rel=close)
    for wrong in (np.quantile(d, [0.1, 0.2, 0.3]), np.quantile(d, [0.8, 0.9, 0.95]), np.zeros(3), np.zeros(0)):
        monkeypatch.setattr(pairwise, "_sampled", lambda vectors, wrong=wrong: (wrong, np.ones(len(wrong)), 1e12))
        assert pairwise.median_distance(plain, tile=300, ordered=100) == pytest.approx(np.median(d), rel=1e-12)


def test_pivots_that_are_copies_and_vectors_without_length(spark):
    """Cells of pivots that are copies hold no row, also the last; a vector that is no number is nobody's nearest."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 4))
    reference, current = base[rng.integers(0, 3, 80)], np.vstack([rng.normal(size=(40, 4)), base])
    want = np.sqrt(((current[:, None, :] - base[None, :, :]) ** 2).sum(-1)).min(1)
    for odd in (reference, np.vstack([reference, np.full((2, 4), np.nan)])):
        near = {(r.role, int(r.id)): r.d for r in pairwise.nearest_reference(pairwise._plain(windows(spark, odd, current), "id", "v")).collect()}
        assert [near["CURRENT", i] for i in range(43)] == pytest.approx(want.tolist()) and all(near["REFERENCE", i] == 0 for i in range(80))
