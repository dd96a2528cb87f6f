import math
import random

import numpy as np
import pytest

from proofline.llm import neighbour_quality, toxicity
from proofline.llm.labelled import training_sample
from proofline.session import ship

SF = "/root/testdata/sf0.1"


def labelled(spark, found, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    return found.join(labels, "doc_id").toPandas()


def test_quality_held_out(spark):
    ship(spark)
    rows = labelled(spark, neighbour_quality.query(spark, SF), "quality")
    held = rows[rows.held_out]
    assert len(held) > 500 and rows.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.97
    assert (held[held.quality == 1].predicted == 1).mean() > 0.99


def test_toxicity_held_out(spark):
    ship(spark)
    rows = labelled(spark, toxicity.query(spark, SF), "toxic")
    held = rows[rows.held_out]
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.99
    # a few labels are given at random to documents without any sign
    assert (held[held.toxic == 1].predicted == 1).mean() > 0.88


def all_maximal(scores):
    """The definition: the best contiguous part, then the same on what is left of it and right of it."""
    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (top is None or total > top[0] + 1e-12):
                    top = (total, i, j)
        return [] if top is None else best(a, top[1]) + [top] + best(top[2] + 1, b)

    return best(0, len(scores))


def test_evidence_counts_every_segment():
    """Tails of sums of exponential scores: the r best against the expected number of segments, for the most telling r."""
    rate, density = 0.7, 0.01

    def tail(r, total):
        if r == 1:
            return -math.log(-math.expm1(-math.exp(-total))) if total < 30 else total
        return total - (r - 1) * math.log(total) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)) if total > r else 0.0

    rng = random.Random(8)
    for n_parts in (1, 2, 5, 40):
        parts, n = [rng.uniform(2, 9) for _ in range(n_parts)], 500
        top = sorted(parts, reverse=True)
        sums = [sum(rate * s - math.log(density * n) for s in top[:r]) for r in range(1, n_parts + 1)]
        want = max([0.0] + [tail(r, t) - math.log(2) * (r - 1) for r, t in enumerate(sums, 1)])
        assert abs(toxicity.evidence(parts, n, rate, density) - want) < 1e-9
    # more than any fixed number of segments counts
    assert toxicity.evidence([9.0] * 40, 500, rate, density) > toxicity.evidence([9.0] * 20, 500, rate, density)


@pytest.mark.parametrize("seed", range(25))
def test_segments_are_the_maximal_ones(seed):
    rng = random.Random(seed)
    n, drift = rng.randint(1, 40), 0.37
    places = sorted(rng.sample(range(n), rng.randint(1, n)))
    own = {p: rng.uniform(-3, 3) for p in places}
    line = [own.get(p, -drift) for p in range(n)]
    got = [(round(s, 9), places[a], places[b]) for s, a, b in toxicity.segments([own[p] for p in places], places, drift)]
    assert got == [(round(s, 9), a, b) for s, a, b in all_maximal(line)]


def test_passages_and_edges(spark):
    ship(spark)
    rng = random.Random(2)
    plain = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(n))
    docs = [(i, plain(60) + (" vile rotten scum" if i % 4 == 0 else "")) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "  "), (1003, plain(200_000)), (1003, plain(5)), (None, "vile rotten scum")]
    df = spark.createDataFrame([(*d, 7.0) for d in docs], "doc_id long, text string, SCORE double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 != 0)) for i in range(400)] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.train(df, labels)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    for r in rows:
        if r.doc_id is not None and r.doc_id < 1000:
            assert (r.score >= 0.5) == (r.doc_id % 4 == 0)
            if r.passages:
                p = r.passages[0]
                assert text[r.doc_id].encode()[p.start : p.end].decode() == "vile rotten scum"
        elif r.doc_id is not None:
            assert r.score < 0.5 and r.passages == []
    assert toxicity.score(df.limit(0), model).count() == 0
    bare = toxicity.train(df, labels.limit(0))
    assert {r.score < 0.01 for r in toxicity.score(df, bare).collect()} == {True}
    for known in (labels, labels.limit(0)):
        quality = neighbour_quality.score(df, neighbour_quality.train(df, known)).collect()
        assert len(quality) == len(docs) and all(0 <= r.score <= 1 for r in quality)
    assert training_sample(df, labels, "toxic", 7).count() == 7


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(60, neighbour_quality.WIDTH))).astype(np.float32)
    model = neighbour_quality.fit(x, rng.integers(0, 2, 60), rank=8)
    query = np.abs(rng.normal(size=(9, neighbour_quality.WIDTH))).astype(np.float32)
    got = neighbour_quality.vote(model, query, k=5)
    for row, score in zip(query, got):
        v = row @ model.projection
        cos = model.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cos)[:5]
        weight = np.maximum(cos[near], 0) ** 4
        assert abs(score - (weight * model.labels[near]).sum() / weight.sum()) < 1e-4


def test_scan_is_linear():
    """Twice the tokens take about twice the time, where every candidate stays, joins or is skipped."""
    import time

    def seconds(scores: list[float]) -> float:
        began = time.perf_counter()
        toxicity.segments(scores, list(range(len(scores))))
        return time.perf_counter() - began

    for unit in ([1, -2], [1, -0.5], [3, -1, -1, 1, -4]):
        short, long = (min(seconds([float(x) for x in unit] * n) for _ in range(3)) for n in (20_000, 80_000))
        assert long < 12 * short, (unit, short, long)


def test_ties_all_vote():
    """Equal labelled vectors with different labels: the score is the same in any order and any batch."""
    rng = np.random.default_rng(2)
    width = 8
    vectors = np.repeat(neighbour_quality._unit(rng.normal(size=(6, width)).astype(np.float32)), 20, axis=0)
    labels = np.tile([1.0, 0.0, 0.0, 0.0], 30).astype(np.float32)
    asked = rng.normal(size=(50, width)).astype(np.float32)
    scores = []
    for order in (np.arange(120), rng.permutation(120)):
        model = neighbour_quality.Model(np.eye(width, dtype=np.float32), vectors[order], labels[order], 0.5)
        scores.append(neighbour_quality.vote(model, asked, 10))
        scores.append(np.concatenate([neighbour_quality.vote(model, asked[i : i + 1], 10) for i in range(50)]))
    # a row without a like neighbour has the share of label 1 as its score
    assert all(np.allclose(scores[0], s) for s in scores[1:]) and set(np.round(scores[0], 6).tolist()) == {0.25, 0.5}
