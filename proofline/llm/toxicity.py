"""Toxicity by maximum-scoring segments.

A term is a token or the leading bytes of one (inflected and compound words share those). Its score is its log-odds
between toxic and clean documents under an informative Dirichlet prior, where that is significant; a token takes the
highest score among its terms, less a small drift. The maximal scoring segments of a document are found in one linear
scan; their scores are judged by extreme-value statistics (how high such segments get by chance in that many clean
tokens), summed over a document's segments, the most telling number of them. The evidence is mapped to a probability
on labelled rows that its term scores were not learned from: two halves of the sample judge each other.

Training takes at most ``MAX_LABELLED`` labelled documents. Their significant terms and segments are all kept, so that
bound limits what reaches the driver and what is broadcast.

Defined cases: null and empty texts have no segments and get the score of a document without evidence; without any
labelled toxic document every score is 0; repeated rows are scored one by one; an empty table gives an empty result;
columns of the input that clash with the results' are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.labelled import held_out, training_sample
from proofline.llm.textcols import lowered, range_prints, rows_of, slices
from proofline.session import cut

MAX_LABELLED = 20_000
#: The prior's weight as a share of all counts; the least |z| of a scored token; what each token costs.
PRIOR, LEAST_Z, DRIFT = 0.1, 3.0, 0.02
#: Log-odds below which a term is no evidence on its own, for either class.
LEAST_SCORE = 1.5

_PART = np.zeros(256, dtype=bool)
_PART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters and digits (in lower case) and of other characters from U+0080: (fingerprints, starts, ends, first of each document)."""
    low = lowered(data)
    inside = _PART[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[at] = True
    opens, closes = inside.copy(), inside.copy()
    if len(low):
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return range_prints(low, starts, ends), starts, ends, np.searchsorted(starts, at)


#: Lengths in bytes of the leading parts that count as terms of longer tokens.
STEMS = (4, 5, 6, 7)


def terms_of(data: np.ndarray, at: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with their terms: ([(fingerprints, tokens that have one), whole tokens first], starts, ends, first of each document)."""
    prints, starts, ends, edges = tokens(data, at)
    low, kinds = lowered(data), [(prints, np.arange(len(prints)))]
    for k in STEMS:
        longer = np.flatnonzero(ends - starts > k)
        kinds.append((range_prints(low, starts[longer], starts[longer] + k) ^ np.uint64(k), longer))
    return kinds, starts, ends, edges


@dataclass(frozen=True)
class Model:
    """Scored terms (sorted fingerprints), extreme-value parameters and the final logistic map."""

    terms: np.ndarray
    scores: np.ndarray
    rate: float
    density: float
    slope: float = 0.0
    base: float = 0.0


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
        for first, last, data, at in slices(batch.column(batch.schema.get_field_index("text"))):
            kinds, _, _, edges = terms_of(data, at)
            doc, toxic_doc = rows_of(edges), label[first:last].astype(bool)
            for k, (prints, of) in enumerate(kinds):
                # a document counts a term once, so that loops and refrains don't pass for evidence
                order = np.lexsort((doc[of], prints))
                term, own = prints[order], doc[of][order]
                once = np.ones(len(term), dtype=bool)
                once[1:] = (term[1:] != term[:-1]) | (own[1:] != own[:-1])
                terms, back = np.unique(term[once], return_inverse=True)
                toxic = np.bincount(back, weights=toxic_doc[own[once]], minlength=len(terms)).astype(np.int64)
                every = np.bincount(back, minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), k == 0)), pa.array(toxic), pa.array(every - toxic)], ["term", "whole", "toxic", "clean"])


def _terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The significant terms: (sorted fingerprints, scores, probability in clean text)."""
    found = sample.select("text", "label").mapInArrow(_counted, "term long, whole boolean, toxic long, clean long")
    counts = cut(found.groupBy("term", "whole").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")), "toxic-terms")
    totals = counts.where("whole").agg(F.sum("t"), F.sum("c")).first()
    n_t, n_c = float(totals[0] or 0), float(totals[1] or 0)
    none = np.zeros(0)
    if not n_t or not n_c:
        return none.astype(np.uint64), none, none
    weight = PRIOR * (n_t + n_c)
    prior = (F.col("t") + F.col("c")) * F.lit(PRIOR)
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(n + weight) - F.col(y) - prior))
    error = F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    rated = counts.select("term", "c", (odds("t", n_t) - odds("c", n_c)).alias("s"), error.alias("e"), prior.alias("p"))
    best = rated.where((F.abs(F.col("s") / F.col("e")) >= LEAST_Z) & (F.abs("s") >= LEAST_SCORE)).toPandas()
    term = best["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(term)
    return term[order], best["s"].to_numpy(float)[order], ((best["c"] + best["p"]) / (n_c + weight)).to_numpy(float)[order]


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 for a clean token's score."""
    if not (scores > 0).any():
        return 1.0
    rest = max(0.0, 1.0 - share.sum())
    over = lambda x: float((share * np.exp(np.minimum(x * scores, 500))).sum() + rest * math.exp(-x * DRIFT) - 1)
    low, high = 1e-6, 1.0
    while over(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if over(middle) < 0 else (low, middle)
    return low


def segments(scores: list[float], places: list[int], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first event, last event): one linear scan with a stack of candidates.

    Events are the tokens with a score of their own, at ``places``; each token between them costs ``drift``. Every
    candidate links to the nearest earlier one with a smaller sum before it, so a search skips what an earlier search skipped.
    """
    left: list[float] = []  # of each candidate: the sum before it and through it, its first and last event, its link
    through: list[float] = []
    first: list[int] = []
    final: list[int] = []
    link: list[int] = []
    total, last = 0.0, None
    for k, (s, at) in enumerate(zip(scores, places)):
        if last is not None:
            total -= drift * (at - last - 1)
        last = at
        before, total = total, total + s
        if s <= 0:
            continue
        begin, j = k, len(left) - 1
        while True:
            while j >= 0 and left[j] >= before:
                j = link[j]
            if j < 0 or through[j] >= total:
                break
            # the candidate joins with the one at j and all between; what is smaller than that one is at its link
            before, begin, earlier = left[j], first[j], link[j]
            del left[j:], through[j:], first[j:], final[j:], link[j:]
            j = earlier
        left.append(before)
        through.append(total)
        first.append(begin)
        final.append(k)
        link.append(j)
    return [(r - l, a, b) for l, r, a, b in zip(left, through, first, final)]


def evidence(best: list[float], n: int, rate: float, density: float) -> float:
    """-log of the chance that clean text of n tokens holds segments as high as the r best, for the most telling r."""
    out, total, log_fact = 0.0, 0.0, 0.0
    for r, s in enumerate(sorted(best, reverse=True), 1):
        total += rate * s - math.log(max(density * n, 1e-9))
        log_fact += math.log(r) + (math.log(r - 1) if r > 1 else 0.0)
        if r == 1:
            p = -math.log(max(1e-300, -math.expm1(-math.exp(min(50.0, -total))))) if total < 30 else total
        elif total > r:
            p = total - (r - 1) * math.log(total) + log_fact
        else:
            p = 0.0
        out = max(out, p - (r > 1) * math.log(2) * (r - 1))
    return out


def _scan(model: Model, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """Tokens and segments (score, first byte, end byte) of each document of a slice."""
    kinds, starts, ends, edges = terms_of(data, at)
    best = np.zeros(len(starts))
    for prints, of in kinds if len(model.terms) else ():
        near = np.minimum(np.searchsorted(model.terms, prints), len(model.terms) - 1)
        hit = np.flatnonzero(model.terms[near] == prints)
        value, place = model.scores[near[hit]], of[hit]
        # whole tokens come first and may lower a score; their leading parts only raise it
        best[place] = value if of is kinds[0][1] else np.maximum(best[place], value)
    hit = np.flatnonzero(best)
    score = best[hit]
    of = np.searchsorted(hit, edges)
    above = np.concatenate([[0], np.cumsum(score > 0)])[of]
    for d in range(len(at) - 1):
        n = int(edges[d + 1] - edges[d])
        if above[d + 1] == above[d]:
            yield n, []
            continue
        own = slice(of[d], of[d + 1])
        places = hit[own]
        yield n, [(s, int(starts[places[a]] - at[d]), int(ends[places[b]] - at[d])) for s, a, b in segments((score[own]).tolist(), places.tolist())]


_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))


def scored(batches: Iterable[pa.RecordBatch], model: Model, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches with ``n_tokens``, ``evidence``, ``score`` and significant ``passages`` (byte ranges) beside their other columns."""
    own = ["n_tokens", "evidence", "score", "passages"]
    for batch in batches:
        sizes, proofs, found = [], [], []
        for _, _, data, at in slices(batch.column(batch.schema.get_field_index(text))):
            for n, parts in _scan(model, data, at):
                sizes.append(n)
                proofs.append(evidence([s for s, _, _ in parts], n, model.rate, model.density) if parts else 0.0)
                rated = [(a, b, s, model.density * n * math.exp(-model.rate * s)) for s, a, b in parts]
                found.append([dict(zip(("start", "end", "score", "e_value"), x)) for x in rated if x[3] < 1])
        p = 1 / (1 + np.exp(-np.clip(model.slope * np.array(proofs) + model.base, -50, 50)))
        keep = [i for i, n in enumerate(batch.schema.names) if n.lower() not in own]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sizes, pa.int64()), pa.array(proofs, pa.float64()), pa.array(p, pa.float64()), pa.array(found, _PASSAGES)], [*(batch.schema.names[i] for i in keep), *own])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and base of a one-variable logistic map, by Newton steps under a weak penalty."""
    if not len(y) or y.min() == y.max():
        return 0.0, -50.0 if not len(y) or not y.max() else 50.0
    design, w = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * w)
    return float(max(0.0, w[0])), float(w[1])


def _scores(sample: DataFrame) -> Model:
    """Term scores of a sample, with the rate at which high segments get rare in its clean text."""
    terms, scores, share = _terms(sample)
    net = scores - DRIFT
    return Model(terms, net, _rate(net, share), 1.0)


def _judged(sample: DataFrame, model: Model) -> pd.DataFrame:
    """label, n (tokens) and the scores of all segments of each document of the sample."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def parts(batches):
        for batch in batches:
            rows = [(n, [s for s, _, _ in got]) for _, _, data, at in slices(batch.column(1)) for n, got in _scan(sent.value, data, at)]
            columns = [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "n", "parts"])

    return sample.select("label", "text").mapInArrow(parts, "label int, n long, parts array<double>").toPandas()


def _density(rows: pd.DataFrame, model: Model) -> float:
    """Segments in clean text number about density * tokens * exp(-rate * least score)."""
    clean = rows[rows["label"] == 0]
    if not len(clean):
        return 1.0
    least = model.scores[model.scores > 0].min() if (model.scores > 0).any() else 1.0
    share = float(clean["parts"].map(len).sum()) / max(1.0, float(clean["n"].sum()))
    return max(1e-6, share * math.exp(model.rate * least))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELLED) -> Model:
    """A model from the labelled training documents: terms of all, calibrated on halves by the other half's terms."""
    bare = training_sample(docs, labels, label, limit).dropDuplicates(["text"])
    sample = cut(bare.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))), "toxic-sample")
    proof, known, density = [], [], []
    for half in (0, 1):
        model, own = _scores(sample.where(F.col("half") != half)), sample.where(F.col("half") == half)
        rows = _judged(own, model)
        density.append(_density(rows, model))
        proof += [evidence(list(s), n, model.rate, density[-1]) if len(s) else 0.0 for s, n in zip(rows["parts"], rows["n"])]
        known += rows["label"].tolist()
    model = _scores(sample)
    slope, base = logistic(np.array(proof, dtype=float), np.array(known, dtype=float))
    return Model(model.terms, model.scores, model.rate, float(np.mean(density)), slope, base)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``scored``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())]))
    own = [T.StructField("n_tokens", T.LongType()), T.StructField("evidence", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("passages", passage)]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {f.name for f in own}]
    return docs.mapInArrow(lambda it: scored(it, sent.value, text), T.StructType([*kept, *own]))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))
