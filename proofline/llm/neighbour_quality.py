"""Document quality by nearest-neighbour voting in a latent-semantic space.

Documents become frequencies of terms (words in lower case, hashed to ``TERMS`` columns), of word shapes (case, length,
last character, repetition, and pairs of shapes) and a few measures of the whole text, weighted by inverse document
frequency and projected on the leading singular directions of a labelled sample; terms as a whole weigh ``TERM_WEIGHT``
of what shapes do, since most of them tell the language and the subject. The labelled vectors are broadcast; every document is compared with all of them, in blocks of exact
cosine products, and its nearest neighbours vote with their similarities as weights.

Training takes at most ``MAX_LABELLED`` labelled documents; so at most MAX_LABELLED * (RANK + 1) numbers are broadcast.

Defined cases: a text without words (null, empty, blank) has no direction and gets the share of label 1 in the sample;
without labelled rows every score is 0.5; repeated rows are scored one by one; an empty table gives an empty result;
columns of the input that clash with the results' are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.labelled import held_out, training_sample
from proofline.llm.textcols import lowered, range_prints, rows_of, slices, word_spans

MAX_LABELLED = 4_000
RANK = 64
NEIGHBOURS = 15
ROWS = 1_024

_KIND = np.full(256, 7, dtype=np.uint8)  # by byte: capital, small, digit, stop, comma, loud, symbol, other
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 1
for _marks, _kind in ((b".;:", 3), (b",", 4), (b"!?", 5), (b"#*$%&|<>=+~^_@{}[]\\/", 6)):
    _KIND[list(_marks)] = _kind
_LENGTHS = np.searchsorted([2, 3, 4, 6, 9, 13, 21], np.arange(64), side="right")
_SHAPES = 5 * 8 * 8 * 2
_PAIRS = 384
_WHOLE = 6
#: Columns of hashed terms, and their weight beside word shapes.
TERMS, TERM_WEIGHT = 1_024, 0.5
WIDTH = _SHAPES + _PAIRS + _WHOLE + TERMS


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of shape frequencies and measures of the whole text, a row per document; rows of 0 without words."""
    rows = len(at) - 1
    starts, ends, edges = word_spans(data, at)
    n = np.diff(edges)
    out = np.zeros((rows, WIDTH), dtype=np.float32)
    if not len(starts):
        return out
    kind = _KIND[data]
    capitals, letters = (np.concatenate([[0], np.cumsum(kind == 0)]), np.concatenate([[0], np.cumsum(kind <= 1)]))
    caps, alphas = capitals[ends] - capitals[starts], letters[ends] - letters[starts]
    # no letters, all small, leading capital, all capitals, mixed
    case = np.select([alphas == 0, caps == 0, (caps == 1) & (kind[starts] == 0), caps == alphas], [0, 1, 2, 3], 4)
    tail = kind[ends - 1].astype(np.int64)
    prints = range_prints(data, starts, ends)
    doc = rows_of(edges)
    again = np.zeros(len(starts), dtype=np.int64)
    again[1:] = (prints[1:] == prints[:-1]) & (doc[1:] == doc[:-1])
    shape = ((case * 8 + _LENGTHS[np.minimum(ends - starts, 63)]) * 8 + tail) * 2 + again
    coarse = case * 8 + tail
    pair = (coarse[:-1] * 40 + coarse[1:]) % _PAIRS + _SHAPES
    within = doc[1:] == doc[:-1]
    term = (range_prints(lowered(data), starts, ends) % np.uint64(TERMS)).astype(np.int64) + _SHAPES + _PAIRS + _WHOLE
    cells = np.concatenate([doc * WIDTH + shape, (doc[1:] * WIDTH + pair)[within], doc * WIDTH + term])
    counts = np.bincount(cells, minlength=rows * WIDTH).reshape(rows, WIDTH)
    share = np.maximum(1, n)[:, None]
    out[:] = np.sqrt(counts / share)
    order = np.lexsort((prints, doc))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (prints[order][1:] != prints[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=rows)
    # repeated 3-word windows show templates and loops, which few distinct words do not in a long text
    if len(prints) > 2:
        with np.errstate(over="ignore"):
            window = prints[:-2] * np.uint64(3) ^ prints[1:-1] * np.uint64(5) ^ prints[2:] * np.uint64(7)
        d3 = doc[:-2]
        whole = d3 == doc[2:]
        window, d3 = window[whole], d3[whole]
        order = np.lexsort((window, d3))
        old = np.zeros(len(order), dtype=bool)
        old[1:] = (window[order][1:] == window[order][:-1]) & (d3[order][1:] == d3[order][:-1])
        repeats = np.bincount(d3[order][old], minlength=rows) / np.maximum(1, n - 2)
    else:
        repeats = np.zeros(rows)
    used = n > 0
    base = _SHAPES + _PAIRS
    out[used, base] = np.sqrt(repeats[used])
    out[used, base + 1] = np.sqrt(np.maximum(0, 1 - distinct / np.maximum(1, n)) * np.minimum(1, 50 / np.maximum(1, n)))[used]
    symbols = np.concatenate([[0], np.cumsum(kind == 6)])
    loud = np.concatenate([[0], np.cumsum(kind == 5)])
    size = np.maximum(1, np.diff(at))
    out[:, base + 2] = np.sqrt(np.minimum(1, 4 * np.diff(symbols[at]) / size))
    out[:, base + 3] = np.sqrt(np.minimum(1, 4 * np.diff(loud[at]) / size))
    out[:, base + 4] = np.sqrt(np.diff(capitals[at]) / np.maximum(1, np.diff(letters[at])))
    out[used, base + 5] = (n < 20)[used]
    return out


@dataclass(frozen=True)
class Model:
    """Projection (feature weights folded in), unit vectors of the labelled sample, their labels and the prior."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(matrix: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """Latent-semantic space of a sample: idf weights, then its leading right singular vectors."""
    if not len(labels):
        return Model(np.zeros((WIDTH, 1), dtype=np.float32), np.zeros((0, 1), dtype=np.float32), np.zeros(0, dtype=np.float32), 0.5)
    present = (matrix > 0).sum(axis=0)
    idf = np.log((1 + len(matrix)) / (1 + present)) + 0.05
    idf[_SHAPES + _PAIRS : -TERMS] = 2.0
    idf[-TERMS:] *= TERM_WEIGHT
    weighted = matrix * idf
    values, vectors = np.linalg.eigh(weighted.T @ weighted)
    projection = (idf[:, None] * vectors[:, np.argsort(values)[::-1][:rank]]).astype(np.float32)
    return Model(projection, _unit((matrix @ projection).astype(np.float32)), labels.astype(np.float32), float(labels.mean()))


def vote(model: Model, matrix: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among each row's nearest labelled vectors.

    Similarities count to five decimals, and where several are as near as the last one that votes, all of them vote: so
    neither the order of the labelled rows nor the batch that a row is in shows in a score.
    """
    out = np.full(len(matrix), model.prior)
    k = min(k, len(model.labels))
    if not k:
        return out
    query = _unit(matrix @ model.projection)
    known = np.flatnonzero(query.any(axis=1))
    likeness = np.round(query[known] @ model.vectors.T, 5)
    near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(likeness, near, axis=1), 0).astype(np.float64) ** 4
    total = weight.sum(axis=1)
    share = (weight * model.labels[near]).sum(axis=1)
    last = np.take_along_axis(likeness, near, axis=1).min(axis=1)
    for i in np.flatnonzero((likeness >= last[:, None]).sum(axis=1) > k):
        voters = np.flatnonzero(likeness[i] >= last[i])
        all_weights = np.maximum(likeness[i, voters], 0).astype(np.float64) ** 4
        total[i], share[i] = all_weights.sum(), (all_weights * model.labels[voters]).sum()
    out[known] = np.where(total > 0, share / np.where(total > 0, total, 1), model.prior)
    return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> Model:
    """A model from at most ``limit`` labelled training documents, whose features are computed where the texts are."""

    def vectors(batches):
        for batch in batches:
            for first, last, data, at in slices(batch.column(2), rows_limit=ROWS):
                rows = features(data, at)
                packed = pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())
                known = [batch.column(k).slice(first, last - first) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*known, packed], ["doc_id", "label", "features"])

    sample = training_sample(docs, labels, label, limit).select("doc_id", "label", "text")
    rows = sample.mapInArrow(vectors, "doc_id long, label int, features binary").toArrow().sort_by("doc_id")
    matrix = np.frombuffer(b"".join(rows["features"].to_pylist()), dtype=np.float16).reshape(-1, WIDTH).astype(np.float32)
    full = matrix.any(axis=1)
    return fit(matrix[full], rows["label"].to_numpy()[full])


def scored(batches: Iterable[pa.RecordBatch], model: Model, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches with ``score`` beside their other columns."""
    for batch in batches:
        scores = [vote(model, features(data, at)) for _, _, data, at in slices(batch.column(batch.schema.get_field_index(text)), rows_limit=ROWS)]
        keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != "score"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], [*(batch.schema.names[i] for i in keep), "score"])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: how likely label 1 is."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name.lower() != "score"]
    return docs.mapInArrow(lambda it: scored(it, sent.value, text), T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents scored for quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
