"""Metrics over all pairs of two windows of vectors, in tiles: kernel two-sample statistics and nearest neighbours.

Rows (``role``: REFERENCE or CURRENT, an id, a vector) are dealt into groups by a hash: ``GROUPS`` at most,
until one would hold more than ``PART`` rows. So a row is sent to as many places as there are groups, whatever the number
of rows. A tile is a pair of groups, and one task multiplies one tile at a time in NumPy, in blocks of ``BLOCK`` rows by
``BLOCK``, so a task holds two groups and one block however large the windows are; what leaves a tile is a sum, a histogram
or a minimum for each row. All pairs are work with the square of the rows by definition; nothing else grows so.

Where distances are only compared with bounds (the median's search, nearest rows), a block is multiplied in single
precision first. A bound on its error tells which pairs it decides; the others are taken again in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators.quantiles import with_quantiles
from proofline.operators.relational import running_sum
from proofline.session import cut

#: Rows of a tile before there are several groups, slots of a histogram of distances, and values that are put in order after it.
TILE, SLOTS, ORDERED = 2048, 1 << 16, 1 << 20
#: Rows of a block, which a processor's cache holds, and the share of its pairs that are taken again one by one at most.
BLOCK, AGAIN = 512, 1 / 16
#: Rows that each row meets to the left and right in the sample that brackets the median, and deviations that this reaches.
MET, REACH = 32, 4
#: Groups that rows are dealt into, and the most rows of one, which goes first.
GROUPS, PART = 16, 1 << 16
#: Reference rows that stand for cells of the nearest-neighbour search, and regions of cells that rows are sent to.
PIVOTS, REGIONS = 64, 16
ROLES = ("REFERENCE", "CURRENT")


def _matrix(rows: pa.Table, name: str) -> np.ndarray:
    lists = rows[name].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two matrices."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0)


def _plain(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select("role", F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _summed(tables: list[pa.Table], by: str | None) -> pa.Table:
    """Tables of one schema as one; with ``by``, a row for each of its values with the sums of the other columns."""
    whole = pa.concat_tables(tables)
    if by is None:
        return whole
    others = [c for c in whole.column_names if c != by]
    found = whole.group_by(by).aggregate([(c, "sum") for c in others])
    return pa.table({c: found[c if c == by else f"{c}_sum"] for c in whole.column_names})


def _grouped(rows: DataFrame, groups: int, by: tuple[str, ...], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on every pair of groups of ``rows``, once; both sides are the same table where a group meets itself."""
    dealt = rows.withColumn("_g", F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int"))
    # a partition holds few tiles, so that small ones aren't put together and the last task doesn't hold many
    deal = lambda side: side.repartition(groups * (groups + 1), "a", "b").groupBy("a", "b")
    one = dealt.select(F.col("_g").alias("a"), F.explode(F.sequence("_g", F.lit(groups - 1))).alias("b"), *rows.columns)
    two = dealt.where("_g > 0").select(F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("a"), F.col("_g").alias("b"), *rows.columns)
    return deal(one).cogroup(deal(two)).applyInArrow(lambda key, left, right: run(left, left if key[0].as_py() == key[1].as_py() else right), schema)


def _groups(n: int, tile: int) -> int:
    return max(1, min(math.ceil(n / tile), GROUPS), math.ceil(n / PART))


def tiles(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str, tile: int = TILE, by: str | None = None) -> DataFrame:
    """``work`` (squared distances, roles of both sides as 0 and 1) on every block of at most ``tile`` rows by ``tile``.

    A pair of different rows is in one block, once; distances of a row to itself and the mirrored half of a block of rows
    with themselves are NaN. With ``by``, what the blocks of a tile give is summed by that column before it leaves.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        same = left is right
        x, y = _matrix(left, "v"), _matrix(right, "v")
        a, b = (np.array([r == ROLES[1] for r in side["role"].to_pylist()], dtype=np.int64) for side in (left, right))
        found = [work(np.zeros((0, 0)), a[:0], b[:0])]
        for i in range(0, len(x), tile):
            for j in range(i if same else 0, len(y), tile):
                d = squared(x[i : i + tile], y[j : j + tile])
                if same and i == j:
                    d[np.tril_indices(len(d))] = np.nan
                found.append(work(d, a[i : i + tile], b[j : j + tile]))
                if by is not None and sum(map(len, found)) > 1 << 20:
                    found = [_summed(found, by)]
        return _summed(found, by)

    return _grouped(rows.select("role", "id", "v"), _groups(rows.count(), tile), ("role", "id"), run, schema)


def distinct(rows: DataFrame) -> DataFrame:
    """(v, r, c): the different vectors, and how many rows of each role have them. Pairs of copies need no distance."""
    return cut(rows.where("v IS NOT NULL").groupBy("v").agg(*(F.count_if(F.col("role") == role).alias(n) for role, n in zip(ROLES, "rc"))), "distinct")


class _Frame:
    """A centre and a scale that bring rows near 0 and to lengths of at most 1; any will do, good ones make blocks decide more."""

    def __init__(self, centre: np.ndarray, most: float):
        self.centre = centre
        self.scale = 1 / (math.sqrt(most) + float(np.sqrt((centre * centre).sum())) or 1.0)

    def of(self, v: np.ndarray) -> np.ndarray:
        return (v - self.centre) * self.scale if len(v) else np.zeros((0, len(self.centre)))


def _frame(vectors: DataFrame) -> _Frame | None:
    """The frame of some vectors (a column ``v``): the medians of a few, and the largest length; None without a vector of finite length."""
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    finite = vectors.where(length < float("inf"))
    most = finite.agg(F.max(length)).first()[0]
    if most is None:
        return None
    some = _matrix(finite.select("v").limit(1000).toArrow(), "v")
    return _Frame(np.median(some, axis=0), most)


class _Side:
    """Rows of one side of a tile, framed, and beside them what makes a product of both sides their squared distances."""

    def __init__(self, v: np.ndarray, frame: _Frame):
        self.v, z = v, frame.of(v)
        with np.errstate(all="ignore"):
            self.square = (z * z).sum(1)
            self.z, self.length = z, np.sqrt(self.square)

    def left(self, factor: float = 1.0) -> np.ndarray:
        return np.column_stack([self.z * -2.0, self.square, np.ones(len(self.z))]) * factor

    def right(self) -> np.ndarray:
        return np.column_stack([self.z, np.ones(len(self.z)), self.square])


def _single(side: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(side, dtype=np.float32)


def _error(dims: int, x: np.ndarray, y: np.ndarray) -> float:
    """What a squared distance by products in single precision may be off, for rows of these lengths.

    A product of k numbers is off by at most about k units of rounding of the sum of their amounts, which is at most the
    square of both lengths together; 2 units come from storing the numbers. The small terms are for the frame and underflow.
    """
    far = float(x.max(initial=0.0, where=np.isfinite(x)) + y.max(initial=0.0, where=np.isfinite(y)))
    return (dims + 14) * 2.0**-24 * far * far + 1e-14 * far + 1e-30


def _apart(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, one by one; a pair has the same wherever it stands. Memory is used over and over."""
    found, step = np.empty(len(p)), min(len(p), 512)
    a, b = np.empty((step, x.shape[1])), np.empty((step, x.shape[1]))
    for i in range(0, len(p), 512):
        n = min(512, len(p) - i)
        np.take(x, p[i : i + n], axis=0, out=a[:n], mode="clip")
        np.take(y, q[i : i + n], axis=0, out=b[:n], mode="clip")
        np.subtract(a[:n], b[:n], out=a[:n])
        np.einsum("ij,ij->i", a[:n], a[:n], out=found[i : i + n])
    return found


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a flat mask with few true values is true; eight values are looked at in one."""
    if len(mask) % 8:
        return np.flatnonzero(mask)
    some = np.flatnonzero(mask.view(np.uint64))
    p, q = np.nonzero(mask.reshape(-1, 8)[some])
    return some[p] * 8 + q


def _between(x: _Side, y: _Side, frame: _Frame, low: float, high: float, block: int) -> Iterator[tuple[np.ndarray, slice, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: a mask of the pairs that are surely below ``low``, the block's rows of both sides, and rows and squared
    distances of the pairs that may lie from ``low`` to ``high``. Pairs without a distance (NaN) are in neither.

    Pairs that single precision leaves open are taken one by one where they are few, else by a product in double precision.
    """
    same, area = x is y, frame.scale * frame.scale
    one, two = _single(x.left()), _single(y.right())
    room = np.empty(block * block, dtype=np.float32), np.empty(block * block, dtype=bool), np.empty(block * block, dtype=bool)
    for i in range(0, len(one), block):
        for j in range(i if same else 0, len(two), block):
            a, b = slice(i, min(i + block, len(one))), slice(j, min(j + block, len(two)))
            shape = a.stop - i, b.stop - j
            d, sure, maybe = (r[: shape[0] * shape[1]].reshape(shape) for r in room)
            np.dot(one[a], two[b].T, out=d)
            if same and i == j:
                d[np.tril_indices(len(d))] = np.inf
            error = _error(x.z.shape[1], x.length[a], y.length[b])
            np.less(d, np.float32(low * area - error), out=sure)
            np.less_equal(d, np.float32(high * area + error), out=maybe)
            maybe ^= sure
            if np.count_nonzero(maybe) <= AGAIN * maybe.size:
                p, q = np.divmod(_places(maybe.reshape(-1)), shape[1])
                found = _apart(x.v, i + p, y.v, j + q)
            else:
                p, q = np.nonzero(maybe)
                found = squared(x.z[a], y.z[b])[p, q] / area
            yield sure, a, b, i + p, j + q, found


def _ordered(side: pa.Table, frame: _Frame) -> tuple[_Side, np.ndarray]:
    """Different vectors by length, so that those of a block are alike in it, and how many rows of each role have them."""
    v = _matrix(side, "v")
    order = np.argsort(_Side(v, frame).length, kind="stable")
    return _Side(v[order], frame), np.column_stack([side[n].to_numpy() for n in "rc"]).astype(np.float64)[order]


def _both(left: pa.Table, right: pa.Table, frame: _Frame) -> tuple[tuple[_Side, np.ndarray], tuple[_Side, np.ndarray]]:
    x = _ordered(left, frame)
    return x, (x if left is right else _ordered(right, frame))


# ---------------------------------------------------------------- median of all distances


class _Level:
    """A range of distances in slots, of which some are still open."""

    def __init__(self, low: float, high: float):
        self.low, self.high, self.scale = low, high, SLOTS / (high - low)
        self.first, self.last = 0, SLOTS - 1

    def slots(self, d: np.ndarray) -> np.ndarray:
        return np.clip(((d - self.low) * self.scale).astype(np.int64), 0, SLOTS - 1)

    def edges(self) -> tuple[float, float]:
        return self.low + self.first / self.scale, self.low + (self.last + 1) / self.scale


def _open(d: np.ndarray, levels: list[_Level]) -> np.ndarray:
    """Which of the distances are inside the open slots of all levels."""
    inside = np.ones(len(d), dtype=bool)
    for level in levels:
        s = level.slots(d)
        inside &= (d >= level.low) & (d < level.high) & (s >= level.first) & (s <= level.last)
    return inside


def _sampled(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Distances, rounded down to 14 bits and in order, their weights, and how many pairs of weight 1 they are worth.

    A row meets ``MET`` others of its batch to either side. As all rows meet equally many, the share of pairs below a
    distance deviates little, whatever the rows are.
    """

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = _matrix(pa.Table.from_batches([batch]), "v"), batch["w"].to_numpy().astype(np.float64)
            order = np.random.default_rng(len(v)).permutation(len(v))
            v, w = v[order], w[order]
            slots, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
            for s in range(1, min(MET, (len(v) - 1) // 2 or len(v) - 1) + 1):
                other = np.roll(np.arange(len(v)), s)
                d, pair = _apart(v, np.arange(len(v)), v, other), w * w[other]
                slots.append(d.view(np.int64)[d < np.inf] >> 38)
                weights.append(pair[d < np.inf])
            found, at = np.unique(np.concatenate(slots), return_inverse=True)
            every = np.concatenate(weights)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.bincount(at, every, len(found)), pa.float64()), pa.array(np.bincount(at, every * every, len(found)), pa.float64())], ["slot", "n", "n2"])

    slots = vectors.select("v", (F.col("r") + F.col("c")).alias("w")).mapInArrow(met, "slot long, n double, n2 double").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("n2").alias("n2")).orderBy("slot").toArrow()
    n = slots["n"].to_numpy()
    return (slots["slot"].to_numpy().astype(np.int64) << 38).view(np.float64), n, float(n.sum() ** 2 / max(slots["n2"].to_numpy().sum(), 1e-300))


def median_distance(rows: DataFrame, tile: int = TILE, ordered: int = ORDERED) -> float | None:
    """The exact median of the squared distances of all pairs; None without a pair."""
    return median_of_distinct(distinct(rows), tile, ordered)


def median_of_distinct(vectors: DataFrame, tile: int = TILE, ordered: int = ORDERED) -> float | None:
    """The exact median of the squared distances of all pairs of rows that ``distinct`` has put together.

    A sample brackets it. A pass counts the pairs below the bracket and those inside by slot, at most ``SLOTS`` counts
    come to the driver, and the slots that hold the middle stay open for the next pass, until few enough distances are in
    them to be put in order by value. Where the counts show that the middle lies outside of the bracket, the pass is
    repeated with the range on that side.
    """
    n, total, copies = vectors.agg(F.count("*"), F.sum(F.expr("r + c")), F.sum(F.expr("(r + c) * (r + c - 1) div 2"))).first()
    if not total or total < 2:
        return None
    pairs = total * (total - 1) // 2
    ranks = (pairs - 1) // 2, pairs // 2
    if ranks[1] < copies:
        return 0.0
    frame = _frame(vectors)
    if frame is None:
        return float("nan")
    groups, block = _groups(n, tile), min(tile, BLOCK)
    # lengths in the frame are at most 1
    end = 4.000001 / frame.scale**2
    low, high = 0.0, end
    values, weights, worth = _sampled(vectors)
    if len(values):
        share = np.cumsum(weights) / weights.sum()
        slack = REACH / 2 / math.sqrt(worth)
        at = [int(np.searchsorted(share, (r - copies) / max(pairs - copies, 1) + side)) for r, side in zip(ranks, (-slack, slack))]
        # a step further and not evenly, so that a value many pairs share is at no edge
        low = values[at[0]] * (1 - 1.1e-6) if at[0] > 0 else 0.0
        high = min(end, values[at[1] + 1] * (1 + 1.7e-6)) if at[1] + 1 < len(values) else end
        low, high = (low, high) if low < high else (0.0, end)
    below, levels = 0, []
    for _ in range(12):
        level = _Level(low, high)

        def counted(left: pa.Table, right: pa.Table, done=tuple(levels), level=level) -> pa.Table:
            (x, w), (y, u) = _both(left, right, frame)
            w, u = w.sum(1), u.sum(1)
            plain = bool((w == 1).all() and (u == 1).all())
            counts, many, under = np.zeros(SLOTS), np.zeros(SLOTS, dtype=np.int64), 0.0
            for sure, a, b, p, q, d in _between(x, y, frame, level.low, level.high, block):
                pair = w[p] * u[q]
                if not done:
                    under += np.count_nonzero(sure) if plain else float(w[a] @ (sure @ u[b]))
                    under += float(pair[d < level.low].sum())
                keep = _open(d, [*done, level])
                slots = level.slots(d[keep])
                np.add.at(counts, slots, pair[keep])
                np.add.at(many, slots, 1)
            slots = np.flatnonzero(many)
            n, m = np.concatenate([[under], counts[slots]]).round().astype(np.int64), np.concatenate([[0], many[slots]])
            return pa.table({"slot": pa.array(np.concatenate([[-1], slots]), pa.int32()), "n": pa.array(n, pa.int64()), "m": pa.array(m, pa.int64())})

        found = _grouped(vectors, groups, ("v",), counted, "slot int, n long, m long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()
        many, counts = {r.slot: r.m for r in found}, {r.slot: r.n for r in found}
        under = counts.pop(-1, 0)
        if not levels:
            below = copies + under
            beyond = below + sum(counts.values())
            # copies come before all others, so a rank among them is in any range
            inner = [r < copies or below <= r < beyond for r in ranks]
            if ranks[1] >= beyond and high == end:
                return float("nan")
            if not all(inner):
                left, right = copies <= ranks[0] < below or copies <= ranks[1] < below, ranks[1] >= beyond
                low, high = 0.0 if left else low if any(inner) else high, end if right else high if any(inner) else low
                continue
        seen, inside, start = below, 0, None
        for slot in sorted(counts):
            if start is None and seen + counts[slot] > max(ranks[0], below):
                start, below = slot, seen
            if start is not None:
                inside += many[slot]
            seen += counts[slot]
            if start is not None and seen > ranks[1]:
                level.first, level.last = start, slot
                break
        levels.append(level)
        low, high = level.edges()
        if inside <= ordered or not high > low * (1 + 1e-12):
            break

    def left(one: pa.Table, two: pa.Table) -> pa.Table:
        (x, w), (y, u) = _both(one, two, frame)
        w, u = w.sum(1), u.sum(1)
        found, held = [pa.table({"d": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})], 0
        for *_, p, q, d in _between(x, y, frame, low, high, block):
            keep = _open(d, levels)
            if keep.any():
                found.append(pa.table({"d": d[keep], "n": (w[p] * u[q])[keep].astype(np.int64)}))
                held += len(found[-1])
            if held > 1 << 20:
                found, held = [_summed(found, "d")], 0
        return _summed(found, "d")

    values = _grouped(vectors, groups, ("v",), left, "d double, n long").groupBy("d").agg(F.sum("n").alias("n"))
    placed = running_sum(values, (), ("d",), F.col("n")).withColumn("_end", F.col("running") + below)
    at = lambda r: F.lit(0.0) if r < copies else F.coalesce(F.min(F.when(F.col("_end") > r, F.col("d"))), F.max("d"))
    a, b = placed.agg(at(ranks[0]), at(ranks[1])).first()
    return (a + b) / 2


def kernel_sums(rows: DataFrame, bandwidth: float, tile: int = TILE) -> DataFrame:
    """(pair: RR, CC or CR; k, n): sums of an RBF kernel over ordered pairs of rows, each with itself among them."""
    return kernel_of_distinct(distinct(rows), bandwidth, tile)


def kernel_of_distinct(vectors: DataFrame, bandwidth: float, tile: int = TILE) -> DataFrame:
    """``kernel_sums`` of rows that ``distinct`` has put together."""
    n, frame, block = vectors.count(), _frame(vectors), min(tile, BLOCK)
    frame = frame or _Frame(np.zeros(len((vectors.select("v").first() or [[]])[0])), 1.0)
    factor = -1 / (2 * bandwidth * frame.scale**2)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        # a column of weights for each role, so that one product sums a block by roles
        (x, w), (y, u) = _both(left, right, frame)
        one, two = x.left(factor), y.right()
        k, n, room = np.zeros((2, 2)), np.zeros((2, 2)), np.empty(block * block)
        for i in range(0, len(one), block):
            for j in range(i if x is y else 0, len(two), block):
                a, b = slice(i, min(i + block, len(one))), slice(j, min(j + block, len(two)))
                part = room[: (a.stop - i) * (b.stop - j)].reshape(a.stop - i, b.stop - j)
                np.dot(one[a], two[b].T, out=part)
                np.exp(part, out=part)
                once = x is y and i == j
                if once:
                    np.fill_diagonal(part, np.where(np.isfinite(x.square[a]), 1.0, np.nan))
                s, m = w[a].T @ (part @ u[b]), np.outer(w[a].sum(0), u[b].sum(0))
                # a block beside the diagonal stands for its mirror image, too
                k, n = k + s if once else k + s + s.T, n + m if once else n + m + m.T
        at = [(name, c) for name, c in (("RR", (0, 0)), ("CC", (1, 1)), ("CR", (0, 1))) if n[c]]
        return pa.table({"pair": pa.array([name for name, _ in at], pa.string()), "k": pa.array([k[c] for _, c in at], pa.float64()), "n": pa.array([int(n[c]) for _, c in at], pa.int64())})

    return _grouped(vectors, _groups(n, tile), ("v",), sums, "pair string, k double, n long").groupBy("pair").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))


# ---------------------------------------------------------------- nearest reference rows


def _compare(asked: DataFrame, members: DataFrame, frame: _Frame, tile: int, allowed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(role, id, d, compared): for each asked row of a region the nearest member of the region's cells that are ``allowed``.

    ``asked`` is (region, role, id, v, cell, bound), ``members`` (region, cell, id, v); ``allowed`` takes vectors, cells and
    bounds of asked rows and gives, for each row and cell, whether to look there. A reference row leaves itself out.
    Members of a block whose distance in single precision comes near the least one known are taken again, exactly.
    """
    parts = lambda side: {r["region"]: math.ceil(r["count"] / PART) for r in side.groupBy("region").count().collect()}
    n_asked, n_members = parts(asked), parts(members)  # at most PIVOTS entries each
    regions = sorted(set(n_asked) & set(n_members))
    if not regions:
        return asked.select("role", "id", F.lit(None).cast("double").alias("d"), F.lit(0).cast("long").alias("compared")).limit(0)
    of = lambda n: F.element_at(F.create_map(*(F.lit(x) for c in regions for x in (c, n[c]))), F.col("region"))
    part = lambda n: F.pmod(F.xxhash64("id"), of(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    left = asked.where(F.col("region").isin(regions)).select("region", "role", "id", "v", "cell", "bound", part(n_asked).alias("p")).select("*", every(n_members).alias("q"))
    right = members.where(F.col("region").isin(regions)).select("region", F.col("cell").alias("cell2"), F.col("id").alias("id2"), F.col("v").alias("v2"), part(n_members).alias("q"))
    right = right.select("*", every(n_asked).alias("p"))

    def run(_, a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"role": pa.array([], pa.string()), "id": pa.array([], pa.string()), "d": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})
        # rows of a block are alike in length, so that the bound on its error is close
        a = a.take(np.argsort(_Side(_matrix(a, "v"), frame).length, kind="stable"))
        b = b.take(np.lexsort((_Side(_matrix(b, "v2"), frame).length, b["cell2"].to_numpy())))
        x, y, cells, area = _Side(_matrix(a, "v"), frame), _Side(_matrix(b, "v2"), frame), b["cell2"].to_numpy(), frame.scale**2
        one, two = _single(x.left()), _single(y.right())
        place = {name: k for k, name in enumerate(b["id2"].to_pylist())}
        own = np.array([place.get(name, -1) if role == ROLES[0] else -1 for role, name in zip(a["role"].to_pylist(), a["id"].to_pylist())])
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])).tolist()
        block = min(tile, BLOCK)
        blocks = [(cells[lo], at, min(at + block, hi)) for lo, hi in zip(starts, [*starts[1:], len(cells)]) for at in range(lo, hi, block)]
        bound = a["bound"].to_numpy(zero_copy_only=False).astype(np.float64)
        found, compared = np.where(np.isfinite(x.length), np.inf, np.nan), np.zeros(len(a), dtype=np.int64)
        known = np.where(np.isnan(bound), np.inf, bound * bound)
        for i in range(0, len(a), block):
            look = allowed(x.v[i : i + block], a["cell"].to_numpy()[i : i + block], bound[i : i + block])
            for cell, lo, hi in blocks:
                rows = i + np.flatnonzero(look[:, cell])
                if not len(rows):
                    continue
                d = one[rows] @ two[lo:hi].T
                compared[rows] += hi - lo
                mine = np.flatnonzero((own[rows] >= lo) & (own[rows] < hi))
                d[mine, own[rows[mine]] - lo] = np.inf
                error, least = _error(x.z.shape[1], x.length[rows], y.length[lo:hi]), d.min(1).astype(np.float64)
                near = np.flatnonzero((least <= known[rows] * area + error) & (least < np.inf))
                if not len(near):
                    continue
                p, q = np.nonzero(d[near] <= (np.minimum(known[rows[near]] * area, least[near] + error) + error)[:, None])
                if len(p) > max(2 * len(near), AGAIN * d.size):
                    again = squared(x.z[rows[near]], y.z[lo:hi])
                    again[np.isinf(d[near])] = np.inf
                    p, q = np.arange(len(near)), again.argmin(1)
                p = rows[near[p]]
                exact = _apart(x.v, p, y.v, lo + q)
                np.minimum.at(found, p, exact)
                np.minimum.at(known, p, exact)
        return pa.table({"role": a["role"], "id": a["id"], "d": pa.array(np.sqrt(found)), "compared": pa.array(compared)})

    at = ("region", "p", "q")
    # a partition holds few parts of regions, so that the last task doesn't hold many
    deal = lambda side: side.repartition(2 * sum(n_asked[r] * n_members[r] for r in regions), *at).groupBy(*at)
    found = deal(left).cogroup(deal(right)).applyInArrow(run, "role string, id string, d double, compared long")
    return found.groupBy("role", "id").agg(F.min("d").alias("d"), F.sum("compared").alias("compared"))


def nearest_reference(rows: DataFrame, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """(role, id, d, compared): exact distance of every row to its nearest reference row (another one, for a reference row).

    A few reference rows, the first by hash, are pivots of a bounded number; each row belongs to the cell of its
    nearest pivot. Its own cell gives an upper bound; of the others, only those are visited that the triangle inequality
    lets hold a nearer row: where the distance to the pivot less the cell's radius is below the bound. A row is sent once
    to each of ``REGIONS`` runs of cells that holds one to visit, so at most to so many places. Cells of any size are
    compared in blocks. ``compared`` counts the distances taken.
    """
    # vectors without a finite length are nobody's nearest
    finite = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < float("inf")
    first = rows.where((F.col("role") == ROLES[0]) & finite).orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").toArrow()
    if not len(first):
        return rows.select("role", "id", F.lit(None).cast("double").alias("d"), F.lit(0).cast("long").alias("compared"))
    centres = _matrix(first, "v")

    def assigned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.sqrt(squared(_matrix(pa.Table.from_batches([batch]), "v"), centres)) if batch.num_rows else np.zeros((0, len(centres)))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "r"])

    placed = cut(rows.mapInArrow(assigned, "role string, id string, v array<double>, cell int, r double"), "nearest-cells")
    members, frame = placed.where((F.col("role") == ROLES[0]) & finite), _frame(placed)
    radius, held = np.full(len(centres), -np.inf), np.zeros(len(centres), dtype=np.int64)
    for row in members.groupBy("cell").agg(F.max("r").alias("r"), F.count("*").alias("n")).collect():
        radius[row.cell], held[row.cell] = row.r, row.n
    here = F.col("cell").alias("region")
    at_home = lambda x, cell, bound: cell[:, None] == np.arange(len(centres))[None, :]
    near = cut(_compare(placed.select(here, "role", "id", "v", "cell", F.lit(None).cast("double").alias("bound")), members.select(here, "cell", "id", "v"), frame, tile, at_home), "nearest-own")
    # cells behind the last row that is held, pivots that are copies among them, are of the last region
    region = np.minimum((np.cumsum(held) - held) * REGIONS // max(1, int(held.sum())), REGIONS - 1)

    def visited(x: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> np.ndarray:
        may = (np.sqrt(squared(x, centres)) - radius[None, :]) * (1 - 1e-9) - 1e-9 < np.where(np.isnan(bound), np.inf, bound)[:, None]
        may &= ~np.isneginf(radius)[None, :]
        may[np.arange(len(x)), cell] = False
        return may

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a slice at a time, for each row leaves up to REGIONS times
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                may = visited(_matrix(pa.Table.from_batches([some]), "v"), some.column(3).to_numpy(), some.column(4).to_numpy(zero_copy_only=False).astype(np.float64))
                into = np.zeros((len(may), REGIONS), dtype=bool)
                for c in range(len(centres)):
                    into[:, region[c]] |= may[:, c]
                row, to = np.nonzero(into)
                take = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *take.columns], ["region", "role", "id", "v", "cell", "bound"])

    bounded = placed.join(near.select("role", "id", F.col("d").alias("bound")), ["role", "id"], "left").select("role", "id", "v", "cell", "bound")
    sent = cut(bounded.mapInArrow(visits, "region int, role string, id string, v array<double>, cell int, bound double"), "nearest-visits")
    regions = F.element_at(F.array(*map(F.lit, region.tolist())), F.col("cell") + 1).cast("int")
    further = _compare(sent, members.select(regions.alias("region"), "cell", "id", "v"), frame, tile, visited)
    least = near.union(further).groupBy("role", "id").agg(F.min("d").alias("d"), F.sum("compared").alias("compared"))
    return least.withColumn("d", F.when(F.col("d") < float("inf"), F.col("d")))


def support(rows: DataFrame, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """One row: base and observed median distances, mean and 95th percentile of the current ones, and the share of pairs compared."""
    near = cut(nearest_reference(rows, tile, pivots), "nearest")
    by_role = with_quantiles(near, ("role",), F.col("d"), {"median": 0.5, "q95": 0.95}, F.avg("d").alias("mean"), F.count("*").alias("n"), F.sum("compared").alias("compared"))
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    share = F.sum("compared") / (F.sum("n").cast("double") * pick(ROLES[0], "n"))
    return by_role.agg(pick(ROLES[0], "median").alias("base"), pick(ROLES[1], "median").alias("observed"), pick(ROLES[1], "mean").alias("mean"), pick(ROLES[1], "q95").alias("q95"), share.alias("compared"))
