"""Exact set-similarity join on word shingles by a grouped prefix join.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is at least 0.8. Under one order of
all shingles, linked sets share one among their first n - ceil(0.8 n) + 1. The order puts frequent shingles last
(by how frequent, then by fingerprint), so prefixes are made of rare ones. Any order gives the same links.

Documents with equal sets are one class. Classes with identical prefixes and size are one group; groups that share a
prefix shingle and pass the size and position filters are candidates; candidates are expanded to their classes,
filtered by the parity bitmaps of their sets, and verified on the sets themselves.

A long list (of a frequent shingle, or of more than ``LONGEST_LIST`` groups) is never collected: its members are first
compared with one of them, the most central. Classes of lists that still hold several components are then joined once
more among themselves, under an order made from exact counts of all their shingles, rarest first. That order puts a
class's own edits before what its list shares, so few prefixes still meet: again a list's most central member goes
first, and only members that stay in different components, and whose places and sizes allow a link, are compared with
each other. So copies by the thousand cost a few comparisons each, and no link between different texts is lost for the
components.

Fingerprints of words and shingles have 64 bits, classes 128; they are chains of mixing steps over all bytes, so no
family of texts collides by construction. What is broadcast: at most ``MOST_FREQUENT`` frequent shingles and a bloom
filter of ``BLOOM_BITS`` bits; when there are more, lists are longer and more sets are shipped, with the same result.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of one to four words is one
shingle; repeated rows each get a row; rows that share an id share its component; null ids are a document like any
other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.components import connected
from proofline.llm.textcols import lowered, mix, range_prints, rows_of, slices, word_spans
from proofline.session import cut, drop

WORDS = 5
#: A shingle in at least so many documents is frequent; of these the most frequent are put last in the order.
FREQUENT, MOST_FREQUENT = 48, 500_000
#: Prefixes seldom hold fingerprints above this share of their range: only those below are counted.
COUNTED = np.uint64(int(0.26 * (1 << 64)))
LONGEST_LIST = 64
#: Rows of one list that a task holds before it passes the list on.
LIST_PART = 1 << 20
#: A long list's members are dealt to so many tasks when they meet their list's centre.
SALTS = 16
BITMAP = 8
BLOOM_BITS = 1 << 25

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each document, ascending: (flat, boundaries)."""
    low = lowered(data)
    starts, ends, edges = word_spans(low, at)
    words, doc = range_prints(low, starts, ends), rows_of(edges)
    n = np.diff(edges)
    with np.errstate(over="ignore"):
        if len(words) >= WORDS:
            full = sum((words[k : len(words) - WORDS + 1 + k] * _ODD[k] for k in range(1, WORDS)), words[: len(words) - WORDS + 1] * _ODD[0])
            whole = doc[: len(full)] == doc[WORDS - 1 :]
            prints, owner = mix(full[whole]), doc[: len(full)][whole]
        else:
            prints, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        few = np.flatnonzero((n > 0) & (n < WORDS))
        if len(few):
            short = np.full(len(few), 0x5851F42D4C957F2D, dtype=np.uint64)
            for k in range(WORDS - 1):
                has = n[few] > k
                short[has] = mix(short[has] ^ words[edges[few[has]] + k] * _ODD[k])
            prints, owner = np.concatenate([prints, short]), np.concatenate([owner, few])
    order = np.lexsort((prints, owner))
    prints, owner = prints[order], owner[order]
    once = np.ones(len(prints), dtype=bool)
    once[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
    prints, owner = prints[once], owner[once]
    return prints, np.searchsorted(owner, np.arange(len(at)))


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums, modulo 2**64, of consecutive groups, empty ones included."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[edges[1:]] - total[edges[:-1]]


def class_ids(prints: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """128-bit names of sets, as rows of two words."""
    n = np.diff(edges).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.column_stack([mix(_sums(mix(prints ^ seed), edges) + n * seed) for seed in (_ODD[1], _ODD[4])])


def _binary(ids: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(ids.astype(">u8"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, at in slices(batch.column(0)):
            prints, _ = shingle_sets(data, at)
            terms, n = np.unique(prints[prints < COUNTED], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["h", "n"])


def frequent_shingles(docs: DataFrame, at_least: int = FREQUENT, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, ascending, of frequent shingles and how often each occurs; at most ``most`` of them."""
    counts = docs.select("text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)
    found = counts.orderBy(F.col("n").desc(), "h").limit(most).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


#: One table holds both kinds of rows: a document with its class and group, and a group's prefix shingles.
_ROWS = "key long, cls binary, n int, g long, bits array<long>, h long, pos int, frequent boolean"
_FIELDS = ["key", "cls", "n", "g", "bits", "h", "pos", "frequent"]


def _bitmaps(prints: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Parity bitmaps of sets: each shingle flips one bit."""
    bit = (prints >> np.uint64(20)).astype(np.int64) % (64 * BITMAP)
    flips = np.bincount(owner * (64 * BITMAP) + bit, minlength=rows * 64 * BITMAP).reshape(rows, 64 * BITMAP) & 1
    return np.packbits(flips.astype(np.uint8), axis=1).view(np.int64) if rows else np.zeros((0, BITMAP), dtype=np.int64)


def _leading(prints: np.ndarray, edges: np.ndarray, hot: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """The prefixes of sets under the order (level, fingerprint); shingles that are not hot have level 0.

    Returns (fingerprint, set, place in the set's order, whether hot) of each prefix shingle.
    """
    n, owner = np.diff(edges), rows_of(edges)
    rank, many = np.zeros(len(prints), dtype=np.int64), np.zeros(len(prints), dtype=bool)
    if len(hot) and len(prints):
        near = np.minimum(np.searchsorted(hot, prints), len(hot) - 1)
        many = hot[near] == prints
        rank[many] = level[near[many]]
    order = np.lexsort((prints, rank, owner))
    place = np.arange(len(prints)) - np.repeat(edges[:-1], n)
    taken = place < np.repeat(n - (4 * n + 4) // 5 + 1, n)
    return prints[order][taken], owner[taken], place[taken], many[order][taken]


def _group_rows(h: np.ndarray, g: np.ndarray, n: np.ndarray, pos: np.ndarray, many: np.ndarray, longest: int) -> pa.RecordBatch:
    """Rows of prefix shingles. One that more than ``longest`` groups here hold is long for certain: its rows are marked
    like those of frequent ones, and one row with n = 0 tells the other tasks."""
    _, back, times = np.unique(h, return_inverse=True, return_counts=True)
    crowded = (times[back] > longest) & ~many
    tell = np.unique(h[crowded])
    k = len(tell)
    h, g = np.concatenate([h, tell]).view(np.int64), np.concatenate([g, np.zeros(k, dtype=np.int64)])
    n, pos = np.concatenate([n, np.zeros(k, dtype=np.int64)]), np.concatenate([pos, np.zeros(k, dtype=np.int64)])
    long = np.concatenate([many | crowded, np.zeros(k, dtype=bool)])
    m = len(h)
    none = lambda kind: pa.nulls(m, kind)
    columns = [none(pa.int64()), none(pa.binary()), pa.array(n, pa.int32()), pa.array(g), none(pa.list_(pa.int64())), pa.array(h), pa.array(pos, pa.int32()), pa.array(long)]
    return pa.RecordBatch.from_arrays(columns, _FIELDS)


def _prefixes(batches: Iterable[pa.RecordBatch], hot: np.ndarray, often: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    level = np.array([int(x).bit_length() for x in often], dtype=np.int64)
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for first, last, data, at in slices(batch.column(1)):
            prints, edges = shingle_sets(data, at)
            n, rows = np.diff(edges), len(edges) - 1
            h, doc, place, many = _leading(prints, edges, hot, level)
            kept = np.searchsorted(doc, np.arange(rows + 1))
            with np.errstate(over="ignore"):
                g = mix(_sums(mix(h ^ _ODD[2]), kept) + n.astype(np.uint64) * _ODD[3]).view(np.int64)
            none = lambda kind, rows=rows: pa.nulls(rows, kind)
            maps = _bitmaps(prints, rows_of(edges), rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BITMAP, pa.int32()), pa.array(maps.ravel()))
            columns = [batch.column(0).slice(first, last - first), _binary(class_ids(prints, edges)), pa.array(n, pa.int32()), pa.array(g), lists, none(pa.int64()), none(pa.int32()), none(pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, _FIELDS)
            # a group's prefix once per slice
            _, once = np.unique(g, return_index=True)
            own = np.zeros(rows, dtype=bool)
            own[once] = True
            use = own[doc]
            doc = doc[use]
            held.append((h[use], g[doc], n[doc], place[use], many[use]))
            if sum(len(x[0]) for x in held) >= LIST_PART:
                yield _group_rows(*(np.concatenate(x) for x in zip(*held)), longest)
                held = []
    if held:
        yield _group_rows(*(np.concatenate(x) for x in zip(*held)), longest)


def _list_pairs(h: np.ndarray, g: np.ndarray, n: np.ndarray, pos: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of whole lists, and the rows of those that are long."""
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (n[1:] != n[:-1])
    h, g, n, pos = h[fresh], g[fresh], n[fresh], pos[fresh]
    if not len(h):
        return
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.concatenate([starts, [len(h)]]))
    told = np.logical_or.reduceat(n == 0, starts)
    long = np.repeat((size > longest) | told, size)
    yield from _passed(*(x[long] for x in (h, g, n, pos)))
    some = ~long & np.repeat(size > 1, size)
    h, g, n, pos = h[some], g[some], n[some], pos[some]
    for d in range(1, longest):
        if d >= len(h):
            break
        same = h[d:] == h[:-d]
        if not same.any():
            break
        x, y = n[:-d], n[d:]
        ok = same & (4 * np.maximum(x, y) <= 5 * np.minimum(x, y)) & (9 * np.minimum(x - pos[:-d], y - pos[d:]) >= 4 * (x + y))
        if ok.any():
            a, b = g[:-d][ok], g[d:][ok]
            each = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
            none = pa.nulls(len(each), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(each[:, 0]), pa.array(each[:, 1]), none.cast(pa.int32()), none.cast(pa.int32())], _PAIRS)


_PAIRS = ["h", "a", "b", "n", "pos"]


def _passed(h: np.ndarray, g: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of long lists; those that only tell that a list is long end here."""
    real = n > 0
    k = int(real.sum())
    if k:
        yield pa.RecordBatch.from_arrays([pa.array(h[real]), pa.array(g[real]), pa.nulls(k, pa.int64()), pa.array(n[real], pa.int32()), pa.array(pos[real], pa.int32())], _PAIRS)


def _short_lists(batches: Iterable[pa.RecordBatch], longest: int, part: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of lists that arrive sorted by shingle; lists beyond ``longest`` go on row by row.

    Rows out: (h, a, b, n, pos); b is null in rows of long lists. A list of more than ``part`` rows is passed on in
    parts: what follows of it goes the same way.
    """
    kept = [np.zeros(0, dtype=np.int64)] * 4
    passing = None
    for batch in batches:
        now = [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, k in enumerate(kept)]
        if passing is not None:
            more = int(np.searchsorted(now[0], passing, side="right"))
            yield from _passed(*(x[:more] for x in now))
            now = [x[more:] for x in now]
        kept = now
        if not len(now[0]):
            continue
        passing = None
        # the last list may go on in the next batch
        last = int(np.searchsorted(now[0], now[0][-1]))
        yield from _list_pairs(*(x[:last] for x in now), longest)
        kept = [x[last:] for x in now]
        if len(kept[0]) > part:
            passing = int(kept[0][0])
            yield from _passed(*kept)
            kept = [x[:0] for x in kept]
    yield from _list_pairs(*kept, longest)


def _bloom_places(ids: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [((ids[:, 0] + np.uint64(k) * ids[:, 1]) % np.uint64(BLOOM_BITS)).astype(np.int64) for k in range(3)]


def _sets_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(c, s): the shingles of each class of ``named`` (one column), ascending. Only those sets are shipped."""
    spark = docs.sparkSession
    (name,) = named.columns
    # BLOOM_BITS bounds the words, whatever the number of classes
    words = named.mapInArrow(_places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(table)

    def sets(batches):
        bloom = sent.value
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                prints, edges = shingle_sets(data, at)
                names = class_ids(prints, edges)
                hit = np.diff(edges) > 0
                for place in _bloom_places(names):
                    hit &= (bloom[place // 64] >> (place % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
                rows = np.flatnonzero(hit)
                if len(rows):
                    _, once = np.unique(names[rows], axis=0, return_index=True)
                    rows = rows[once]
                    parts = [prints[edges[r] : edges[r + 1]] for r in rows]
                    sizes = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                    lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([_binary(names[rows]), lists], ["c", "s"])

    shipped = docs.select("text").mapInArrow(sets, "c binary, s array<long>")
    return shipped.join(named.withColumnRenamed(name, "c"), "c", "left_semi").dropDuplicates(["c"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link."""
    both = pairs.join(sets.selectExpr("c AS a", "s AS sa"), "a").join(sets.selectExpr("c AS b", "s AS sb"), "b")
    return both.where("9 * size(array_intersect(sa, sb)) >= 4 * (size(sa) + size(sb))").select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link. Only sets that occur in a pair are shipped."""
    return _linked(pairs, _sets_of(docs, pairs.select("a").union(pairs.select("b")).distinct()))


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the bloom filter with the bits that classes set in them."""
    for batch in batches:
        ids = np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), dtype=">u8").reshape(-1, 2).astype(np.uint64)
        place = np.unique(np.concatenate(_bloom_places(ids)))
        word, start = np.unique(place // 64, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (place % 64).astype(np.uint64), start) if len(place) else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])


def _near(a: str, b: str) -> str:
    """SQL: the parity bitmaps don't rule a link out."""
    return f"9 * aggregate(zip_with({a}.bits, {b}.bits, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {a}.n + {b}.n"


_SIZES = "4 * greatest(a.n, b.n) <= 5 * least(a.n, b.n)"


def _told(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Members of long lists with what is known of their list: a list's members meet it in ``SALTS`` tasks."""
    spread = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return members.withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS))).join(spread, ["h", "_salt"]).drop("_salt")


def _stars(every: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's most central member with the others, by size and bitmap."""
    central = every.groupBy("h").agg(F.min(F.struct("pos", "cls")).alias("m"), F.count("*").alias("k")).where("k > 1")
    met = _told(every, central.select("h", F.col("m.cls").alias("centre"))).where("cls != centre")
    star = met.select(F.least("cls", "centre").alias("x"), F.greatest("cls", "centre").alias("y")).distinct()
    of = lambda side: classes.select(F.col("cls").alias(side), F.struct("n", "bits").alias(f"{side}s"))
    sized = star.join(of("x"), "x").join(of("y"), "y")
    sized = sized.where(_SIZES.replace("a.n", "xs.n").replace("b.n", "ys.n")).where(_near("xs", "ys"))
    return sized.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _apart(every: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of long lists with their component, and (h, main): the lists that hold several, with the largest one."""
    placed = every.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    tally = placed.groupBy("h", "component").agg(F.count("*").alias("k"))
    open_ = tally.groupBy("h").agg(F.max(F.struct("k", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    return placed, open_.select("h", F.col("m.component").alias("main"))


def _ranked(batches: Iterable[pa.RecordBatch], hot: np.ndarray, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Prefix rows (h, cls, n, pos, frequent) of sets (c, s) under an order by exact counts."""
    level = np.argsort(np.argsort(often, kind="stable"), kind="stable") + 1
    for batch in batches:
        sets = batch.column(1)
        edges = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        prints = sets.flatten().to_numpy().view(np.uint64)
        h, row, place, many = _leading(prints, edges.astype(np.int64), hot, level)
        columns = [pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(np.diff(edges)[row], pa.int32()), pa.array(place, pa.int32()), pa.array(many)]
        yield pa.RecordBatch.from_arrays(columns, ["h", "cls", "n", "pos", "frequent"])


#: Sizes are cut into bands of a ratio of 1 + 1 / BANDS.
BANDS = 32
_BAND = f"cast(floor(ln(%s) / ln(1 + 1D / {BANDS})) AS int)"


def _rest(docs: DataFrame, classes: DataFrame, open_: DataFrame, links: DataFrame, longest: int, most: int) -> DataFrame:
    """Links between the classes ``open_`` (cls), in lists where ``links`` leave several components.

    Of two linked sets under one order, the one that is no larger has its first common shingle among its first n/9, the
    other among the first n - ceil(0.8 n) + 1; a place also bounds the partner's size. So a row meets only rows of its
    shingle in bands of possible sizes.
    """
    spark = docs.sparkSession
    sets = cut(_sets_of(docs, open_), "ngram-open")
    counts = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > longest)
    found = counts.orderBy(F.col("n").desc(), "h").limit(most).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    hot = spark.sparkContext.broadcast((h[order], n[order]))
    rows = cut(sets.mapInArrow(lambda it: _ranked(it, *hot.value), "h long, cls binary, n int, pos int, frequent boolean"), "ngram-ranked")
    every = rows.where("frequent").drop("frequent")
    of = classes.select("cls", "n", "bits")
    stars = cut(_linked(_stars(every, of), sets), "ngram-stars")
    parts = connected(links.union(stars))
    placed, lists = _apart(every, parts)
    told = cut(_told(placed, lists).join(of.select("cls", "bits"), "cls"), "ngram-told")
    # the largest partner that a place allows, and whether a partner may be as large
    told = told.withColumn("largest", F.floor(F.least(F.expr("9 * (n - pos) / 4 - n"), F.expr("5 * n / 4"))).cast("int"))
    low = told.where("largest >= n").withColumn("band", F.expr(_BAND % "n"))
    high = told.withColumn("top", F.least("largest", "n")).where("5 * top >= 4 * n")
    bands = F.sequence(F.expr(_BAND % "4 * n / 5"), F.expr(_BAND % "top"))
    high = high.withColumn("band", F.explode(bands))
    joined = "a.h = b.h AND a.band = b.band AND a.component != b.component AND a.n <= b.top AND 5 * a.n >= 4 * b.n"
    fits = f"a.largest >= b.n AND {_near('a', 'b')}"
    one = low.where("component != main").alias("a").join(high.alias("b"), F.expr(f"{joined} AND {fits}"))
    two = low.where("component = main").alias("a").join(high.where("component != main").alias("b"), F.expr(f"{joined} AND {fits}"))
    named = ("least(a.cls, b.cls) AS a", "greatest(a.cls, b.cls) AS b")
    met = one.selectExpr(*named).union(two.selectExpr(*named))
    # lists of rare shingles are short: all their members meet
    rare = rows.where("NOT frequent").join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    short = rare.alias("a").join(rare.alias("b"), F.expr(f"a.h = b.h AND a.cls < b.cls AND a.component != b.component AND {_SIZES} AND 9 * least(a.n - a.pos, b.n - b.pos) >= 4 * (a.n + b.n)"))
    met = cut(met.union(short.selectExpr("a.cls AS a", "b.cls AS b")).distinct(), "ngram-rest")
    return stars.union(cut(_linked(met, sets), "ngram-links"))


def similar(
    docs: DataFrame, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT, most_frequent: int = MOST_FREQUENT, longest: int = LONGEST_LIST, part: int = LIST_PART
) -> DataFrame:
    """Per document of ``docs``: its key, ``n_shingles``, and ``component_id``, the smallest key reachable by links.

    ``frequent``, ``most_frequent``, ``longest`` and ``part`` set what counts as a long list and how it is passed on;
    the result does not depend on them.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(frequent_shingles(docs, frequent, most_frequent))
    rows = cut(docs.mapInArrow(lambda it: _prefixes(it, *hot.value, longest), _ROWS), "ngram-rows")
    members = cut(rows.where("h IS NULL").select("key", "cls", "n", "g", "bits"), "ngram-members")
    firsts = (F.first(c).alias(c) for c in ("n", "g", "bits"))
    classes = cut(members.where("n > 0").groupBy("cls").agg(F.min("key").alias("low"), *firsts), "ngram-classes")
    lists = rows.where("h IS NOT NULL").select("h", "g", "n", "pos", "frequent")
    rare = lists.where("NOT frequent").select("h", "g", "n", "pos").repartition("h").sortWithinPartitions("h", "g")
    found = cut(rare.mapInArrow(lambda it: _short_lists(it, longest, part), "h long, a long, b long, n int, pos int"), "ngram-lists")
    groups = found.where("b IS NOT NULL").select("a", "b").distinct()
    of = classes.select("g", "cls", "n", "bits")
    x, y = of.selectExpr("g AS a", "struct(cls, n, bits) AS x"), of.selectExpr("g AS b", "struct(cls, n, bits) AS y")
    expanded = groups.join(x, "a").join(y, "b").where(_near("x", "y")).selectExpr("least(x.cls, y.cls) AS a", "greatest(x.cls, y.cls) AS b")
    # long lists, at the level of classes; the classes of a group are a list too
    long = lists.where("frequent").select("h", "g", "pos").union(found.where("b IS NULL").select("h", F.col("a").alias("g"), "pos")).distinct()
    crowded = classes.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
    within = classes.join(crowded, "g").select((F.col("g").bitwiseXOR(F.lit(-1).cast("long"))).alias("h"), "cls", "n", F.lit(0).alias("pos"))
    every = cut(long.join(of, "g").select("h", "cls", "n", "pos").union(within), "ngram-long")
    drop(rows)
    tried = cut(expanded.union(_stars(every, classes)).distinct(), "ngram-pairs")
    links = cut(_verified(docs, tried), "ngram-links")
    parts = connected(links)
    placed, lists_left = _apart(every, parts)
    open_ = cut(_told(placed, lists_left).select("cls").distinct(), "ngram-apart")
    if open_.limit(1).count():
        parts = connected(links.union(_rest(docs, classes, open_, links, longest, most_frequent)))
    # rows that share a key are one document: its classes hang together by the smallest key of each component
    labels = classes.join(parts.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"), "low")
    least = labels.groupBy("component").agg(F.min("low").alias("component_id"))
    named = labels.join(least, "component").select("cls", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return members.join(named, "cls", "left").select(F.col("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents joined with themselves."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
