"""Spelling variants: words one code point apart, their likely forms and roots, by a trie of letter-group counts.

A word's vector counts its letters by group (code point modulo ``GROUPS``; most frequent groups first). One inserted,
deleted or replaced code point changes at most one count by +1 and one by -1, so a depth-first search down a trie of
the successive counts that may spend a surplus and a deficit of one finds every candidate; words at the leaves are then
compared. The first levels of the trie are Spark's: each word is sent to the prefixes within its budget (the deficit is
spent before the surplus, since every pair is met from its other side too), and each prefix is one subtree in one task.
Deeper prefixes are taken as the vocabulary grows (``depth``), and a subtree of more than ``SUBTREE`` words is dealt
over a grid, so that a task never holds more.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty string; repeated rows count again;
runs of any length are words; equal counts are ordered by the word; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.session import cut, drop

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of so many (document, word) pairs loses a code point.
DAMAGED = 199
LEAST_LENGTH, LEAST_N, FORM_RATIO = 6, 5, 5
#: Letter groups, that is levels of the trie.
GROUPS = 16
#: Words that one subtree should hold on average, as the words see it, and at most.
MEAN, SUBTREE = 6_000, 20_000
#: Words longer than this are compared one by one.
WIDE = 48
_BLOCK = 1 << 14


def damaged_words(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of letters, some of them damaged by the rule over crc32, with their occurrences."""
    run = F.translate("_run", UPPER, LOWER)
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("_run"))
    words = words.where(F.length("_run") >= LEAST_LENGTH).select("_id", run.alias("_run"))
    words = words.withColumn("_h", F.crc32(F.concat_ws(":", "_id", "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut_out = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    word = F.when(F.col("_h") % DAMAGED == 0, cut_out).otherwise(F.col("_run"))
    return words.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame, least: int = LEAST_N) -> DataFrame:
    """Words of at least ``least`` occurrences."""
    return damaged_words(docs).where(F.col("n") >= least)


def _counts(word: Column) -> Column:
    """Letters of a word by group, natively."""
    letters = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]
    inside = lambda g: "".join(c for c in letters if ord(c) % GROUPS == g)
    return F.array(*(F.length(word) - F.length(F.translate(word, inside(g), "")) for g in range(GROUPS)))


def _levels(words: DataFrame) -> list[int]:
    """Groups by their share of all letters, the largest first: they tell most words apart. One row is collected."""
    sums = words.select(_counts(F.col("word")).alias("_v")).agg(*(F.sum(F.col("_v")[g]).alias(str(g)) for g in range(GROUPS))).first()
    return sorted(range(GROUPS), key=lambda g: (-(sums[g] or 0), g))


def _depth(words: DataFrame, mean: int) -> int:
    """The fewest levels at which a word's subtree holds ``mean`` words on average; ``GROUPS`` rows are collected."""
    prefixes = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(GROUPS)), lambda d: F.slice("_v", 1, d))).alias("_prefix"))
    sizes = prefixes.groupBy("_prefix").count().groupBy(F.size("_prefix").alias("d")).agg((F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).alias("mean"))
    return min((r.d for r in sizes.collect() if r["mean"] <= mean), default=GROUPS)


def _steps(depth: int) -> list[tuple[list[int], int, int]]:
    """Changes of a prefix within the budget, with the deficit and the surplus they spend; a surplus follows a deficit."""
    plain = [0] * depth
    found = [(plain, 0, 0)]
    for i in range(depth):
        less = [*plain[:i], -1, *plain[i + 1 :]]
        found.append((less, 1, 0))
        found += [([*less[:j], 1, *less[j + 1 :]], 1, 1) for j in range(i + 1, depth)]
    return found


def near_pairs(words: DataFrame, mean: int = MEAN, subtree: int = SUBTREE) -> DataFrame:
    """(word, n, near, near_n) of words (word, n) that differ by one code point, each pair once."""
    order = _levels(words)
    vector = F.array(*(F.col("_all")[g] for g in order))
    words = words.select("word", "n", _counts(F.col("word")).alias("_all")).select("word", "n", vector.alias("_v"))
    depth = _depth(words, mean)
    key = lambda prefix: F.array_join(prefix, ",")
    members = words.select(key(F.slice("_v", 1, depth)).alias("_at"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    steps = F.array(*(F.struct(F.array(*map(F.lit, change)).alias("by"), F.lit(deficit).alias("_deficit"), F.lit(surplus).alias("_surplus")) for change, deficit, surplus in _steps(depth)))
    asked = words.withColumn("_step", F.explode(steps)).withColumn("_to", F.zip_with(F.slice("_v", 1, depth), "_step.by", lambda a, b: a + b))
    asked = asked.where(F.array_min("_to") >= 0).select(key(F.col("_to")).alias("_at"), "word", "n", "_step._deficit", "_step._surplus")
    # subtrees with more words than a task should hold become a grid of (members, questions)
    large = members.groupBy("_at").count().where(F.col("count") > subtree).select("_at", F.ceil(F.col("count") / subtree).cast("int").alias("_grid"))

    def dealt(side: DataFrame, word: str, own: str, other: str) -> DataFrame:
        grid = F.coalesce("_grid", F.lit(1))
        placed = side.join(large, "_at", "left").withColumn(own, F.pmod(F.xxhash64(word), grid).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), grid - 1))).drop("_grid")

    place = ("_at", "_member_part", "_asked_part")
    asked, members = dealt(asked, "word", "_asked_part", "_member_part"), dealt(members, "near", "_member_part", "_asked_part")

    def found(_, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        a, b = search(left["word"].to_pylist(), left["_deficit"].to_numpy(), left["_surplus"].to_numpy(), right["near"].to_pylist(), order, depth)
        one, two = left.take(pa.array(a)), right.take(pa.array(b))
        return pa.table([one["word"].combine_chunks(), one["n"].combine_chunks(), two["near"].combine_chunks(), two["near_n"].combine_chunks()], schema=schema)

    return asked.groupBy(*place).cogroup(members.groupBy(*place)).applyInArrow(found, "word string, n long, near string, near_n long")


# ---------------------------------------------------------------- one subtree


def vectors(words: list[str], order: list[int]) -> np.ndarray:
    """Letter-group counts, one row a word, in the order of the levels."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    cells = np.repeat(np.arange(len(words)), sizes) * GROUPS + points % GROUPS
    return np.bincount(cells, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)[:, order]


class Trie:
    """Successive counts of sorted vectors: on each level the children of a node by count, at the end ranges of words."""

    def __init__(self, counts: np.ndarray):
        n, levels = counts.shape
        self.sorted = np.lexsort(counts.T[::-1]) if levels else np.arange(n)
        counts = counts[self.sorted]
        self.width = int(counts.max(initial=0)) + 3
        self.edges: list[np.ndarray] = []
        node = np.zeros(n, dtype=np.int64)
        for level in range(levels):
            edge = node * self.width + counts[:, level] + 1
            new = np.concatenate([[True], edge[1:] != edge[:-1]])
            self.edges.append(edge[new])
            node = np.cumsum(new) - 1
        self.first = np.searchsorted(node, np.arange(node[-1] + 2)) if n else np.zeros(1, dtype=np.int64)

    def step(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes by a count: (which of the nodes have one, the children)."""
        known = (count >= 0) & (count < self.width - 1)
        edge = np.where(known, node * self.width + count + 1, -1)
        at = np.minimum(np.searchsorted(self.edges[level], edge), len(self.edges[level]) - 1)
        hit = np.flatnonzero(known & (self.edges[level][at] == edge))
        return hit, at[hit]


def leaves(trie: Trie, counts: np.ndarray, deficit: np.ndarray, surplus: np.ndarray) -> tuple[np.ndarray, ...]:
    """(question, leaf, deficit, surplus) that a search from the root reaches within the budget of one each."""
    asked, node = np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64)
    for level in range(counts.shape[1]):
        parts = []
        for change in (0, -1, 1):
            may = slice(None) if change == 0 else np.flatnonzero(deficit == 0) if change < 0 else np.flatnonzero((deficit == 1) & (surplus == 0))
            q = asked[may]
            hit, child = trie.step(level, node[may], counts[q, level] + change)
            parts.append((q[hit], child, deficit[may][hit] + (change < 0), surplus[may][hit] + (change > 0)))
        asked, node, deficit, surplus = map(np.concatenate, zip(*parts))
    return asked, node, deficit, surplus


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words up to ``WIDE``, one row a word: they are below 256 by the definition of a word."""
    wide = max(1, min(WIDE, max(map(len, words))))
    return np.array([w[:wide].encode("latin-1") for w in words], dtype=f"S{wide}").view(np.uint8).reshape(len(words), wide)


def one_apart(long: str, short: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(long) < len(short):
        long, short = short, long
    if len(long) - len(short) > 1 or long == short:
        return False
    i = next((k for k, (a, b) in enumerate(zip(long, short)) if a != b), len(short))
    return long[i + 1 :] == short[i + (len(long) == len(short)) :]


def search(asked: list[str], deficit: np.ndarray, surplus: np.ndarray, members: list[str], order: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (asked, member) of words one apart; pairs of equal vectors only with the asked word first in order."""
    trie = Trie(vectors(members, order)[:, depth:])
    theirs, their_size = _letters(members), np.fromiter(map(len, members), dtype=np.int64, count=len(members))
    out_a, out_b = [], []
    for start in range(0, len(asked), _BLOCK):
        part = asked[start : start + _BLOCK]
        mine, my_size = _letters(part), np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        q, leaf, spent, gained = leaves(trie, vectors(part, order)[:, depth:], deficit[start : start + _BLOCK].astype(np.int64), surplus[start : start + _BLOCK].astype(np.int64))
        same = (spent == 0) & (gained == 0)
        sizes = trie.first[leaf + 1] - trie.first[leaf]
        ends = np.cumsum(sizes)
        begun = 0
        while begun < len(q):  # so many leaves at once that their pairs stay few
            until = max(begun + 1, int(np.searchsorted(ends, (ends[begun - 1] if begun else 0) + 16 * _BLOCK, side="right")))
            some, some_sizes = slice(begun, until), sizes[begun:until]
            a = np.repeat(q[some], some_sizes)
            within = np.arange(some_sizes.sum()) - np.repeat(np.cumsum(some_sizes) - some_sizes, some_sizes)
            b = trie.sorted[np.repeat(trie.first[leaf[some]], some_sizes) + within]
            keep = _verified(part, members, mine, theirs, my_size, their_size, a, b, np.repeat(same[some], some_sizes))
            out_a.append(a[keep] + start)
            out_b.append(b[keep])
            begun = until
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _verified(part: list[str], members: list[str], mine: np.ndarray, theirs: np.ndarray, my_size: np.ndarray, their_size: np.ndarray, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which candidate pairs are one apart. The member is as long as the asked word or one shorter."""
    ok = np.zeros(len(a), dtype=bool)
    size, other = my_size[a], their_size[b]
    short = size <= WIDE
    wide = min(mine.shape[1], theirs.shape[1])
    level = np.flatnonzero(short & (size == other))
    differ = (mine[a[level], :wide] != theirs[b[level], :wide]).sum(axis=1)
    ok[level] = differ == 1
    less = np.flatnonzero(short & (size == other + 1))
    if len(less):
        rows, cols = mine[a[less]], theirs[b[less]]
        padded = np.zeros((len(less), rows.shape[1] - 1), dtype=np.uint8)
        padded[:, : min(cols.shape[1], padded.shape[1])] = cols[:, : padded.shape[1]]
        inside = np.arange(padded.shape[1]) < other[less][:, None]
        lead = np.logical_and.accumulate((rows[:, :-1] == padded) & inside, axis=1).sum(axis=1)
        trail = np.logical_and.accumulate(((rows[:, 1:] == padded) | ~inside)[:, ::-1], axis=1).sum(axis=1) - (~inside).sum(axis=1)
        ok[less] = lead + trail >= other[less]
    for i in np.flatnonzero(~short):
        ok[i] = one_apart(part[a[i]], members[b[i]])
    for i in np.flatnonzero(ok & same):
        ok[i] = part[a[i]] < members[b[i]]
    return ok


# ---------------------------------------------------------------- forms and roots


def variants(words: DataFrame, mean: int = MEAN, subtree: int = SUBTREE) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    pairs = cut(near_pairs(words, mean, subtree), "spelling-pairs")
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    likely = F.col("_best.less") * -1 >= FORM_RATIO * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(likely, F.col("_best.form")).alias("form"), F.when(likely, -F.col("_best.less")).alias("form_n")
    )
    forms = cut(forms, "spelling-forms")
    drop(pairs)
    # a form is FORM_RATIO times as frequent as its word, so chains are short; each round doubles what a root covers
    most = forms.agg(F.max("n").alias("n")).first().n or LEAST_N
    chain = max(1, int(math.log(most, FORM_RATIO)) + 1)
    roots = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(chain))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(cut(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")), "spelling-words"))


#: The crc32 table by its rule (polynomial EDB88320, reflected); near words by equal wildcards; roots by recursion.
SQL = r"""
WITH RECURSIVE bits AS (SELECT i::BIGINT AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) WHERE length(r) >= 6),
counted AS (SELECT id, run, count(*) AS k FROM runs GROUP BY ALL),
hexed AS (SELECT run, k, hex(encode(id || ':' || run)) AS x FROM counted),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + length(x), 2),
    lambda i: (16 * instr('123456789ABCDEF', x[i]) + instr('123456789ABCDEF', x[i + 1]))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM hexed, crc),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, 1 + length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'form': near}) AS b FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.less >= 5 * w.n THEN b.form END AS form, CASE WHEN -b.less >= 5 * w.n THEN -b.less END::BIGINT AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.form = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word AND c.form IS NULL
"""
