"""Phrase collocation mining: exact phrase counts by tries with hash containers, scored by their weakest cut.

Counting. A phrase is the chain of its words' ids (64-bit fingerprints in big-endian bytes, so byte order is trie
order). Each task counts into a ``HatTrie``: a shallow trie over word ids whose containers are hash tables of the
remaining ids; a full container bursts into one per next word. When a trie holds too many entries, its largest
subtrees leave as sorted runs, and runs meet in prefix partitions (language and the first ids of the phrase), where
their counts are added. Words are counted first, then hashes of pairs of frequent words, then hashes of triples of such
pairs, then the phrases all of whose parts may be frequent: a phrase is never more frequent than its parts. Tasks know what is frequent from bitmaps of a
fixed size; a collision there only lets a phrase be counted that is dropped by its own count. Two words of one id would
show by a second fingerprint in the table of words; then other ids are taken.

Scoring is joins over the phrases of at least ``LEAST`` occurrences; every part of one is in the same table. A phrase
inside a longer one of the same count is inside one that is a single word longer, too, so only those are compared.

Defined cases: null and empty texts have no words; a null language is ``und`` (and joins rows that say ``und``);
repeated rows count again; words and texts may be of any length; ties are ordered by count, then by the phrase's bytes;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.textcols import lowered, mix, range_prints, slices
from proofline.session import cut

#: Occurrences of a candidate, its words at most, and phrases reported for a language.
LEAST, LONGEST, TOP = 100, 5, 2000
NO_LANG = "und"
#: Bits of a bitmap: 8 MB, whatever the corpus; phrases of up to so many words are sieved by hash before they are counted.
BITS, SIEVED = 26, 3
#: Entries of a container that bursts, of a whole trie that spills, and levels of the shallow trie.
BURST, HELD, SHALLOW = 4096, 600_000, 3
SLICE = 4 << 20
#: Words that one task of the last pass reads, about 200 MB of text.
WORDS_A_TASK = 32_000_000
_SEEDS = 4

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


# ---------------------------------------------------------------- counting in a task


class HatTrie:
    """Counts of id chains (bytes, eight a word): hash containers under a shallow trie of word ids."""

    def __init__(self, burst: int = BURST, held: int = HELD, shallow: int = SHALLOW):
        self.burst, self.held, self.shallow = burst, held, shallow
        self.root: dict[bytes, _Node] = {}
        self.size = 0

    def add(self, chains: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted chains, one row each, with their counts. Chains of one first word reach their container together."""
        if not len(chains):
            return
        width = chains.shape[1] * 8
        raw, many = chains.astype(">u8").tobytes(), counts.tolist()
        new = np.flatnonzero(np.concatenate([[True], chains[1:, 0] != chains[:-1, 0]])).tolist()
        for a, b in zip(new, [*new[1:], len(chains)]):
            at = a * width
            first = raw[at : at + 8]
            node = self.root.get(first)
            if node is None:
                node = self.root[first] = _Node()
            self.size += node.add([raw[i * width + 8 : (i + 1) * width] for i in range(a, b)], many[a:b], 1, self)

    def runs(self, all_of_it: bool = False) -> Iterator[tuple[list[bytes], list[int]]]:
        """Whole subtrees as sorted runs: the largest until half the room is free, or everything in order."""
        if all_of_it:
            leaving = sorted(self.root)
        else:
            leaving, free = [], 0
            for first in sorted(self.root, key=lambda w: -self.root[w].size):
                leaving.append(first)
                free += self.root[first].size
                if free >= self.held // 2:
                    break
            leaving.sort()
        keys: list[bytes] = []
        values: list[int] = []
        for first in leaving:
            node = self.root.pop(first)
            self.size -= node.size
            for rest, n in node.items():
                keys.append(first + rest)
                values.append(n)
            if len(keys) >= 50_000:
                yield keys, values
                keys, values = [], []
        if keys:
            yield keys, values

    @property
    def full(self) -> bool:
        return self.size > self.held


class _Node:
    """A container (``table``: remaining ids -> count) or, once burst, one node for each next word."""

    __slots__ = ("table", "below", "size")

    def __init__(self):
        self.table: dict[bytes, int] | None = {}
        self.below: dict[bytes, _Node] = {}
        self.size = 0

    def add(self, rests: list[bytes], counts: list[int], depth: int, trie: HatTrie) -> int:
        before = self.size
        if self.table is not None:
            table = self.table
            for rest, n in zip(rests, counts):
                table[rest] = table.get(rest, 0) + n
            self.size = len(table)
            if self.size > trie.burst and depth < trie.shallow and any(len(r) > 8 for r in table):
                self.table = None
                self._spread(list(table), list(table.values()), depth, trie)
        else:
            self._spread(rests, counts, depth, trie)
        return self.size - before

    def _spread(self, rests: list[bytes], counts: list[int], depth: int, trie: HatTrie) -> None:
        groups: dict[bytes, tuple[list[bytes], list[int]]] = {}
        for rest, n in zip(rests, counts):
            group = groups.setdefault(rest[:8], ([], []))
            group[0].append(rest[8:])
            group[1].append(n)
        for word, (further, some) in groups.items():
            node = self.below.get(word)
            if node is None:
                node = self.below[word] = _Node()
            node.add(further, some, depth + 1, trie)
        self.size = sum(n.size for n in self.below.values())

    def items(self) -> Iterator[tuple[bytes, int]]:
        if self.table is not None:
            yield from sorted(self.table.items())
            return
        for word in sorted(self.below):
            for rest, n in self.below[word].items():
                yield word + rest, n


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice: (starts, ends, document of each, whether a word follows the one before within its piece)."""
    kind = _KIND[data]
    inside = kind == 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = at[:-1][at[1:] > at[:-1]]
    opens[full] = inside[full]
    last = at[1:][at[1:] > at[:-1]] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(at, starts, side="right") - 1
    piece = np.cumsum(kind == 2)[starts]
    follows = np.zeros(len(starts), dtype=bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    return starts, ends, doc, follows


def _bit(ids: np.ndarray, of_lang: np.ndarray) -> np.ndarray:
    """Place of an id in a bitmap; each language has its own places."""
    return mix(ids ^ of_lang) >> np.uint64(64 - BITS)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) ^ b)


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _lang_print(lang: str) -> np.uint64:
    raw = lang.encode()
    return range_prints(np.frombuffer(raw, dtype=np.uint8), np.zeros(1, dtype=np.int64), np.array([len(raw)]))[0]


def _by_lang(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Slices of texts of one language: (lang, bytes in lower case, offsets)."""
    for batch in batches:
        langs = batch.column(0)
        for lang in sorted(set(langs.to_pylist())):
            texts = batch.column(1).filter(pc.equal(langs, lang))
            for _, _, data, at in slices(texts, SLICE):
                yield lang, lowered(data), at


def _summed(chains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with counts."""
    order = np.lexsort(chains.T[::-1])
    rows = chains[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return rows[at], np.diff(np.append(at, len(rows)))


def count_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(lang, id, word, n, unlike) of all words, and for each language a row without id that counts all of them.

    ``unlike``: words of this id have different second fingerprints.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, at in _by_lang(batches):
            starts, ends, _, _ = words_of(data, at)
            ids, checks = range_prints(data, starts, ends, seed), _checks(data, starts, ends)
            found, first, n = np.unique(ids, return_index=True, return_counts=True)
            own = checks[first]
            if (odd := _unlike(ids, checks, found, own)) is not None:
                found, first, n, own = np.append(found, ids[odd]), np.append(first, odd), np.append(n, 0), np.append(own, checks[odd])
            words = [data[starts[i] : ends[i]].tobytes() for i in first.tolist()]
            columns = [[lang] * (len(words) + 1), [*found.astype(np.int64).tolist(), None], [*words, None], [*own.tolist(), 0], [*n.tolist(), len(ids)]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64()))], ["lang", "id", "word", "check", "n"])

    rows = _read(docs).mapInArrow(counted, "lang string, id long, word binary, check int, n long")
    return rows.groupBy("lang", "id").agg(F.sum("n").alias("n"), F.min("word").alias("word"), (F.min("check") != F.max("check")).alias("unlike"))


def _checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Second fingerprints of words, 31 bits."""
    return (range_prints(data, starts, ends, 1 << 40) >> np.uint64(33)).astype(np.int32)


def _unlike(ids: np.ndarray, checks: np.ndarray, found: np.ndarray, own: np.ndarray) -> int | None:
    """A word whose id another word has, if there is one; ``own``: the second fingerprints of the distinct ids ``found``."""
    odd = np.flatnonzero(checks != own[np.searchsorted(found, ids)])
    return int(odd[0]) if len(odd) else None


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")


def _bitmap(marked: DataFrame) -> np.ndarray:
    """Bits (column ``bit``) as words of 64; at most 2 ** (BITS - 6) rows are collected."""
    rows = marked.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint64)
    return out


def frequent_bits(words: DataFrame) -> np.ndarray:
    """The bitmap of words (lang, id)."""

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            prints = {lang: _lang_print(lang) for lang in set(langs)}
            of_lang = np.array([prints[x] for x in langs], dtype=np.uint64)
            yield pa.record_batch([pa.array(_bit(batch.column(1).to_numpy().astype(np.uint64), of_lang).astype(np.int64))], ["bit"])

    return _bitmap(words.select("lang", "id").mapInArrow(bits, "bit long"))


def _chains(data: np.ndarray, at: np.ndarray, of_lang: np.uint64, words: np.ndarray, sieves: list[np.ndarray], longest: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For phrases of 2 to ``longest`` words: (words, ids of all words, places where one ends, hashes by place).

    Its words are marked and lie in one piece, and so are both phrases a word shorter inside it; ``sieves`` has the bitmaps of
    hashes of phrases of 2, 3, ... words.
    """
    starts, ends, _, follows = words_of(data, at)
    ids = range_prints(data, starts, ends, seed)
    known = _has(words, _bit(ids, of_lang))
    whole, hashes = known, ids
    for k in range(2, longest + 1):
        before = np.concatenate([hashes[:1], hashes[:-1]])
        inside = np.concatenate([[False], whole[:-1]]) if len(whole) else whole
        whole = whole & inside & (follows if k == 2 else True)
        hashes = _pair(before, ids)
        if k - 2 < len(sieves):
            whole[whole] = _has(sieves[k - 2], _bit(hashes[whole], of_lang))
        yield k, ids, np.flatnonzero(whole), hashes


def frequent_hashes(docs: DataFrame, k: int, words, sieves: list, least: int = LEAST, seed: int = 0) -> np.ndarray:
    """The bitmap of phrases of ``k`` words whose hash occurs ``least`` times: all frequent ones, and few others.

    Hashes of four bytes are counted in place of the phrases, among those whose parts are in ``sieves`` (broadcast bitmaps):
    what is shuffled is a third of it.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(found.view(np.int32)), pa.array(n, pa.int32())], ["hash", "n"])

        for lang, data, at in _by_lang(batches):
            of_lang = _lang_print(lang)
            *_, (_, _, end, hashes) = _chains(data, at, of_lang, words.value, [s.value for s in sieves], k, seed)
            held.append((mix(hashes[end] ^ of_lang) >> np.uint64(32)).astype(np.uint32))
            if sum(map(len, held)) > 4 * HELD:
                yield summed()
        if held:
            yield summed()

    hashes = _read(docs).mapInArrow(counted, "hash int, n int").groupBy("hash").agg(F.sum("n").alias("n"))
    # the place in the bitmap is the first BITS bits of the hash
    place = F.shiftrightunsigned(F.col("hash").cast("long").bitwiseAND(0xFFFFFFFF), 32 - BITS)
    return _bitmap(hashes.where(F.col("n") >= least).select(place.alias("bit")))


def count_phrases(docs: DataFrame, longest: int, words, sieves: list, seed: int = 0, burst: int = BURST, held: int = HELD, tasks: int | None = None) -> DataFrame:
    """(lang, phrase, n): phrases of two to ``longest`` words that pass the broadcast bitmaps of words and of shorter phrases.

    Few different phrases are left, so a task that reads more text sends fewer rows: ``tasks`` bounds their number.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}

        def leaves(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            for lang, trie in tries.items():
                for keys, n in trie.runs(all_of_it):
                    yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys, pa.binary()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

        for lang, data, at in _by_lang(batches):
            trie = tries.setdefault(lang, HatTrie(burst, held))
            for k, ids, end, _ in _chains(data, at, _lang_print(lang), words.value, [s.value for s in sieves], longest, seed):
                trie.add(*_summed(np.stack([ids[end - (k - 1 - j)] for j in range(k)], axis=1)))
            if sum(t.size for t in tries.values()) > held:
                yield from leaves(all_of_it=len(tries) > 8)
        yield from leaves(all_of_it=True)

    texts = _read(docs) if tasks is None else _read(docs).coalesce(tasks)
    runs = texts.mapInArrow(counted, "lang string, phrase binary, n long")
    prefixed = runs.withColumn("_prefix", F.substring("phrase", 1, 24)).repartition("lang", "_prefix")
    return prefixed.groupBy("lang", "_prefix", "phrase").agg(F.sum("n").alias("n")).drop("_prefix")


# ---------------------------------------------------------------- scoring


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, burst: int = BURST, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, a) of all phrases of one to ``longest`` words that occur ``least`` times, (lang, id, word, n) with totals in rows without id)."""
    context = docs.sparkSession.sparkContext
    for seed in range(_SEEDS):
        words = cut(count_words(docs, seed).where((F.col("n") >= least) | F.col("id").isNull()), "collocation-words")
        if not words.where("unlike").limit(1).count():
            break
    else:
        raise RuntimeError("words share ids under every seed")
    single = words.where("id IS NOT NULL")
    of_words = context.broadcast(frequent_bits(single))
    sieves: list = []
    for k in range(2, min(longest, SIEVED) + 1):
        sieves.append(context.broadcast(frequent_hashes(docs, k, of_words, sieves, least, seed)))
    total = words.where("id IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(context.defaultParallelism, -(-total // WORDS_A_TASK))
    many = count_phrases(docs, longest, of_words, sieves, seed, burst, held, tasks).where(F.col("n") >= least)
    chain = F.unhex(F.lpad(F.hex("id"), 16, "0"))
    return cut(single.select("lang", chain.alias("phrase"), F.col("n").alias("a")).union(many), "collocation-phrases"), words


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words and more by their weakest cut, without those inside an equally frequent longer one."""
    size = F.length("phrase")
    many = phrases.where(size > 8)
    parts = many.withColumn("k", F.explode(F.sequence(F.lit(1), (size / 8 - 1).cast("int"))))
    parts = parts.select("lang", "phrase", "a", "k", F.expr("substring(phrase, 1, 8 * k)").alias("_left"), F.expr("substring(phrase, 8 * k + 1)").alias("_right"))
    left = phrases.select("lang", F.col("phrase").alias("_left"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("_right"), F.col("a").alias("r"))
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"CAST((CAST(1000 * {exact('a')} AS DECIMAL(22, 0)) * CAST(n AS DECIMAL(16, 0))) div ({exact('l')} * {exact('r')}) AS LONG)")
    cuts = parts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(totals, "lang")
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))
    inner = F.explode(F.array(F.expr("substring(phrase, 1, length(phrase) - 8)"), F.expr("substring(phrase, 9)")))
    covered = phrases.where(size > 16).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    open_ = weakest.join(covered, ["lang", "phrase"], "left").where("_longer IS NULL OR 100 * _longer < 100 * a")
    return open_.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, burst: int = BURST, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language."""
    phrases, words = frequent_phrases(docs, least, longest, burst, held)
    totals = words.where("id IS NULL").select("lang", "n")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # ranks with ties leave all that the words may still reorder; Spark limits each partition before it shuffles
    few = scored(phrases, totals).withColumn("_rank", F.rank().over(best)).where(F.col("_rank") <= top)
    apart = few.withColumn("_at", F.explode(F.sequence(F.lit(1), (F.length("phrase") / 8).cast("int"))))
    apart = apart.withColumn("_id", F.conv(F.hex(F.expr("substring(phrase, 8 * _at - 7, 8)")), 16, -10).cast("long"))
    names = words.where("id IS NOT NULL").select("lang", F.col("id").alias("_id"), F.col("word").cast("string").alias("_word"))
    texts = apart.join(names, ["lang", "_id"]).groupBy("lang", "phrase", "a", "l", "r", "n", "score").agg(F.sort_array(F.collect_list(F.struct("_at", "_word"))).alias("_words"))
    named = texts.select("lang", F.array_join(F.transform("_words", lambda w: w["_word"]), " ").alias("phrase"), "a", "l", "r", "n", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Collocations of all documents, by language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
chains AS (SELECT lang, w[i:i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) t(k))),
counts AS (SELECT lang, p, count(*)::HUGEINT AS a FROM chains GROUP BY ALL),
totals AS (SELECT lang, sum(a)::HUGEINT AS n FROM counts WHERE len(p) = 1 GROUP BY lang),
many AS (SELECT * FROM counts WHERE a >= 100),
cuts AS (SELECT c.lang, c.p, c.a, k, l.a AS l, r.a AS r, n, (1000 * c.a * n) // (l.a * r.a) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM many WHERE len(p) > 1) c
  JOIN many l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN many r ON r.lang = c.lang AND r.p = c.p[k + 1:] JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT s.lang, s.p FROM (SELECT lang, a, p[i:i + m - 1] AS p FROM (SELECT lang, a, p, m, unnest(range(1, len(p) - m + 2)) AS i FROM many, range(2, 5) t(m) WHERE m < len(p))) s
  JOIN many c ON c.lang = s.lang AND c.p = s.p WHERE 100 * s.a >= 100 * c.a),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase FROM weakest w ANTI JOIN inside i ON w.lang = i.lang AND w.p = i.p)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
