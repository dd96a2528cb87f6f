import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from proofline.llm import components, ngram_join
from proofline.session import cut, ship

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    """All pairs of documents, and components by union."""
    sets = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        w = [x.lower() for x in WORD.findall((text or "").encode())]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (key, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), key), key)
    return sorted((key, len(sets[i]), low[top(i)] if sets[i] else key) for i, (key, _) in enumerate(rows))


def corpus(seed, copies, edits):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base, rows = fresh(40), fresh(160), []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(10_000 + i, " ".join(fresh(rng.randint(10, 60)) + passage)) for i in range(copies)]
    rows += [(20_000, None), (20_001, ""), (20_002, " \n\t"), (20_003, "one"), (20_004, "ONE"), (20_005, "one two three four"), (20_006, "one two  three\nfour"), (20_007, "one two three four five")]
    rows += [(30_000 + i, " ".join(passage)) for i in range(5)] + [(30_000, " ".join(passage))]
    return rows


def joined(spark, rows, **limits):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, CLS int")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(df, **limits).collect())


@pytest.mark.parametrize(
    ("seed", "copies", "edits", "limits"),
    [
        (1, 90, 4, {}),
        (2, 60, 9, {"frequent": 5, "longest": 8}),
        (4, 120, 8, {"frequent": 4, "longest": 3, "most_frequent": 30, "part": 50}),
    ],
)
def test_against_brute_force(spark, seed, copies, edits, limits):
    ship(spark)
    rows = corpus(seed, copies, edits)
    assert joined(spark, rows, **limits) == brute(rows)


@pytest.mark.parametrize("texts", [["one"], ["one", "one"], ["a b c d e"], [None], [""], ["a b c d e f g"] * 3 + ["x"]])
def test_tiny_tables(spark, texts):
    ship(spark)
    rows = list(enumerate(texts))
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, []) == []


def test_words_that_polynomials_confuse(spark):
    """The Thue-Morse word and its complement agree under every polynomial modulo a power of two."""
    ship(spark)
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    short = word[:400], other[:400]
    rows = [(1, word), (2, other), (3, short[0]), (4, short[1]), (5, word.upper())]
    assert joined(spark, rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 1)]


def lists(h, g, n, batch, longest, part):
    """What the list step makes of sorted rows in batches: candidate pairs and rows passed on."""
    pos = [0] * len(h)
    columns = [pa.array(x, t) for x, t in ((h, pa.int64()), (g, pa.int64()), (n, pa.int32()), (pos, pa.int32()))]
    table = pa.Table.from_arrays(columns, ["h", "g", "n", "pos"])
    out = [r for b in ngram_join._short_lists(table.to_batches(max_chunksize=batch), longest, part) for r in b.to_pylist()]
    return {(r["a"], r["b"]) for r in out if r["b"] is not None}, sorted((r["h"], r["a"]) for r in out if r["b"] is None)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_lists_passed_on_in_parts_lose_no_row(batch):
    h = [1] * 3 + [2] * 1000 + [3] * 2 + [4] * 70
    g = [*range(3), *range(1000), 5, 6, *range(70)]
    pairs, long = lists(h, g, [10] * len(h), batch, 64, 300)
    assert pairs == {(0, 1), (0, 2), (1, 2), (5, 6)}
    assert long == [(2, k) for k in range(1000)] + [(4, k) for k in range(70)]


def test_told_lists_are_long():
    # a row with n = 0 says that other rows of the list went another way
    assert lists([1, 1, 2, 2, 2], [8, 9, 0, 3, 4], [10, 10, 0, 10, 10], 10, 64, 300) == ({(8, 9)}, [(2, 3), (2, 4)])


def test_compared_pairs_grow_with_a_group(spark, monkeypatch):
    """A group of near copies costs comparisons in proportion to its size."""
    ship(spark)
    made = {}
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: made.setdefault(name, []).append(cut(df, name)) or made[name][-1])
    compared = []
    for copies in (150, 450):
        rng = random.Random(copies)
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows = []
        for i in range(copies):
            w = list(base)
            for at in rng.sample(range(150), rng.randint(0, 9)):
                w[at] = f"x{i}-{at}"
            rows.append((i, " ".join(w)))
        made.clear()
        assert len(joined(spark, rows)) == copies
        compared.append(sum(d.count() for name in ("ngram-pairs", "ngram-rest", "ngram-stars") for d in made.get(name, [])))
        assert compared[-1] <= 20 * copies, compared
    assert compared[1] <= 4 * compared[0] + 1000


def test_chain_is_one_component(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7000, 7000)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components.connected(df).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}
