"""Spelling variants against brute force: pairs over grids of any size, damaged words, forms and roots."""

import random
import zlib
from collections import Counter

import duckdb
import re

from proofline.llm import spelling


def _one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _words(seed: int, n: int) -> dict[str, int]:
    rng = random.Random(seed)
    found: dict[str, int] = {}
    while len(found) < n:
        base = "".join(rng.choice("abcdeéÿ÷") for _ in range(rng.randint(6, 9)))
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(base))
            found.setdefault(rng.choice([base, base[:i] + rng.choice("abcdé") + base[i + 1 :], base[:i] + base[i + 1 :], base[:i] + "b" + base[i:]]), rng.choice([5, 5, 6, 25, 30, 200, 1000]))
    # long words, around the width at which comparison changes, and equal letters in another order
    for size in (spelling.WIDE - 1, spelling.WIDE, spelling.WIDE + 1, 400):
        long = "".join(rng.choice("ab") for _ in range(size))
        found |= {long: 7, long + "a": 8, long[:5] + long[6:]: 9, "c" + long[1:]: 50}
    return found | {"aabbcc": 5, "bbaacc": 5, "aabbcd": 6}


def test_pairs_and_forms_equal_brute_force(spark):
    words = _words(3, 300)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {w: [v for v in words if _one_apart(w, v)] for w in words}
    want = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        want[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for mean, subtree in ((6_000, 20_000), (2, 5)):
        got = {r.word: r for r in spelling.variants(df, mean, subtree).collect()}
        assert got.keys() == words.keys()
        for w in words:
            root = w
            while want[root]:
                root = want[root]
            r = got[w]
            assert (r.n, r.n_near, r.form, r.form_n, r.root) == (words[w], len(near[w]), want[w], words[want[w]] if want[w] else None, root), w


def test_chain_of_forms(spark):
    chain = ["aaaaaaaa", "baaaaaaa", "bbaaaaaa", "bbbaaaaa", "bbbbaaaa", "bbbbbaaa"]
    df = spark.createDataFrame([(w, 5 ** (i + 1)) for i, w in enumerate(chain)], "word string, n long")
    assert {r.root for r in spelling.variants(df).collect()} == {chain[-1]}


def test_damaged_words(spark):
    rng = random.Random(9)
    texts = [(i if i % 7 else None, " ".join(rng.choice(["Wonderful", "ÉTIONEUX", "étioneux", "abcde", "abcdef", "aaaaaaaX9zzzzzzz"]) for _ in range(60))) for i in range(300)] + [(1, None), (2, ""), (3, "é" * 700)]
    want: Counter = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                want[run] += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.damaged_words(docs).collect()} == want


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = sorted(duck.execute(spelling.SQL).fetchall())
    got = sorted(map(tuple, spelling.query(spark, at).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert [str(x) for x in got] == [str(x) for x in want] and sum(r[1] is not None for r in got) > 100


def test_no_words(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a b c")], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(docs)).collect() == []
