"""Collocations against brute force: counts with tries that burst and spill, weakest cuts, exact arithmetic, edges."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

from proofline.llm import collocations as co


def _brute(rows: list[tuple], least: int, top: int) -> list[tuple]:
    f: Counter = Counter()
    n: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    many = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in many.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 100 * many[lang, p[i : i + k]]:
                    gone.add((lang, p[i : i + k]))
    out: dict = {}
    for (lang, p), a in many.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def _texts(n: int) -> list[tuple]:
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = rng.choices(["Alpha", "beta", "gamma", "é", "ÉTÉ", "delta", "x" * 600, "eta"], weights=[5, 4, 3, 2, 1, 1, 0.3, 2], k=rng.randint(1, 30))
        rows.append((rng.choice(["en", "de", "und", None]), rng.choice([" ", "\t", "  "]).join(words).replace("beta  gamma", "beta, gamma") + rng.choice(["", ".", "\n", "!?"])))
    return rows + [("en", None), ("en", ""), (None, " .,"), ("zz", "one two. one two")]


def test_brute_force_with_small_tries(spark):
    rows = _texts(300)
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(3)
    for least, top, burst, held in ((10, 2000, 4, 50), (3, 25, 4096, 600_000)):
        got = sorted(map(tuple, co.collocations(docs, least, top=top, burst=burst, held=held).collect()))
        assert got == _brute(rows, least, top) and len(got) > 20


def test_trie_counts_and_runs():
    rng = np.random.default_rng(2)
    trie, want, got = co.HatTrie(burst=8, held=200), Counter(), Counter()
    for _ in range(30):
        for k in (3, 4, 5):
            chains, counts = co._summed(rng.integers(0, 4, (60, k)).astype(np.uint64) + np.uint64(2**63))
            trie.add(chains, counts)
            want.update({c.astype(">u8").tobytes(): int(n) for c, n in zip(chains, counts)})
        if trie.full:
            before = trie.size
            for keys, n in trie.runs():
                assert keys == sorted(keys)
                got.update(dict(zip(keys, n)))
            assert trie.size <= before - trie.held // 2
    assert any(node.table is None for node in trie.root.values())
    for keys, n in trie.runs(all_of_it=True):
        assert keys == sorted(keys)
        got.update(dict(zip(keys, n)))
    assert got == want and trie.size == 0 and not trie.root


def test_products_beyond_64_bits(spark):
    word = lambda *ids: b"".join(i.to_bytes(8, "big") for i in ids)
    big, n = 3 * 10**12 + 7, 9 * 10**13 + 1
    phrases = spark.createDataFrame([("en", word(1), big), ("en", word(2), big + 1), ("en", word(1, 2), big - 5)], "lang string, phrase binary, a long")
    (row,) = co.scored(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert row.score == 1000 * (big - 5) * n // (big * (big + 1)) and (row.l, row.r) == (big, big + 1)


def test_shared_ids_are_seen():
    ids, checks = np.array([7, 9, 7], dtype=np.uint64), np.array([1, 2, 3], dtype=np.int32)
    found, first = np.unique(ids, return_index=True)
    assert co._unlike(ids, checks, found, checks[first]) == 2
    assert co._unlike(ids, checks[[0, 1, 0]], found, checks[first]) is None


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    assert sorted(map(tuple, co.query(spark, at).collect())) == sorted(duck.execute(co.SQL).fetchall())


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
