import random
import re
from collections import Counter

from pyspark.sql import functions as F

from proofline.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_measures_and_policies(spark):
    rng = random.Random(4)
    texts = [None, "", " \n ", "a", "a b c d", "a b c a b c", "a a a a", "x\nx\n y\nx ", "é#* <b>|&%$" * 20, "word " * 60, "A B\x0bC\x0cD\tE\rF"]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90))) for _ in range(40)]
    texts += [" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(20_000)), "LOUD WORDS " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS N_WORDS", "1 AS FAILURE_BITS")
    entries = quality_rules.ledger(df)
    got = {r.doc_id: r for r in quality_rules.apply_policy(entries).collect()}
    for i, text in enumerate(texts):
        r, m = got[i], measured(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, (i, text and text[:50])
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and (not r.base_failed or not r.kept)
    assert got[len(texts) - 2].kept and not got[len(texts) - 1].kept
    found = {r.rule: r for r in quality_rules.ablations(entries, "v2").collect()}
    bits = [r.failure_bits for r in got.values()]
    whole = quality_rules.mask(quality_rules.POLICIES["v2"])
    bits = [b & whole for b in bits]
    for k, rule in enumerate(quality_rules.RULES):
        if rule.name not in quality_rules.POLICIES["v2"]:
            continue
        assert found[rule.name].n_failed == sum(b >> k & 1 for b in bits) and found[rule.name].n_only == sum(b == 1 << k for b in bits)
        assert found[rule.name].n_kept_without == sum(b & ~(1 << k) == 0 for b in bits)
    empty = quality_rules.ledger(df.limit(0))
    assert empty.count() == 0 and all(r.n_failed == 0 for r in quality_rules.ablations(empty).collect())


def filled(sizes, passes=3):
    """Targets by sharing and resharing, one capped source after the other."""
    total, capped = sum(sizes), set()
    weights = [k % 3 + 1 for k in range(len(sizes))]
    while True:
        left = total - sum(passes * sizes[k] for k in capped)
        rest = sum(w for k, w in enumerate(weights) if k not in capped)
        level = left / rest if rest else 0.0
        over = {k for k in range(len(sizes)) if k not in capped and weights[k] * level > passes * sizes[k]}
        if not over:
            return [passes * s if k in capped else weights[k] * level for k, s in enumerate(sizes)]
        capped |= over


def replay(rows, turns, passes=3):
    """Copies of each row by the queue's definition: (how often each (key, source, size) is taken), for distinct keys."""
    names = sorted({r[1] for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = [sum(r[2] for r in rows if r[1] == name) for name in names]
    queue = []
    for name, whole, target in zip(names, sizes, filled(sizes, passes)):
        done = 0
        for key, _, size in sorted((r for r in rows if r[1] == name), key=lambda r: turns[r[0]]):
            done += size
            queue += [((done + j * whole) / target, name is None, name or "", done, key, size) for j in range(passes) if size]
    taken, spent, over = Counter(), 0, None
    for f, *_, key, size in sorted(queue):
        spent += size
        if over is None and spent > sum(sizes):
            over = f
        if over is None:
            taken[key] += 1
    return taken, over


def test_queue_is_replayed(spark):
    rng = random.Random(31)
    for case in range(3):
        names = ["", "a", "b", "é", None][: 2 + case]
        rows = [(k, rng.choice(names[: 1 + k % len(names)]), rng.choice([0, 3, rng.randint(1, 300)])) for k in range(700)]
        df = spark.createDataFrame(rows, "doc_id long, source string, size long")
        turns = {r.doc_id: r.turn for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("turn")).collect()}
        want, _ = replay(rows, turns)
        got = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
        assert got == {k: want[k] for k, _, _ in rows}


def test_targets_and_mix(spark):
    rng = random.Random(9)
    for case in range(4):
        rows, key = [], 0
        names = ["", "a", "b", "c", "d", "é", None][: 3 + case]
        for name in names:
            for _ in range(rng.choice([1, 5, 400, 900])):
                rows.append((key, name, rng.choice([0, 1, 5, rng.randint(1, 400)])))
                key += 1
        rows.append(rows[-1])
        df = spark.createDataFrame(rows, "doc_id long, source string, size long").selectExpr("*", "0 AS TAKEN")
        got = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(3)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
        assert len(got) == len(rows)
        sizes = [sum(r[2] for r in rows if r[1] == name) for name in names]
        left = 0
        for name, size, target in zip(names, sizes, filled(sizes)):
            own = [r for r in got if r.source == name]
            assert all(r.source_size == size and abs(r.target - target) < 1e-6 for r in own)
            assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in own)
            most = max((r.size for r in own), default=0)
            assert sum(r.taken for r in own) > target - most - 1e-6
            left += sum(r.taken for r in own) - target
        assert left <= 1e-6
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_of_awkward_rows(spark):
    """Null ids and sources, one id on many differing rows, rows that are alike, sources without words."""
    rows = [(None, None, 7, f"t{i}") for i in range(60)] + [(5, "a", 3, f"u{i % 4}") for i in range(90)] + [(6, "b", 0, "z"), (7, "b", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, extra string").withColumn("_ROW", F.lit(1))
    one, two = mixing.mix(df), mixing.mix(df.repartition(5))
    got = one.collect()
    assert sorted(map(str, got)) == sorted(map(str, two.collect())) and len(got) == len(rows)
    assert sum(r.taken for r in got) <= 60 * 7 + 90 * 3 and all(r.taken == 0 for r in got if r.source == "b")
    by = Counter()
    for r in got:
        by[r.source] += r.taken
    aims = {r.source: r.target for r in got}
    assert all(abs(by[s] - t) <= 7 for s, t in aims.items())
