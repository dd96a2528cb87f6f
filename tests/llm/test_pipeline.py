import hashlib

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_byte_bpe import ORACLE
from test_ngram_join import brute as components
from test_rules_and_mixing import filled, measured
from test_suffix_dedup import brute as repeated

from proofline.session import cut

SF = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(1)).union(spark.createDataFrame([(None, None, None, None, None), (10**6, None, "en", None, 0)], docs.schema))
    outs = []
    for name, stage in pipeline.STAGES:
        outs.append((docs, cut(stage(spark, docs, SF), f"test-{name}")))
        assert name == "byte_bpe" or outs[-1][1].columns == docs.columns
        docs = outs[-1][1]
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before, after = outs[0]
    kept = sorted(texts(after), key=str)
    assert all(measured(t)[0] >= 50 for _, t in kept)
    # what the base rules leave is only rejected for symbols, lines, case or letters
    lost = [t for t in texts(before) if t not in kept]
    assert all(measured(t)[0] < 50 or 2 * measured(t)[4] > measured(t)[0] or 10 * measured(t)[2] > measured(t)[0] or measured(t)[3] or sum(map(str.isupper, t)) > 0.5 * sum(map(str.isalpha, t)) for _, t in lost)
    before, after = outs[1]
    assert sorted(d for d, _ in texts(after)) == sorted({c for _, _, c in components(texts(before))})
    before, after = outs[2]
    want = {d: (n, gone) for d, n, gone, _, _ in repeated(texts(before))}
    for d, t in texts(after):
        assert 0 <= want[d][0] - want[d][1] - len(t.encode()) <= 8
    assert sum(w[1] for w in want.values())
    before, after = outs[3]
    size = lambda df: df.withColumn("s", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).groupBy("source").agg(F.sum("s").alias("s"), F.max("s").alias("m"))
    had, got = {r.source: r for r in size(before).collect()}, {r.source: r.s for r in size(after).collect()}
    names = sorted(had)
    for name, target in zip(names, filled([had[n].s for n in names])):
        assert abs(got.get(name, 0) - target) <= had[name].m
    before, after = outs[4]
    ids = {d: ORACLE.encode_ordinary(t) for d, t in texts(before)}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids)
    raw = dict(texts(before))
    assert all(r.decoded_sha256 == hashlib.sha256(raw[r.doc_id].encode()).hexdigest() for r in rows)


CLASHING = ("_row", "_held", "_rest", "_size", "_key", "_none", "target", "kept", "whole", "n_bytes", "n_removed", "n_spans", "copies", "taken", "component_id", "failure_bits", "n_words", "_id", "_in", "_part")


def test_extra_columns_with_clashing_names_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *(F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in CLASHING))
    for _, stage in pipeline.STAGES[:-1]:
        got = cut(stage(spark, wide, SF), "test-clash")
        assert got.columns == wide.columns and got.count()
        for c in CLASHING:
            assert not got.where(F.col(c) != F.concat_ws("-", F.lit(c), "doc_id")).count()
        plain = cut(stage(spark, docs, SF), "test-plain")
        rows = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
        if stage is not pipeline.mixture:  # its ties are ordered by all columns
            assert rows(got) == rows(plain)
        else:
            assert abs(got.count() - plain.count()) <= 0.1 * plain.count()


def test_cut_characters_go_by_position_and_others_stay(spark):
    import random

    rng = random.Random(6)
    fresh = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    shared = fresh(60)
    # the last shared bytes are the first of a character, so the cut splits it; genuine replacement characters stand by
    a, b = "础", "砀"  # noqa: RUF001
    assert a.encode()[:1] == b.encode()[:1] and a != b
    rows = [(1, fresh(40) + shared + a + fresh(40)), (2, "genuine \ufffd stays " + fresh(20) + shared + b + fresh(20) + " \ufffd\ufffd"), (3, None), (4, ""), (5, "y" * 300_000 + fresh(50_000) + "\ufffd")]
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in pipeline.repeated_strings(spark, docs, SF).collect()}
    raw = dict(rows)
    assert got[1].text == raw[1] and got[3].text is None and got[4].text == ""
    assert shared not in got[2].text and b not in got[2].text
    assert got[2].text == raw[2].replace(shared + b, "") and got[2].n_chars == len(got[2].text)
    # every byte of the run but the first is inside a string that also starts one earlier
    assert got[5].text == "y" + raw[5][300_000:]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0


def test_null_and_repeated_ids_keep_differing_texts(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = words(0) + " end"
    rows = [(None, words(0)), (None, words(1)), (None, words(2)), (7, words(3)), (7, words(4)), (7, words(4)), (9, near), (None, words(1) + " end"), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    got = pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(None, words(1)), (None, words(2)), (7, words(3)), (7, words(4)), (9, near), (None, None), (None, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
