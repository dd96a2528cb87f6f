"""Ids and texts equal the library's, on whole tables and on hard texts; the table of words never changes an id."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from proofline.llm import sentence_pieces as sp

PATH = sp.vocabulary()
HARD = ["", None, " ", "  a  b\n\tc  ﬁ Ａ  <s> </s> <unk> <0x0A> ▁x \0 ", "▁", "▁▁a▁", "x" * 5000, "日本語テキスト" * 300, "� 𐍈 é", "a" + " " * 100 + "b", "⁇  ", "\n", "a" * 49 + " " + "ab" * 24]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_hard_texts_and_clashing_columns(spark, library):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(HARD)], "doc_id long, text string, IDS string, decoded string")
    for tabled in (1, 1000):
        got = {r.doc_id: r for r in sp.decode(sp.encode(docs, PATH, tabled=tabled), PATH).collect()}
        for i, text in enumerate(HARD):
            want = library.encode(text or "", add_eos=True)
            assert got[i].ids == want, text
            assert got[i].decoded == library.decode(want)


def test_decoding_of_any_ids(library):
    model, rng = sp.pieces(PATH), np.random.default_rng(5)
    for k in range(2000):
        ids = rng.integers(0, (300, 32000)[k % 2], rng.integers(0, 12)).astype(np.int32)
        assert model.decode(ids).decode() == library.decode(ids.tolist())


def test_distinct_words(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b  c"), (3, None)], "doc_id long, text string")
    got = {bytes(r.chunk): r.n for r in sp.distinct_chunks(docs, PATH, most=None, reported=1).collect()}
    assert got == {b" a": 2, b" b": 2, b"  c": 1}
    top = sp.distinct_chunks(docs, PATH, most=1, reported=1).collect()
    assert [bytes(r.chunk) for r in top] == [b" a"]


def test_whole_query(spark, library):
    at = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in sp.query(spark, at).collect()}
    texts = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(texts)
    for r in texts:
        want = library.encode(r.text, add_eos=True)
        own = got[r.doc_id]
        assert own.n_tokens == len(want)
        assert own.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sp.digest(docs, PATH).collect() == []
