import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from proofline.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    return [x for b in byte_bpe.encoded([batch], PATH) for x in b.column(1).to_pylist()]


def expected(texts):
    return [ORACLE.encode_ordinary(t or "") for t in texts]


def test_edges():
    texts = ["", None, "a", " ", "  ", "\n\n x", "a \nb", "it's", " 's", "x's's'll", "'st 'rest x''s", "\n's", "a  b   ", "£5 ½ ²³", "日本語 text", "<|endoftext|>", "\x1c\x1d a\x85b", "a　b", "''ve", "x've'RE", "éa", "'" * 9, "😀 😀'd"]
    assert ids_of(texts) == expected(texts)


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1" for c in points[i : i + 4000]) for i in range(0, len(points), 4000) if i < 0x20000 or i > 0xE0000]
    assert ids_of(texts) == expected(texts)


def test_very_long_word_and_text():
    texts = ["ab" * 30_000, "x" * 20_001, "word " * 200_000, "'" * 5_000]
    assert ids_of(texts) == expected(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'srevltmdLLaé1٣.!-中  ")), st.characters(exclude_categories=("Cs",)))), max_size=6))
def test_any_text(texts):
    assert ids_of(texts) == expected(texts)


def test_round_trip_and_digests(spark):
    rows = [(1, "héllo  world's\n\n end"), (2, None), (3, ""), (4, "héllo  world's\n\n end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in byte_bpe.digest(df, PATH).collect()}
    for doc_id, text in rows:
        ids = np.array(ORACLE.encode_ordinary(text or ""), dtype="<u4")
        r = found[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    both = byte_bpe.decode(byte_bpe.encode(df.selectExpr("*", "'x' AS IDS"), PATH), PATH).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and (not r.ids or r.token_ends[-1] == len(r.decoded)) for r in both)
    assert byte_bpe.digest(df.limit(0), PATH).count() == 0
