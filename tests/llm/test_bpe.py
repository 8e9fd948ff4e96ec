import hashlib
import struct

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelab.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
OWN = bpe.Encoder(bpe.Vocabulary(RANKS), P.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    raw = OWN.encode([text])[0]
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_same_ids_as_tiktoken(text):
    assert ids(text) == TIK.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abeinorst", min_size=1, max_size=600))
def test_long_letter_runs(text):
    assert ids(text) == TIK.encode_ordinary(text)


def test_fixed_texts():
    for t in ["", " ", "a" * 5000, "the" * 3000, "Zusammen" * 50 + "é" * 300, "\x00\n\r\t  x", "漢字" * 500, "<|endoftext|>",
              "!" * 4001, "0123456789" * 700, "aab" * 1000]:
        assert ids(t) == TIK.encode_ordinary(t), t[:20]


def test_table(spark):
    rows = [(1, "Hello wörld", 5), (2, None, 5), (3, "", 5), (None, "x" * 20000, 5), (1, "Hello wörld", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe.encode(df, PATH, P.PATTERN).collect()
    assert len(out) == 5
    for r in out:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        want = TIK.encode_ordinary(text)
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert bytes(r.decoded) == text.encode() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    again = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH)
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
