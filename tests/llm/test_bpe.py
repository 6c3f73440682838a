import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from galena.llm.bpe import ByteBPE, PerfectHash, decode_documents, encode_documents, read_ranks
from galena.llm.chunks import chunks

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TOKENS = read_ranks(RANKS)
BPE = ByteBPE(TOKENS, P.PATTERN)
TRUE = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})


def ids(text):
    return np.frombuffer(BPE.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0 'saé日😀1²."), st.characters(exclude_categories=["Cs"]))))
def test_like_the_library(text):
    assert ids(text) == TRUE.encode_ordinary(text)
    assert BPE.known.encode_many([text, "a b\nc", text]) == [BPE.encode(t) for t in (text, "a b\nc", text)]
    assert BPE.decode(BPE.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "  ", "a" * 3000, "ab " * 500, "they're  here \n now", "x" * 60 + " y", "\n\n  a b", "<|endoftext|>", "a\nb c\nd\n", "\n", "\na", "a\n\nb", "a\n\n", "a \n", "x\n's b\n12", "\x01a \x01b", "a\x01"])
def test_edges(text):
    assert ids(text) == TRUE.encode_ordinary(text)
    assert BPE.known.encode_many([text]) == [BPE.encode(text)]


def test_memo_ages_without_changing_results():
    BPE.known.spaced.limit = BPE.known.pieces.limit = 50
    r = random.Random(1)
    for _ in range(60):
        text = " ".join("".join(r.choices("abcdeé,.", k=r.randint(1, 9))) for _ in range(40))
        assert ids(text) == TRUE.encode_ordinary(text)
    assert len(BPE.known.spaced) <= 100


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = PerfectHash(keys)
    assert [table.get(k) for k in keys] == list(range(5000)) and sorted(table.values) == list(range(5000))
    assert table.get(b"absent") is None and PerfectHash([]).get(b"x") is None


def test_chunks_lose_nothing():
    for text in ("", " ", "a  b", "a b", " a\n b", "a\t b c "):
        assert " ".join(chunks(text)) == text
    assert chunks("a b\nc.\nd e\n") == ["a", "b", "\nc.", "\nd", "e", "\n"]


def test_documents(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "", "y"), (3, "w " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_documents(docs, TOKENS, P.PATTERN).collect()
    assert len(got) == 5
    for (i, text, _), r in zip(rows, got):
        want = TRUE.encode_ordinary(text or "")
        raw = np.array(want, "<u4").tobytes()
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (i, len(want), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = decode_documents(encode_documents(docs, TOKENS, P.PATTERN), TOKENS, P.PATTERN).collect()
    assert [(r.doc_id, r.text) for r in back] == [(i, t or "") for i, t, _ in rows]
    assert encode_documents(docs.limit(0), TOKENS, P.PATTERN).collect() == []
    clash = docs.selectExpr("doc_id", "text", "7 n_tokens", "ids _text")
    kept = encode_documents(clash, TOKENS, P.PATTERN, keep=["doc_id", "n_tokens", "_text"])
    assert kept.columns == ["doc_id", "_text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and kept.first().n_tokens == got[0].n_tokens
