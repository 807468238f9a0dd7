"""Encoders and counters against the public libraries."""

import base64

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm.byte_bpe import ByteBpe, Utf8Stream, decode, encode, round_trip_digest
from quillgraph.llm.token_counts import WordCounter, count_tokens

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaaa", "it's we'll 'S '", "ΣΑΣ İstanbul ß é é", "日本語 😀😀", "\n\n \t x  y ", "a<|endoftext|>b <|startoftext|>", "x" * 3000, "''''''s", "12345 6.7e-9", "!!!???...---", "don't'll", "   z"]


@pytest.fixture(scope="module")
def codec():
    return ByteBpe(open(RANKS, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return WordCounter(open(WORDS, encoding="utf-8").read())


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


def test_odd_texts(codec, library, counter, word_library):
    for t in ODD:
        assert codec.encode(t) == library.encode_ordinary(t)
        assert codec.decode_bytes(codec.encode(t)) == t.encode()
        assert "".join(codec.decode_stream(codec.encode(t))) == t
        want = len(word_library.encode(t, add_special_tokens=False).ids)
        assert counter.count(t) == want, t
        for size in (1, 2, 3, 7):
            assert counter.count(t, size) == want, (t, size)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcehnorst' \n.!1") + ["é", "ß", "日", "😀"]), max_size=60), st.integers(1, 9))
def test_random_texts(codec, library, counter, word_library, text, size):
    assert codec.encode(text) == library.encode_ordinary(text)
    assert counter.count(text, size) == len(word_library.encode(text, add_special_tokens=False).ids)


def test_utf8_stream():
    for data in (b"\xff", b"\xe2\x82", b"a\xc3\xa9\xf0\x9f\x98\x80", b"\xc3a", b"\xed\xa0\x80"):
        s = Utf8Stream()
        assert "".join(s.feed(bytes([b])) for b in data) + s.end() == data.decode("utf-8", "replace")


def test_frames(spark, codec):
    docs = spark.createDataFrame([(1, "the cat", "x"), (1, "the cat", "y"), (None, None, None), (3, "", "z")], "doc_id long, text string, n_tokens string")
    enc = encode(docs, RANKS, P.PATTERN)
    rows = sorted(decode(enc, RANKS).collect(), key=str)
    assert enc.columns == ["doc_id", "text", "n_tokens", "ids"]
    assert {bytes(r.decoded) for r in rows} == {b"the cat", b""}
    dig = round_trip_digest(docs, RANKS, P.PATTERN).collect()
    assert sorted(r.n_tokens for r in dig) == [0, 0, 2, 2]
    counts = count_tokens(docs, WORDS).collect()
    assert sorted(r.n_tokens for r in counts) == [0, 0, 2, 2] and not any(r.over_limit for r in counts)
    assert count_tokens(docs.limit(0), WORDS).count() == 0
