"""Pieces of many texts encoded side by side."""

import base64
import hashlib
import itertools
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quillgraph.llm import byte_bpe, transducer

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", "a", "   z", "it's we'll 'S '", "x" * 3000, "日本語 😀😀 é", "", "a<|endoftext|>b", " \n\n \t x  y ", "'" * 700 + "s", "𝔘𝔫𝔦 " * 90, "0123456789abcdef" * 40, "\x00\x7f ", ""]


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return byte_bpe.ByteBpe(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_new_pieces_cost_little_beside_splitting(codec):
    """Pieces that no text has had lately pass the transducer together, not one by one."""
    text = "".join(f" {''.join(w)}" for w in itertools.product("etaoinshrdlu", repeat=5))
    codec.encode(text)

    def took(work):
        began = time.process_time()
        work(text)
        return time.process_time() - began

    assert min(took(codec.encode) for _ in range(2)) < 12 * min(took(codec.pattern.findall) for _ in range(2))


@pytest.mark.parametrize(("signs", "tokens", "long", "states"), [(1 << 20, 1 << 20, 256, 200_000), (50, 7, 5, 200_000), (1, 1, 1, 10), (400, 3, 0, 0)])
def test_groups_against_the_library(codec, library, monkeypatch, signs, tokens, long, states):
    for module, name, value in ((byte_bpe, "SIGNS_AT_ONCE", signs), (byte_bpe, "TOKENS_AT_ONCE", tokens), (transducer, "LONG", long), (transducer, "MAX_STATES", states)):
        monkeypatch.setattr(module, name, value)
    chance = random.Random(signs)
    texts = ODD + ["".join(chance.choices(["the", "e", " ", "'ll", "é", "漢", "😀", "\n", "12", "!", "ing", "q", "ക"], k=chance.randrange(80))) for _ in range(60)]
    found = list(codec.encode_all(texts))
    assert len(found) == len(texts) and list(codec.encode_all([])) == []
    for text, got in zip(texts, found):
        want = library.encode_ordinary(text)
        assert codec.ids(got).tolist() == want == codec.encode(text)
        assert codec.digests(got) == (hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_digests_of_ids_that_break_off(codec):
    whole = np.array([list(codec.ranks).index(bytes([b]).decode("latin-1")) for b in "é😀".encode()], np.int32)
    for n in range(len(whole) + 1):
        want = codec.decode_bytes(codec.ids(whole[:n]).tolist()).decode("utf-8", "replace")
        assert codec.digests(whole[:n])[1] == hashlib.sha256(want.encode()).hexdigest()


def test_table_against_a_dict():
    chance = np.random.default_rng(3)
    table, plain = transducer.Table(2), {}
    for _ in range(60):
        new = np.array([k for k in np.unique(chance.integers(0, 4000, 90)).tolist() if k not in plain], np.int64)
        table.put(new, new * 3)
        plain |= {k: 3 * k for k in new.tolist()}
        asked = chance.integers(0, 5000, 300)
        assert table.get(asked).tolist() == [plain.get(k, -1) for k in asked.tolist()]
    assert table.size == len(plain) and 2 * table.size <= len(table.keys)
