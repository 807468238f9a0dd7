"""Byte-level BPE encoding and decoding.

The ranks of a vocabulary file become a transducer over bytes (transducer.py)
that emits token ids after bounded lookahead. The pieces that a group of texts
has go through it side by side, each once in a group; no piece is kept beyond
its group. Decoding feeds the ids' bytes to
an incremental UTF-8 state machine, which passes text on as soon as it says
that a character is complete. All ids of a document go through it in turn; its
state is the bytes that wait, and the move of a token in a state is kept.

Defined cases: a null text encodes as an empty one (no ids, both digests of the
empty string). Each row is encoded by itself, so repeated rows and null ids
pass through. Other columns pass through unchanged; columns named like a result
column give way to it. An empty table gives an empty table. Bytes that are no
UTF-8 decode to U+FFFD in a text stream and to themselves in ``decode``.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillgraph.llm.common import resident, with_found
from quillgraph.llm.transducer import BatchTransducer

#: Signs of the texts that are encoded together (a longer text: alone), and tokens or pieces that arrays are made of at once.
SIGNS_AT_ONCE, TOKENS_AT_ONCE = 1 << 20, 1 << 20


def _shares(n: int) -> Iterator[slice]:
    return (slice(at, at + TOKENS_AT_ONCE) for at in range(0, n, TOKENS_AT_ONCE))


class ByteBpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, rank_lines: bytes, pattern: str):
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, rank_lines.splitlines()) if a}
        self.pattern, self.ranks = regex.compile(pattern), ranks
        self.bytes_of = {i: t.encode("latin-1") for t, i in ranks.items()}
        self.machine = BatchTransducer({t: k for k, t in enumerate(ranks)}, lambda a, b: ranks.get(a + b))
        self._ids = np.array([*ranks.values()], np.int32)
        self._shown = np.array([f" {i}" for i in ranks.values()], "S")
        self._states: dict[bytes, Waiting] = {}
        self._start = self._waiting(b"")

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its tokens, as numbers of the vocabulary's lines."""
        seen: dict[str, int] = defaultdict(count().__next__)
        found = (self.pattern.findall(t) if len(t) <= SIGNS_AT_ONCE else (m[0] for m in self.pattern.finditer(t)) for t in texts)
        pieces = [np.fromiter(map(seen.__getitem__, f), np.int32) for f in found]
        if not seen:
            return [np.zeros(0, np.int32) for _ in texts]
        _, bounds, data = pa.array(list(seen), pa.large_string()).buffers()
        tokens, many = self.machine.run_all(np.frombuffer(data, np.uint8), np.frombuffer(bounds, np.int64))
        ends = np.cumsum(many)
        out, pieces, lengths = [], np.concatenate(pieces), list(map(len, pieces))
        for share in _shares(len(pieces)):
            n, last = many[pieces[share]], ends[pieces[share]]
            out.append(tokens[np.arange(n.sum()) + np.repeat(last - np.cumsum(n), n)])
        pieces_before = np.cumsum(lengths)[:-1]
        before = np.concatenate([[0], np.cumsum(many[pieces])])[pieces_before]
        return np.split(np.concatenate(out), before)

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """For each text its tokens, as numbers of the vocabulary's lines; ``ids`` has their ids."""
        group, signs = [], 0
        for text in texts:
            if group and signs + len(text) > SIGNS_AT_ONCE:
                yield from self._together(group)
                group, signs = [], 0
            group.append(text)
            signs += len(text)
        yield from self._together(group)

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        return self._ids[tokens]

    def encode(self, text: str) -> list[int]:
        return self.ids(self._together([text])[0]).tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _waiting(self, held: bytes) -> Waiting:
        if held not in self._states:
            self._states[held] = Waiting(self, held)
        return self._states[held]

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as its characters become complete; bytes that are no UTF-8 become U+FFFD."""
        state = self._start
        for i in ids:
            text, state = state[i]
            yield text
        if state.held:
            yield "\N{REPLACEMENT CHARACTER}"

    def _decode_on(self, ids: Iterable[int], state: Waiting) -> tuple[str, Waiting]:
        """The text of ``decode_stream`` from a state, without its end, and the state after it."""
        out: list[str] = []
        add = out.append
        for i in ids:
            text, state = state[i]
            add(text)
        return "".join(out), state

    def decode_text(self, ids: Iterable[int]) -> str:
        """The text of ``decode_stream``, at once."""
        text, state = self._decode_on(ids, self._start)
        return text + "\N{REPLACEMENT CHARACTER}" * bool(state.held)

    def digests(self, tokens: np.ndarray) -> tuple[str, str]:
        """Of a text's ids in decimal form, and of what they decode to."""
        shown, decoded, state = hashlib.sha256(), hashlib.sha256(), self._start
        for share in _shares(len(tokens)):
            signs = self._shown[tokens[share]].view(np.uint8)
            shown.update(signs[signs != 0][not share.start :])  # the text begins with no space
            text, state = self._decode_on(self.ids(tokens[share]).tolist(), state)
            decoded.update(text.encode())
        decoded.update("\N{REPLACEMENT CHARACTER}".encode() * bool(state.held))
        return shown.hexdigest(), decoded.hexdigest()


class Waiting(dict):
    """A state of the decoder: the bytes that wait, and for each token met so far the text that it completes and the state after it."""

    def __init__(self, codec: ByteBpe, held: bytes):
        super().__init__()
        self.codec, self.held = codec, held

    def __missing__(self, i: int) -> tuple[str, Waiting]:
        utf8 = Utf8Stream()
        utf8.feed(self.held)
        self[i] = move = utf8.feed(self.codec.bytes_of[i]), self.codec._waiting(bytes(utf8.held))
        return move


class Utf8Stream:
    """An incremental UTF-8 state machine.

    Its state is how many continuation bytes are due and the range that the
    next one must be in; bytes of an incomplete character wait for the rest.
    """

    #: First byte: from, to, continuation bytes due, range of the next byte. Fixed values of the encoding.
    FIRST = (
        (0x00, 0x7F, 0, 0x80, 0xBF), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
    )

    def __init__(self):
        self.due, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(self.held.decode("utf-8"))
                        self.held.clear()
                    continue
                out.append("�")
                self.held.clear()
                self.due = 0
            for first, last, due, low, high in self.FIRST:
                if first <= b <= last:
                    if due:
                        self.due, self.low, self.high = due, low, high
                        self.held.append(b)
                    else:
                        out.append(chr(b))
                    break
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        cut_off = "�" if self.due else ""
        self.due = 0
        self.held.clear()
        return cut_off


def _codec(rank_lines: bytes, pattern: str) -> ByteBpe:
    return resident(("byte-bpe", rank_lines, pattern), lambda: ByteBpe(rank_lines, pattern))


def _shipped(docs: DataFrame, ranks_path: str):
    """The vocabulary file's bytes, of fixed size, for every executor."""
    with open(ranks_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` for its column ``text``."""
    lines = _shipped(docs, ranks_path)

    def make():
        codec = _codec(lines.value, pattern)

        def find(texts):
            ids = list(map(codec.ids, codec.encode_all(t or "" for t in texts)))
            return [len(x) for x in ids], ids

        return find

    return with_found(docs, [c for c in docs.columns if c.lower() not in ("n_tokens", "ids")], make, {"n_tokens": "long", "ids": "array<int>"})


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its column ``ids`` (null: null)."""
    lines = _shipped(encoded, ranks_path)

    def make():
        codec = _codec(lines.value, r"\s+|\S+")
        return lambda lists: [[None if x is None else codec.decode_bytes(x) for x in lists]]

    return with_found(encoded, [c for c in encoded.columns if c.lower() != "decoded"], make, {"decoded": "binary"}, source="ids")


def round_trip_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """op9: doc_id, n_tokens, ids_sha256, decoded_sha256; ids do not leave the worker."""
    lines = _shipped(docs, ranks_path)

    def make():
        codec = _codec(lines.value, pattern)

        def find(texts):
            rows = [(len(tokens), *codec.digests(tokens)) for tokens in codec.encode_all(t or "" for t in texts)]
            return tuple(zip(*rows)) or ((), (), ())

        return find

    return with_found(docs, ["doc_id"], make, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
