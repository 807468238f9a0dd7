"""Token counts by a compiled finite-state tokenizer.

The merges of a word-level BPE vocabulary (each word ends in a symbol of its
own) become a transducer whose transitions carry the number of tokens that
become certain (transducer.py). The splitting into words is an automaton of
three states at a cut: outside any word, in a run of letters, in a run of other
signs. Every text is cut into chunks. A chunk maps each of these states to the
state at its end, the tokens counted inside, and the open pieces at both ends.
Such maps compose, and a prefix scan over the chunks, in rounds whose steps do
not depend on each other, gives the total. All chunks of one text are scanned
in the task that has its row.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens. Strings of
special tokens inside a text are one token each. Each row is counted by itself,
so repeated rows and null ids pass through. Other columns do not enter. An empty
table gives an empty table.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from quillgraph.llm.common import with_found
from quillgraph.llm.transducer import CountingTransducer

CHUNK = 1 << 12
CACHED_WORDS, CACHED_LENGTH = 250_000, 48
OUTSIDE, LETTERS, OTHER = 0, 1, 2
END = 0x100  # added to a byte: the same byte as the last of its word


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordCounter:
    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, signs = spec["model"], byte_signs()
        suffix = model["end_of_word_suffix"]

        def symbols(token: str) -> str:
            ends = token.endswith(suffix) and token != suffix
            out = [chr(signs[c]) for c in (token[: -len(suffix)] if ends else token)]
            if ends:
                out[-1] = chr(ord(out[-1]) + END)
            return "".join(out)

        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        words = {symbols(t): i for t, i in model["vocab"].items() if t not in special}
        merges = {tuple(map(symbols, m)): k for k, m in enumerate(model["merges"])}
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.letters, self.other, self.gap = regex.compile(r"\p{L}*"), regex.compile(r"[^\s\p{L}\p{N}]*"), regex.compile(r"\s")
        self.machine = CountingTransducer(words, lambda a, b: merges.get((a, b)))
        self._kept = lru_cache(CACHED_WORDS)(self._count)

    def _count(self, word: str) -> int:
        data = word.encode("utf-8")
        return self.machine.count(data[:-1].decode("latin-1") + chr(data[-1] + END))

    def word(self, word: str) -> int:
        return self._kept(word) if len(word) <= CACHED_LENGTH else self._count(word)

    def normal(self, text: str) -> str:
        """NFC, then lower case sign by sign (no final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunk_map(self, chunk: str) -> list[tuple[str, bool, int, str, int]]:
        """For each state at its start: piece that continues the open word, whether that is the whole chunk, tokens inside, open word at the end, state there."""
        # Behind the first gap the state at the start makes no difference.
        gap = self.gap.search(chunk)
        near, beyond = (chunk[: gap.start()], chunk[gap.start() :]) if gap else (chunk, "")
        count, tail, end = self._closed(beyond)
        out = []
        for state in (OUTSIDE, LETTERS, OTHER):
            run = (None, self.letters, self.other)[state]
            head = run.match(near)[0] if run else ""
            if len(head) == len(chunk):
                out.append((head, True, 0, "", state))
            elif beyond:
                out.append((head, False, sum(map(self.word, self.words.findall(near[len(head) :]))) + count, tail, end))
            else:
                out.append((head, False, *self._closed(near[len(head) :])))
        return out

    def _closed(self, text: str) -> tuple[int, str, int]:
        """Tokens of all words but an open one at the end, that word, the state there."""
        words, tail, end = self.words.findall(text), "", OUTSIDE
        if words and text.endswith(words[-1]):
            end = LETTERS if self.letters.fullmatch(words[-1]) else OTHER if self.other.fullmatch(words[-1]) else OUTSIDE
            if end:
                tail = words.pop()
        return sum(map(self.word, words)), tail, end

    def then(self, first: list, second: list) -> list:
        """The map of two neighbouring chunks."""
        out = []
        for head, through, count, tail, end in first:
            more, on, inside, open_, last = second[end]
            if through:
                out.append((head + more, on, inside, open_, last))
            elif on:
                out.append((head, False, count, tail + more, last))
            else:
                word = tail + more
                out.append((head, False, count + (self.word(word) if word else 0) + inside, open_, last))
        return out

    def scan(self, maps: list) -> list:
        """Inclusive prefix scan: each round composes maps twice as far apart; the pairs of a round do not depend on each other."""
        step, maps = 1, list(maps)
        while step < len(maps):
            maps = [m if k < step else self.then(maps[k - step], m) for k, m in enumerate(maps)]
            step *= 2
        return maps

    def chunks(self, text: str, size: int) -> list[str]:
        """Cuts of about ``size``, never just after an apostrophe, whose reading depends on what follows."""
        out, at = [], 0
        while at < len(text):
            end = min(at + size, len(text))
            while end < len(text) and "'" in text[max(at, end - 3) : end]:
                end += 1
            out.append(text[at:end])
            at = end
        return out

    def count(self, text: str, size: int = CHUNK) -> int:
        parts = self.special.split(text)
        total = len(parts) - 1
        for part in filter(None, map(self.normal, parts)):
            *_, count, tail, _ = self.scan([self.chunk_map(c) for c in self.chunks(part, size)])[-1][OUTSIDE]
            total += count + (self.word(tail) if tail else 0)
        return total


@lru_cache(2)
def _counter(vocabulary: str) -> WordCounter:
    return WordCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048) -> DataFrame:
    """op3: doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        counter = _counter(vocabulary.value)

        def find(texts):
            counts = [counter.count(t or "") for t in texts]
            return [len((t or "").encode()) for t in texts], counts, [n > limit for n in counts]

        return find

    return with_found(docs, ["doc_id"], make, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"})
