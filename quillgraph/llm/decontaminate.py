"""Benchmark decontamination by pigeonhole edit matching.

A test item of n signs may differ in k = n * error_rate edits. Cut into k + 1
pieces, at least one piece stands in any such match unchanged. All pieces of all
items are searched at once (Aho-Corasick); around each hit Myers' bit-parallel
distance decides whether the whole item lies there within k edits. Pieces of
short items are short and hit more often, which costs time and no match. Texts are
compared in lower case with runs of white space as one blank.

The items are the query set. They go to the tasks in blocks of bounded size
(``block_chars``): a larger benchmark means more passes over all documents. Each
pass is written and its block freed before the next, so that the driver holds
one block and a worker the automaton of one.

Defined cases: null and empty items and texts match nothing. Whole texts are
searched, however long. Equal items match
alike, each under its own item_id; rows that repeat an item_id with other texts
are items of their own. Of an item's matches in a document the nearest counts,
then the first. Each document row is searched by itself, so repeated rows and
null ids pass through, and so do their columns. Empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, each_found, only, resident

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, error_rate: float = ERROR_RATE) -> int:
    return int(n * error_rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    ends = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def myers(item: str, text: str, k: int) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to any part of ``text`` if at most ``k``, with the first end where it holds."""
    m = len(item)
    masks: dict[str, int] = {}
    for j, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << j
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(across | up)), up & across
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        diagonal = eq | down
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
        if distance <= k and (best is None or distance < best[0]):
            best = (distance, at + 1)
    return best


class Finder:
    def __init__(self, items: tuple[tuple[int, str], ...], error_rate: float):
        self.items = [(i, t, budget(len(t), error_rate)) for i, t in items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                owners.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Item number: (distance, end in the normalised text)."""
        text = normal(text)
        if not self.items or not text:
            return {}
        where: dict[int, set[int]] = {}
        for end, (size, own) in self.automaton.iter(text):
            for number, offset in own:
                where.setdefault(number, set()).add(end + 1 - size - offset)
        out: dict[int, tuple[int, int]] = {}
        for number, starts in where.items():
            _, item, k = self.items[number]
            reach = None
            windows: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(text), s + len(item) + k)
                if reach is not None and a <= reach:
                    windows[-1][1] = max(windows[-1][1], b)
                else:
                    windows.append([a, b])
                reach = windows[-1][1]
            for a, b in windows:
                found = (0, text.index(item, a, b) + len(item) - a) if item in text[a:b] else myers(item, text[a:b], k)
                if found and (number not in out or found[0] < out[number][0]):
                    out[number] = (found[0], a + found[1])
        return out


def _finder(items: tuple[tuple[int, str], ...], error_rate: float) -> Finder:
    return resident(("finder", items, error_rate), lambda: Finder(items, error_rate))


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items in blocks of about ``block_chars`` signs; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter(F.length("text") > 0).orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        block.append((row["item_id"], text))
        size += len(text)
        if size >= block_chars:
            yield tuple(block)
            block, size = [], 0
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """op7: doc_id, item_id, distance, item_length, end for each benchmark item found in a row of ``docs``."""
    context, out, blocks = docs.sparkSession.sparkContext, None, _blocks(benchmark, block_chars)
    block = next(blocks, ())
    while True:
        sent = context.broadcast(block)  # bounded by block_chars

        def make(sent=sent):
            finder = _finder(sent.value, error_rate)

            def find(texts):
                rows = [(k, number, distance, len(finder.items[number][1]), end) for k, text in enumerate(texts) for number, (distance, end) in sorted(finder.find(text).items())]
                return tuple(zip(*rows)) or ((), (), (), (), ())

            return find

        found = each_found(docs, ["doc_id"], make, {"item": "int", "distance": "int", "item_length": "int", "end": "int"})
        # Items go by their place in the block; their ids, of whatever type, come back by a join with as many rows.
        ids = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item int, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
        found = found.join(F.broadcast(ids), "item").select("doc_id", "item_id", "distance", "item_length", "end")
        block = next(blocks, None)
        if block is None:
            return found if out is None else out.unionByName(found)
        found = cut(found, "leaks")
        sent.destroy()
        out = found if out is None else out.unionByName(found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, each judged by its own text, that hold no benchmark item."""
    blocks = _blocks(benchmark, block_chars)
    block = next(blocks, ())
    while True:
        sent = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_chars

        def make(sent=sent):
            finder = _finder(sent.value, error_rate)
            return lambda texts: [not finder.find(t) for t in texts]

        docs, block = only(docs, make), next(blocks, None)
        if block is None:
            return docs
        docs = cut(docs, "without-leaks")
        sent.destroy()
