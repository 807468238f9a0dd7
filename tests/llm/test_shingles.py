"""Parts of the n-gram join that need no Spark."""

import re

import numpy as np
import pytest

from quillgraph.llm import ngram_join as nj


@pytest.mark.parametrize("at_once", [1, 3, 100_000])
def test_shingles(monkeypatch, at_once):
    monkeypatch.setattr(nj, "WORDS_AT_ONCE", at_once)
    seen = {}
    for text in (None, "", " \n ", "A", "a b", "é Ü\xa0b\x85c A\x0bB\x1cc d", "x " * 30, "ab ba ab\0 ab a b " * 3, "W" * 500 + " end of it"):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        plain = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
        found = nj.shingles(text, 3)
        assert len(found) == len(plain)
        seen.update(dict.fromkeys(plain))
        assert found.tolist() == sorted(set(found.tolist()))
    assert nj.shingles("A b  C", 3).tolist() == nj.shingles("a\tB c\n", 3).tolist()


def test_nearest_pairs_all_or_a_forest(monkeypatch):
    n = 6
    block = {"cls": np.arange(n), "component": np.arange(n), "n": np.full(n, 100), "side": np.full(n, 2), "bits": np.array([None] * n)}
    for k in range(n):
        block["bits"][k] = np.zeros(2, np.int64)
    rule = nj.Rule(3, 90, 100)
    pairs, complete = nj._nearest(block, set(), rule, 1)
    assert complete and set(pairs) == {(a, b) for a in range(n) for b in range(a + 1, n)}
    monkeypatch.setattr(nj, "ALL_PER_ROW", 0)
    pairs, complete = nj._nearest(block, {(0, 1)}, rule, 1)
    assert not complete and (0, 1) not in pairs and n - 1 <= len(pairs) < n * (n - 1) // 2
