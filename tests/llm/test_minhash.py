"""MinHash classes against all pairs of full sets."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import minhash, ngram_join
from quillgraph.llm.minhash import Tensor
from quillgraph.llm.ngram_join import Rule

SCHEMA = "doc_id long, text string, n_shingles string, component_id int, kept string, word string"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1, None, "w") for i, t in texts], SCHEMA).repartition(3)


def _brute(texts, words, num, den):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and den * len(a & b) >= num * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min((texts[i][0] for i in range(len(sets)) if root[i] == r and texts[i][0] is not None), default=None) for r in set(root)}
    own = [least[r] if s else texts[i][0] for i, (s, r) in enumerate(zip(sets, root, strict=True))]
    return sorted([(i, len(s), c, i == c) for (i, _), s, c in zip(texts, sets, own, strict=True)], key=str)


def _texts(seed):
    chance = random.Random(seed)
    texts = [None, "", "  \n", "One two", "one TWO", "one two three"]
    for n in (3, 4, 9, 40, 70, 120, 150, 400):
        words = [f"w{chance.randrange(4000)}" for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 8):
            copy = list(words)
            for _ in range(edits):
                copy[chance.randrange(n)] = f"n{chance.randrange(10**6)}"
            texts.append(" ".join(copy))
    return [*((10 * k, t) for k, t in enumerate(texts)), (40, texts[-1]), (40, texts[-1]), (None, texts[-1]), (None, "alone with no id at all"), (7, texts[20])]


def test_classes(spark):
    texts = _texts(5)
    got = minhash.near_duplicates(_docs(spark, texts))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == _brute(texts, 4, 80, 100)
    assert minhash.near_duplicates(_docs(spark, []).limit(0)).count() == 0


def test_large_groups_that_share_a_passage(spark, monkeypatch):
    """Groups beyond FEW, whose members share much without being linked, take the blocked way in several rounds."""
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "ALL_PER_ROW", 1)
    chance = random.Random(8)
    passage = [f"p{k}" for k in range(30)]
    texts = [(k, " ".join(passage + [f"q{chance.randrange(12)}" for _ in range(chance.randrange(4, 12))])) for k in range(80)]
    rule = Rule(2, 80, 100, 2.5)
    assert sorted(map(tuple, minhash.near_duplicates(_docs(spark, texts), rule).collect()), key=str) == _brute(texts, 2, 80, 100)
    got = ngram_join.jaccard_components(_docs(spark, texts), Rule(2, 80, 100)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(r[:3] for r in _brute(texts, 2, 80, 100))


def test_one_row_of_each_class_stays(spark):
    texts = _texts(6)
    docs = _docs(spark, texts)
    kept = minhash.without_near_duplicates(docs, minhash.WIDE)
    assert kept.schema == docs.schema
    want = [r for r in _brute(texts, 4, 80, 100) if r[3] or r[1] == 0]
    assert kept.count() == len(want) - sum(r[0] == 40 and r[3] for r in want) // 2
    assert kept.filter(F.col("doc_id").isNull()).count() == sum(r[0] is None for r in want)


def test_tables_from_few_hashes():
    tensor = Tensor()
    assert tensor.missed(0.8) < 2e-7 and 2 * tensor.groups * tensor.per_key == 64
    chance = np.random.default_rng(1)
    agree, trials = 0, 300
    for _ in range(trials):
        both, left, right = (chance.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        a, b = (minhash.minhashes(np.concatenate([both, x]), tensor) for x in (left, right))
        agree += (a == b).mean()
    assert abs(agree / trials - 0.8) < 0.02
