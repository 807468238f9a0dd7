"""The learning stages against plain Python."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import learning as L


def test_word_parts(spark):
    def plain(text):
        return [w[i : i + n] for v in text.lower().split() for w in [f" {v} "] for n in (3, 4, 5) for i in range(len(w) - n + 1)]

    texts = ["A bc  Def", "", "  ", "lãi\ttăng"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(L.word_parts(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in found] == [plain(t) for t in texts]


def test_terms(spark):
    texts = ["cat cat hat", "hat bat", "cat mat", "zzz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    tf = [Counter(w[i : i + n] for v in t.split() for w in [f" {v} "] for n in (3, 4, 5) for i in range(len(w) - n + 1)) for t in texts]
    df = Counter(k for c in tf for k in c)
    want = {}
    for i, c in enumerate(tf):
        w = {k: (1 + math.log(v)) * (math.log(5 / (1 + df[k])) + 1) for k, v in c.items() if df[k] > 1}
        want |= {(i, k): x / math.sqrt(sum(y * y for y in w.values())) for k, x in w.items()}
    found = {(r["id"], r["name"]): r["value"] for r in L.term_features(rows, "t", L.fit_terms(rows, "t")).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k]) for k in want)
    assert L.fit_terms(rows, "t", most_terms=3).count() == 3


def test_linear_at_its_optimum(spark):
    """The gradient of the penalised, balanced loss vanishes at the fitted weights."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 2))
    y = (x @ [[1, -1, 0], [0, 1, -1]] + rng.normal(size=(120, 3))).argmax(1)
    rows = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x.tolist(), y.tolist()))], "id long, a double, b double, label double")
    blocks = L.number_features(rows, rows, ["a", "b"])
    places, size = L.numbered(blocks)
    described = L.vectors(rows, blocks, places, size)
    assert "Python" not in described._jdf.queryExecution().executedPlan().toString()
    model = L.fit_linear(described, "label")
    order = [r["name"] for r in places.orderBy("place").collect()]
    assert [r["place"] for r in places.orderBy("place").collect()] == [0, 1] and size == 2
    z = ((x - x.mean(0)) / x.std(0))[:, ["ab".index(n) for n in order]]
    weights, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    score = z @ weights.T + start
    p = np.exp(score - score.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    w = len(y) / (3 * np.bincount(y))[y]
    error = (p - np.eye(3)[y]) * w[:, None]
    assert np.abs(error.T @ z + weights).max() < 0.05 and np.abs(error.sum(0)).max() < 0.05


def test_predict(spark):
    rows = spark.createDataFrame([(i, "up gain" if i % 3 else "down loss", "x" if i % 3 else "y", float(i % 3 > 0)) for i in range(60)], "id long, t string, c string, label double")
    new = spark.createDataFrame([(100, "gain", "never seen", 1.0), (101, "loss", "y", 0.0), (102, "", "x", 1.0)], rows.schema)
    found = {r["id"]: r["predicted"] for r in L.predict(rows, new, "label", text="t", categories=["c"]).collect()}
    assert found == {100: 1, 101: 0, 102: 1}
    assert {r["predicted"] for r in L.predict(rows, new, "label").collect()} == {1.0}


def test_copies_count_as_rows(spark):
    """Texts and rows that stand for many give what the many give."""
    texts = ["cat cat hat", "hat bat", "cat mat", "zzz"]
    many = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 3)], "id long, t string")
    once = spark.createDataFrame([(k, t, 3) for k, t in enumerate(texts)], "id long, t string, k long")
    fitted = [sorted(map(tuple, f.collect())) for f in (L.fit_terms(many, "t"), L.fit_terms(once, "t", copies="k"))]
    assert [a for a, _ in fitted[0]] == [a for a, _ in fitted[1]] and np.allclose([b for _, b in fitted[0]], [b for _, b in fitted[1]])
    rows = spark.createDataFrame([(k, float(k % 3), float(k % 3 > 0)) for k in range(12)], "id long, a double, label double")
    half = rows.filter("id < 6").withColumn("copies", F.lit(2))
    models = []
    for some, k in ((rows, None), (half, "copies")):
        blocks = L.number_features(some, rows, ["a"])
        models.append(L.fit_linear(L.vectors(some, blocks, *L.numbered(blocks)), "label", copies=k))
    assert np.allclose(models[0].coefficientMatrix.toArray(), models[1].coefficientMatrix.toArray(), atol=1e-6)


def test_terms_of_dealt_rows_are_not_shuffled(spark):
    """Only the rows themselves are dealt by id; their parts stay there."""
    rows = spark.createDataFrame([(k, f"some text {k}") for k in range(40)], "id long, t string").repartition(12, "id")
    found = L.term_features(rows, "t", spark.createDataFrame([(" so", 2.0)], "name string, idf double"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and found.count() == 40
