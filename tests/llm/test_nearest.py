"""Probes of the nearest search."""

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import nearest


def test_probes_stay_few_on_spread_vectors_and_far_queries_meet_all_rows(spark):
    chance = np.random.default_rng(4)
    spread = chance.normal(size=(12_000, 24))
    spread /= np.linalg.norm(spread, axis=1)[:, None]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(spread)], "vec_id long, v array<double>")
    hashes = nearest.fit(frame, 20, 0.93, 2)
    assert max(len(hashes.probes(p[0], hashes.near, hashes.need)) for p in hashes.places(spread[:50], False)) <= 16
    # Tight groups make narrow buckets; from far off, all of them are as likely.
    groups = np.repeat(chance.normal(size=(6, 24)), 60, axis=0) + chance.normal(size=(360, 24)) * 1e-3
    far = chance.normal(size=(6, 24))
    rows = np.concatenate([groups, far])
    narrow = nearest.Hashes(chance.normal(size=(2, 8, 25)), chance.random((2, 8)), 0.06, 1.0, 0.03, 0.7)
    assert narrow.probes(narrow.places(far[:1] / 9, False)[0, 0], 2.0, 0.7) is None
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, v array<double>")
    narrow.longest = float(np.linalg.norm(rows, axis=1).max())
    asks = frame.filter("vec_id >= 360").withColumns({"floor": F.lit(None).cast("double"), "kth": F.lit(-1.0)})
    asked = nearest._probe(asks, narrow, True)
    assert [r["bucket"] for r in asked.collect()] == [nearest.EVERY] * 6
    found = nearest._met(nearest._index(frame, narrow), asked, frame, 10).collect()
    for q in range(360, 366):
        score = rows @ rows[q]
        score[q] = -np.inf
        want = np.argsort(-score, kind="stable")[:10]
        assert sorted(r["vec_id"] for r in found if r["query_id"] == q) == sorted(want.tolist())
