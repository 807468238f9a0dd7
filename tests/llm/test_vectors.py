"""Vector operators against plain Python, with odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillgraph.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v string, block string"


def _rows(count, dims=4, seed=1, spread=0.3):
    chance = random.Random(seed)
    middles = [[chance.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(k, [x + chance.gauss(0, spread) for x in chance.choice(middles)], chance.randrange(4), "a", "b", "c") for k in range(count)]


def _odd(dims=4):
    """Rows that take no part."""
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * (dims + 1), [None] + [1.0] * (dims - 1), [nan] + [1.0] * (dims - 1), [-inf] + [1.0] * (dims - 1)]
    return [(1000 + k, v, 1, None, None, None) for k, v in enumerate(bad)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _whole(rows, dims=4):
    ok = [(r[0], np.array(r[1], np.float32)) for r in rows if r[1] is not None and len(r[1]) == dims and None not in r[1] and all(math.isfinite(x) for x in r[1])]
    return [(i, [math.floor(256 * float(x)) for x in v]) for i, v in ok]


def _plain_clusters(rows, dims, count, rounds):
    kept = _whole(rows, dims)
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:count]
    middle = [v for _, v in first]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((apart(v, c), k) for k, c in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for k, own in groups.items():
            middle[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *reversed(near(v))) for i, v in kept]
    total = sum(d for *_, d in last)
    within = {k: sum(d for _, j, d in last if j == k) for _, k, _ in last}
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted([(i, k, d, within[k], total, shown[k]) for i, k, d in last], key=str)


@pytest.mark.parametrize("count", [3, 12, 500])
def test_clusters(spark, count):
    rows = _rows(150)
    rows += [*_odd(), rows[0], rows[0], (rows[3][0], [0.5, 0.5, 0.5, 0.5], None, None, None, None), (None, [0.25, 0.5, -0.5, 1.0], None, None, None, None)]
    got = centroids.cluster(_frame(spark, rows), size=4, count=count, rounds=3, pivots=3)
    assert sorted(map(tuple, got.collect()), key=str) == _plain_clusters(rows, 4, count, 3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_nothing(spark):
    for rows in ([], _odd()):
        assert centroids.cluster(spark.createDataFrame(rows, SCHEMA), size=4).count() == 0


def test_a_component_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(_frame(spark, [(1, [1e9, 0.0, 0.0, 0.0], 1, "a", "b", "c")]), size=4).collect()


def test_pivots_leave_few_centroids_on_grouped_vectors():
    chance = np.random.default_rng(0)
    middles = chance.integers(-2000, 2000, (40, 16))
    v = (middles[chance.integers(0, 40, 4000)] + chance.integers(-20, 20, (4000, 16))).astype(np.int64)
    points = centroids.pivots_of(v[:200], 8)
    cluster, best, taken = centroids.assign(v, centroids.distances(v, points), middles, centroids.distances(middles, points))
    exact = ((v[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (best == exact.min(axis=1)).all() and (cluster == exact.argmin(axis=1)).all()
    assert taken < 0.1 * exact.size


def _plain_negatives(rows, every, dims=4):
    labels = {i: (r[2] + 1) % 10 if i % 7 == 0 else r[2] for r in rows if (i := r[0]) is not None and r[2] is not None}
    own = {}
    for (i, v), r in zip(_whole(rows, dims), [r for r in rows if r[0] in {j for j, _ in _whole(rows, dims)}], strict=False):
        if i in labels and (i not in own or v < own[i]):
            own[i] = v
    out = []
    for a in (i for i in own if i % every == 0):
        score = {i: sum(x * y for x, y in zip(own[a], own[i], strict=True)) for i in own if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if labels[i] == labels[a]][:5]:
            fits = [i for i in best if labels[i] != labels[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "block_rows"), [(1000, 1024), (7, 16), (1, 1)])
def test_hard_negatives(spark, chunk, block_rows, monkeypatch):
    from quillgraph.llm import hard_negatives as hard

    monkeypatch.setattr(hard, "PROBES", 2)
    rows = _rows(120 if chunk > 1 else 30, spread=0.6)
    rows += [*_odd(), (500, [0.1, 0.2, 0.3, 0.4], None, "a", "b", "c"), (None, [0.1, 0.2, 0.3, 0.4], 1, "a", "b", "c"), (15, [-0.9, 0.2, 0.3, 0.4], rows[15][2], "a", "b", "c"), rows[20], rows[20]]
    label = hard.F.when(hard.F.col("vec_id") % 7 == 0, (hard.F.col("label") + 1) % 10).otherwise(hard.F.col("label"))
    frame = _frame(spark, rows).withColumn("label", label)
    got = hard.mine(frame, hard.F.col("vec_id") % 5 == 0, chunk=chunk, block_rows=block_rows)
    want = _plain_negatives(rows, 5)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    assert hard.mine(frame.limit(0), hard.F.col("vec_id") % 5 == 0).count() == 0
    assert hard.hard_negatives(_frame(spark, _odd())).count() == 0


def test_hilbert_keys_visit_neighbours():
    from quillgraph.llm.hard_negatives import hilbert_keys, reach

    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    chance = np.random.default_rng(2)
    v, points = chance.integers(-9, 9, (6, 5)), chance.integers(-9, 9, (30, 5))
    least, greatest = reach(v, points.min(axis=0)[None], points.max(axis=0)[None])
    assert (least <= v @ points.T).all() and (greatest >= v @ points.T).all()


def test_zone_maps_leave_blocks_unread(spark):
    from quillgraph.llm import hard_negatives as hard

    chance = np.random.default_rng(5)
    middles = chance.normal(0, 1, (40, 8))
    rows = [(k, (middles[k % 40] + chance.normal(0, 0.02, 8)).tolist(), k % 4, "a", "b", "c") for k in range(4000)]
    blocks = hard.in_blocks(hard.usable(_frame(spark, rows)), 32)
    zones = hard.zone_maps(blocks)
    ids, labels, v = next(hard._chunks(blocks.filter("vec_id = 50"), 10))
    asked = hard.Asked(ids, labels, v, np.array([[0]]), np.array([[hard.MOST]]), ids, True, 5)
    asked.floor[:] = int(v[0] @ v[0] * 0.95)
    read = hard._needed(blocks, zones, spark.sparkContext.broadcast(asked)).count()
    assert 5 <= read < 0.2 * blocks.filter(f"label = {labels[0]}").count()
