"""Graph measures, previews, merges and checked joins against plain Python."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import checks as C
from quillgraph.operators import graph as G

EDGE = "src string, dst string, relation string"


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, "r") for a, b in pairs], EDGE)


def _paths(near, s):
    dist, paths, queue = {s: 0}, {s: 1}, deque([s])
    while queue:
        v = queue.popleft()
        for w in near[v]:
            if w not in dist:
                dist[w], paths[w] = dist[v] + 1, 0
                queue.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
    return dist, paths


def test_components_of_chains_rings_and_loops(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    pairs = chain + [("x", "y"), ("y", "z"), ("z", "x"), ("alone", "alone"), ("x", "y")]
    found = {r["node_id"]: r["component"] for r in G.components(_edges(spark, pairs)).collect()}
    assert found == {**{f"c{i:03d}": "c000" for i in range(61)}, "x": "x", "y": "x", "z": "x", "alone": "alone"}
    assert G.components(_edges(spark, [])).collect() == []


def test_centralities_with_rings(spark):
    pick = random.Random(5)
    names = [f"n{i}" for i in range(12)]
    pairs = [p for p in itertools.combinations(names[:9], 2) if pick.random() < 0.35] + [("n9", "n10"), ("n10", "n11"), ("n0", "n1")]
    nodes = sorted({v for p in pairs for v in p})
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in nodes}
    all_ = {v: _paths(near, v) for v in nodes}
    n = len(nodes)
    for row in G.centralities(_edges(spark, pairs)).collect():
        v, (dist, _) = row["node_id"], all_[row["node_id"]]
        r, far = len(dist) - 1, sum(dist.values())
        assert row["closeness"] == pytest.approx(r * r / far / (n - 1) if far else 0, abs=1e-8)
        through = 0
        for s, t in itertools.permutations([u for u in nodes if u != v], 2):
            (ds, ps), (dv, pv) = all_[s], all_[v]
            if t in ds and v in ds and ds[v] + dv[t] == ds[t]:
                through += ps[v] * pv[t] / ps[t]
        assert row["betweenness"] == pytest.approx(through / (n - 1) / (n - 2), abs=1e-8)


def _preview(text, limit):
    out, used = [], 0
    for p in [q.strip() for q in (text or "").split("\n") if q.strip()]:
        left = limit - used
        if left <= 0:
            return out, True
        if len(p) <= left:
            out.append(p)
            used += len(p)
        else:
            cut = p[:left]
            at = cut.rfind(" ")
            return out + [(cut[:at] if at > 40 else cut).rstrip() + "…"], True
    return out, False


def test_preview(spark):
    texts = [None, "", " \n\n", "one\n two \n", "a" * 90, "word " * 40, "x" * 60 + "\n" + "y", "é " * 45, "short\n" + "long words here " * 9, "a" * 41 + " " + "b" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in rows.select("text", X.preview(F.col("text"), 60).alias("p")).collect():
        assert (r["p"]["paragraphs"], r["p"]["truncated"]) == _preview(r["text"], 60)


def test_merges_and_joins_fail_on_conflict(spark):
    same = spark.createDataFrame([("a", "stock", "A", 1), ("a", "stock", "A", 0)], "node_id string, node_type string, name string, place int")
    assert [tuple(r) for r in G.merge_nodes(same).collect()] == [("a", "stock", "A")]
    with pytest.raises(Exception, match="two types or names"):
        G.merge_nodes(same.union(spark.createDataFrame([("a", "news", "A", 2)], same.schema))).collect()
    edges = spark.createDataFrame([("e", "x", 1), ("e", "x", 1)], "edge_id string, src string, w int")
    assert [tuple(r) for r in G.merge_edges(edges).collect()] == [("e", "x", 1)]
    with pytest.raises(Exception, match="rows that differ"):
        G.merge_edges(edges.union(spark.createDataFrame([("e", "x", 2)], edges.schema))).collect()
    left = spark.createDataFrame([(1, "p")], "k int, v string")
    right = spark.createDataFrame([(1, "q")], "k int, v string")
    assert C.one_to_one(left, right, "k").first().asDict() == {"k": 1, "v": "p", "v_right": "q"}
    with pytest.raises(Exception, match="repeated key"):
        C.one_to_one(left, right.union(right), "k").collect()
    with pytest.raises(Exception, match="without a match"):
        C.one_to_one(left, right.filter("k > 1"), "k").collect()


def test_set_comparison_and_empty_tallies(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 2, 2], [2, 3]))
    assert C.compare_sets(a, b, "k").first().asDict() == {"common": 1, "only_one": 1, "only_two": 1, "differ": 2, "equal": False}
    got = C.tally(a.filter("k > 9"), "c", {"odd": F.col("k") == 1}).first()
    assert (got["observed"], got["status"]) == (0, "PASS")


def test_hanging_trees_make_no_pairs(spark):
    """A star's pairs are counted by sizes, and rings with trees on them keep their exact measures."""
    star = _edges(spark, [("hub", f"s{i:04d}") for i in range(3000)])
    ways, nodes, rounds = G._pruned(star)
    assert (ways.count(), nodes.count(), [r.count() for r in rounds]) == (0, 1, [3000])
    found = {r["node_id"]: (r["closeness"], r["betweenness"]) for r in G.centralities(star).collect()}
    assert found["hub"] == (1.0, 1.0) and found["s0007"] == (pytest.approx(3000 / 5999, abs=1e-9), 0.0) and len(found) == 3001
    pairs = [("r0", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r0"), ("r0", "r2"), ("r1", "t1"), ("t1", "t2"), ("t1", "t3"), ("t3", "t4"), ("r3", "u"), ("p", "q"), ("o", "o"), ("x", "y"), ("y", "z")]
    nodes = sorted({v for p in pairs for v in p})
    near = {v: ({b for a, b in pairs if a == v} | {a for a, b in pairs if b == v}) - {v} for v in nodes}
    all_, n = {v: _paths(near, v) for v in nodes}, len(nodes)
    rows = G.centralities(_edges(spark, pairs)).collect()
    assert sorted(r["node_id"] for r in rows) == nodes
    for row in rows:
        v, (dist, _) = row["node_id"], all_[row["node_id"]]
        r, far = len(dist) - 1, sum(dist.values())
        assert row["closeness"] == pytest.approx(r * r / far / (n - 1) if far else 0, abs=1e-8)
        through = sum(all_[s][1][v] * all_[v][1][t] / all_[s][1][t] for s, t in itertools.permutations([u for u in nodes if u != v], 2) if t in all_[s][0] and v in all_[s][0] and all_[s][0][v] + all_[v][0][t] == all_[s][0][t])
        assert row["betweenness"] == pytest.approx(through / (n - 1) / (n - 2), abs=1e-8)
