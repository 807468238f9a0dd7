"""Edges of cliques without their pairs, against the pairs."""

from pyspark.sql import functions as F

from quillgraph.operators import releases as R
from quillgraph.sources import tables as S


def test_cliques_count_as_their_pairs(spark):
    cliques = spark.createDataFrame([("RELATED_TO", c, k, f"stock:{k}") for k, c in enumerate("aaaabbbc")], "relation_type string, clique string, place long, node_id string")
    a, b = cliques.alias("a"), cliques.alias("b")
    pairs = a.join(b, F.expr("a.clique = b.clique and a.place < b.place")).select(F.col("a.node_id").alias("source_node_id"), "a.relation_type", F.col("b.node_id").alias("target_node_id"))
    told = spark.createDataFrame([("news:1", "MENTIONS", "stock:0"), ("stock:1", "BELONGS_TO_INDUSTRY", "industry:a")], pairs.schema)
    chain = R.chained(cliques)
    assert chain.count() == 5 and chain.agg(F.sum("copies")).first()[0] == pairs.count() == 9
    for end in ("source_node_id", "target_node_id"):
        assert {r[0] for r in chain.select(end).collect()} == {r[0] for r in pairs.select(end).collect()}
    assert sorted(map(str, R.layer_counts(told, cliques).collect())) == sorted(map(str, R.layer_counts(told.unionByName(pairs)).collect()))
    nodes = spark.createDataFrame([(f"stock:{k}",) for k in (0, 2, 5, 7)], "node_id string")
    lost = [ends.agg(metric.value).first()[0] for _, ends, metric in (R._without_end("x", pairs, nodes), R._without_end("x", pairs.limit(0), nodes, cliques))]
    assert lost[0] == lost[1] == 10


def test_mentions_are_dealt_by_article_once(spark, sf_dir):
    plan = S.dated_mentions(spark, sf_dir).select("news_id", "sentiment").distinct()._jdf.queryExecution().executedPlan().toString()
    # Mentions and articles are dealt to their places; nothing follows by article that is dealt again.
    assert plan.count("Exchange hashpartitioning(news_id") <= 2


def test_questions_read_the_mentions_once(spark, sf_dir):
    """The answers over articles come from one pass that is written; only the symbols' question reads the mentions again."""
    from quillgraph.plans import QUERIES

    found = QUERIES["competency_questions"](spark, sf_dir)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("max(flag") <= 1
    assert {r["question"] for r in found.collect()} == {"CQ01", "CQ02", "CQ03", "CQ04", "CQ06", "CQ08", "CQ10"}


def test_sampled_betweenness_reads_its_edges_once(spark):
    """Its result stands on what was written, and not on the edges again."""
    from quillgraph.operators import graph as G

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "c"), ("c", "d")], "src string, dst string")
    found = G.sampled_betweenness(edges, 4)
    assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["node_id"]: round(r["betweenness"], 6) for r in found.collect()} == {"a": 0.0, "b": round(2 / 6, 6), "c": round(2 / 6, 6), "d": 0.0}
