"""Typed graph tables and measures on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import stable_id
from quillgraph.sources.sinks import cut, forget


def edges_of(dated: DataFrame, dictionary: DataFrame) -> DataFrame:
    """src, dst, relation of the display graph: one row for each ordered pair and relation.

    The edges of an article are told apart where its mentions lie; only pairs of event and stock meet from afar.
    """
    news, stock = F.concat(F.lit("news_"), "news_id"), F.concat(F.lit("stock_"), "symbol")
    event, mood = F.concat(F.lit("event_"), "event_type"), F.concat(F.lit("sentiment_"), "sentiment")
    edge = lambda a, b, r: F.struct(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation"))
    own = F.array(edge(news, stock, "mentions"), edge(news, event, "contains_event"), edge(news, mood, "has_sentiment"))
    told = dated.select("news_id", F.explode(own).alias("e")).distinct().select("e.*")
    met = dated.select("event_type", "symbol").distinct().select(edge(event, stock, "affects").alias("e")).select("e.*")
    static = dictionary.select(stock.alias("src"), F.concat(F.lit("industry_"), "industry").alias("dst"), F.lit("belongs_to").alias("relation")).distinct()
    return told.unionByName(met).unionByName(static)


def density(edges: DataFrame) -> DataFrame:
    """nodes, edges and m / (n (n - 1)) of a directed graph."""
    n = nodes_of(edges).agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    # One row on either side.
    return n.join(F.broadcast(m)).select("nodes", "edges", F.round(F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 12).alias("density"))


def nodes_of(edges: DataFrame) -> DataFrame:
    ids = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return ids.withColumn("node_type", F.substring_index("node_id", "_", 1)).withColumn("name", F.expr("substring(node_id, instr(node_id, '_') + 1)"))


def with_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_id", stable_id("edge:", 24, F.col("src"), F.col("relation"), F.col("dst")))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(in + out) / (n - 1) for each node."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    n = ends.agg(F.count(F.lit(1)).alias("n"))
    # One row joins to all: the count of nodes.
    return ends.join(F.broadcast(n)).select("node_id", "degree", F.round(F.try_divide(F.col("degree"), F.col("n") - 1), 9).alias("centrality"))


def ego(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Edges among the nodes reached from ``seeds`` (node_id) by out-edges."""
    reached = front = seeds.select("node_id").distinct()
    for _ in range(hops):
        front = edges.join(front, edges["src"] == front["node_id"], "left_semi").select(F.col("dst").alias("node_id")).distinct()
        reached = reached.union(front).distinct()
    inside = edges.join(reached, edges["src"] == reached["node_id"], "left_semi")
    return inside.join(reached, inside["dst"] == reached["node_id"], "left_semi")


def same_industry(dictionary: DataFrame) -> DataFrame:
    """Pairs a < b of symbols of one industry: the definition asks for every pair."""
    a, b = dictionary.select(F.col("symbol").alias("a"), "industry"), dictionary.select(F.col("symbol").alias("b"), "industry")
    return a.join(b, "industry").filter("a < b")


def stock_features(edges: DataFrame) -> DataFrame:
    """Per stock: articles that mention it, positive and negative ones (two hops: article, sentiment) and their ratio.

    One aggregation by article gives its sentiments; the join is by article and
    the sums by stock combine before they are shuffled.
    """
    mood = edges.filter("relation = 'has_sentiment'").groupBy(F.col("src").alias("news")).agg(F.count_if(F.col("dst") == "sentiment_Positive").alias("p"), F.count_if(F.col("dst") == "sentiment_Negative").alias("m"))
    told = edges.filter("relation = 'mentions'").select(F.col("src").alias("news"), F.col("dst").alias("stock"))
    sums = told.join(mood, "news", "left").groupBy("stock").agg(F.count(F.lit(1)).alias("mention_frequency"), F.coalesce(F.sum("p"), F.lit(0)).alias("positive"), F.coalesce(F.sum("m"), F.lit(0)).alias("negative"))
    return sums.withColumn("ratio", F.round(F.col("positive") / (F.col("positive") + F.col("negative") + 0.001), 4))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Nodes one edge from ``node``, in either direction."""
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("node_id"))
    return out.union(edges.filter(F.col("dst") == node).select("src")).filter(F.col("node_id") != node).distinct()


def industry_subgraph(edges: DataFrame, industry: str) -> DataFrame:
    """Edges among an industry's node, its stocks and all out-neighbours of these."""
    top = f"industry_{industry}"
    members = edges.filter((F.col("relation") == "belongs_to") & (F.col("dst") == top)).select(F.col("src").alias("node_id"))
    seeds = members.union(edges.sparkSession.createDataFrame([(top,)], "node_id string"))
    return ego(edges, seeds, 1)


def missing_same_industry(dated: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pairs a < b of one article whose industries agree (two unknown ones agree), once each."""
    named = dated.join(dictionary.select("symbol", "industry"), "symbol", "left")
    a = named.select("news_id", F.col("symbol").alias("a"), F.col("industry").alias("_i"))
    b = named.select("news_id", F.col("symbol").alias("b"), F.col("industry").alias("_j"))
    return a.join(b, "news_id").filter("a < b and _i <=> _j").select("a", "b", F.col("_i").alias("industry")).distinct()


def contract_violations(edges: DataFrame, contract: dict[str, tuple[str, str]]) -> DataFrame:
    """relation, edges and those whose ends are not of the contract's types (relation: (type of src, type of dst)); an unknown relation violates."""
    ends = F.create_map(*[F.lit(x) for r, (s, t) in contract.items() for x in (r, f"{s}>{t}")])
    seen = F.concat_ws(">", F.substring_index("src", "_", 1), F.substring_index("dst", "_", 1))
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.count_if(~F.coalesce(ends[F.col("relation")] == seen, F.lit(False))).alias("violations"))


def merge_nodes(rows: DataFrame) -> DataFrame:
    """First write of each node_id (by ``place``); the job fails if two rows give it different types or names."""
    first = rows.groupBy("node_id").agg(F.min_by(F.struct("node_type", "name"), "place").alias("n"), F.count_distinct(F.struct("node_type", "name")).alias("k"))
    kept = F.when(F.col("k") == 1, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("node with two types or names: "), "node_id")))
    return first.select("node_id", kept.alias("n")).select("node_id", "n.node_type", "n.name")


def merge_edges(rows: DataFrame) -> DataFrame:
    """Equal rows of an edge_id as one; the job fails if one has rows that differ."""
    own = F.struct(*[c for c in rows.columns if c != "edge_id"])
    one = rows.groupBy("edge_id").agg(F.first(own).alias("e"), F.count_distinct(own).alias("k"))
    kept = F.when(F.col("k") == 1, F.col("e")).otherwise(F.raise_error(F.concat(F.lit("edge with rows that differ: "), "edge_id")))
    return one.select("edge_id", kept.alias("e")).select("edge_id", "e.*")


def _ways(edges: DataFrame) -> DataFrame:
    """Both directions of every edge between different nodes, once."""
    return edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).union(edges.select("dst", "src")).filter("v <> w").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node_id and component (its smallest node) of the graph without directions.

    Each round, every node takes the least label among its neighbours' and its
    own, and then the label of that label, so that long chains shorten by
    jumps. Each round is written; the loop ends when no label changes.
    """
    ways = cut(_ways(edges))
    labels = held = cut(nodes_of(edges).select("node_id", F.col("node_id").alias("component")))
    while True:
        heard = ways.join(labels, ways["w"] == labels["node_id"]).groupBy("v").agg(F.min("component").alias("heard"))
        near = labels.join(heard, labels["node_id"] == heard["v"], "left").select("node_id", F.col("component").alias("old"), F.least("component", F.coalesce("heard", "component")).alias("near"))
        # A label hears what its own bearers heard, so that whole groups move at once.
        best = near.groupBy(F.col("old").alias("_old")).agg(F.min("near").alias("best"))
        moved = near.join(best, near["old"] == best["_old"]).select("node_id", F.col("best").alias("component"), (F.col("best") != F.col("old")).alias("changed"))
        moved = cut(moved)
        forget(held)
        if moved.filter("changed").isEmpty():
            forget(ways)
            return moved.select("node_id", "component")
        labels, held = moved.select("node_id", "component"), moved


def _pruned(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Hanging trees taken off: both directions of the edges that are left, the nodes that are left, and the leaves of each round.

    Nodes: (v, size, inner, squares): how many nodes hang on v, itself included,
    the sum of their distances from v, and the sum of the squared sizes of the
    branches. Leaves also have ``up``, the node that they hang on. Each round
    takes all nodes of one neighbour (of two that have only each other, the
    greater) and is written; the loop ends when there is none.
    """
    ways = cut(_ways(edges))
    nodes = cut(nodes_of(edges).select(F.col("node_id").alias("v"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("inner"), F.lit(0.0).alias("squares")))
    rounds = []
    while True:
        ends = cut(ways.groupBy("v").agg(F.count(F.lit(1)).alias("k"), F.min("w").alias("up")).filter("k = 1").select("v", "up"))
        other = ends.select(F.col("v").alias("_o"))
        leaves = ends.join(other, ends["up"] == other["_o"], "left").filter("_o is null or v > up").select("v", "up")
        leaves = cut(leaves.join(nodes, "v"))
        forget(ends)
        if leaves.isEmpty():
            forget(leaves)
            return ways, nodes, rounds
        gone = leaves.select("v")
        grown = leaves.groupBy(F.col("up").alias("v")).agg(F.sum("size").alias("_size"), F.sum(F.col("inner") + F.col("size")).alias("_inner"), F.sum(F.col("size").cast("double") * F.col("size")).alias("_squares"))
        more = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        left = cut(nodes.join(gone, "v", "left_anti").join(grown, "v", "left").select("v", more("size"), more("inner"), more("squares")))
        kept = cut(ways.join(gone, "v", "left_anti").join(gone.withColumnRenamed("v", "w"), "w", "left_anti").select("v", "w"))
        forget(ways, nodes)
        ways, nodes = kept, left
        rounds.append(leaves)


def _levels(ways: DataFrame, nodes: DataFrame) -> list[DataFrame]:
    """For each distance the rows (s, v, paths): shortest paths from s to v."""
    levels = [cut(nodes.select(F.col("v").alias("s"), "v", F.lit(1.0).alias("paths")))]
    while not levels[-1].isEmpty():
        next_ = levels[-1].join(ways, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        # A neighbour of distance k lies at k - 1, k or k + 1.
        for near in levels[-2:]:
            next_ = next_.join(near.select("s", "v"), ["s", "v"], "left_anti")
        levels.append(cut(next_))
    return levels[:-1]


def centralities(edges: DataFrame) -> DataFrame:
    """node_id, closeness (scaled by the part of the nodes reached) and exact normalised betweenness, without directions or weights.

    Hanging trees are taken off first and stand, as numbers, at the nodes that
    they hang on: all their pairs are counted by sizes, as every way out of a
    branch goes through its root. Only what is left, the nodes on rings and
    between them, has a row for every reachable pair: breadth-first levels of
    all these nodes at once, then the shares of paths from the last level back
    to the first. A forest leaves one node of each tree.
    """
    ways, nodes, rounds = _pruned(edges)
    levels = _levels(ways, nodes)
    pairs = reduce(DataFrame.unionByName, [level.select("s", "v", F.lit(k).cast("long").alias("d")) for k, level in enumerate(levels)])
    # all: nodes of the whole part of the graph; far: the sum of distances to them.
    near = pairs.join(nodes, "v").groupBy(F.col("s").alias("v")).agg(F.sum("size").alias("all"), F.sum(F.col("size") * F.col("d") + F.col("inner")).alias("far"))
    weights = nodes.select("v", F.col("size").cast("double").alias("size"))
    shares, behind = [], None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("share", F.lit(0.0)) if behind is None else levels[k].join(behind, ["s", "v"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        here = cut(here.join(weights, "v").select("s", "v", "paths", "share", "size"))
        shares.append(here.join(weights.select(F.col("v").alias("s"), F.col("size").alias("_from")), "s").select("v", (F.col("share") * F.col("_from")).alias("share")))
        back = here.select("s", F.col("v").alias("w"), ((F.col("size") + F.col("share")) / F.col("paths")).alias("part")).join(ways, "w")
        behind = back.join(levels[k - 1], ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("part") * F.col("paths")).alias("share"))
    whole, hung = F.col("all").cast("double"), F.col("size").cast("double") - 1
    own = hung * hung - F.col("squares") + 2 * hung * (whole - 1 - hung)
    found = nodes.join(near, "v")
    if shares:
        through = reduce(DataFrame.unionByName, shares).groupBy("v").agg(F.sum("share").alias("through"))
        found = found.join(through, "v", "left")
    else:
        found = found.withColumn("through", F.lit(0.0))
    found = cut(found.select("v", "all", "far", (own + F.coalesce("through", F.lit(0.0))).alias("through")))
    done = [found]
    # Back down the trees: a leaf is one step nearer to what hangs on it and one farther from all else.
    for leaves in reversed(rounds):
        above = reduce(DataFrame.unionByName, done).select(F.col("v").alias("up"), "all", F.col("far").alias("_far"))
        rest = whole - F.col("size")
        between = (whole - 1) * (whole - 1) - F.col("squares") - rest * rest
        done.append(cut(leaves.join(above, "up").select("v", "all", (F.col("_far") + F.col("all") - 2 * F.col("size")).alias("far"), between.alias("through"))))
    n = F.broadcast(nodes_of(edges).agg(F.count(F.lit(1)).alias("n")))  # one row
    r = F.col("all") - 1
    closeness = F.round(F.coalesce(F.try_divide(r.cast("double") * r, F.col("far") * (F.col("n") - 1)), F.lit(0.0)), 9)
    between = F.round(F.coalesce(F.try_divide(F.col("through"), (F.col("n") - 1) * (F.col("n") - 2)), F.lit(0.0)), 9)
    return reduce(DataFrame.unionByName, done).join(n).select(F.col("v").alias("node_id"), closeness.alias("closeness"), between.alias("betweenness"))


def pivots_of(edges: DataFrame, count: int = 50) -> DataFrame:
    """(node_id) of the first ``count`` nodes by the SHA-256 of their names: the same ones on every run."""
    return _first(nodes_of(edges), count)


def _first(nodes: DataFrame, count: int) -> DataFrame:
    return nodes.select("node_id").orderBy(F.sha2("node_id", 256), "node_id").limit(count)


def sampled_betweenness(edges: DataFrame, count: int = 50) -> DataFrame:
    """node_id and betweenness of the directed graph, estimated from ``count`` pivots and scaled to all nodes.

    Breadth-first levels of the pivots alone: rows grow with pivots times the
    nodes that these reach, so it serves graphs of any number of nodes.
    """
    # Edges are made once; what follows reads them as written.
    edges = cut(edges.select("src", "dst").distinct())
    ways = edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).filter("v <> w")
    nodes = cut(nodes_of(edges).select("node_id"))
    pivots = cut(_first(nodes, count))
    levels = [cut(pivots.select(F.col("node_id").alias("s"), F.col("node_id").alias("v"), F.lit(1.0).alias("paths")))]
    while not levels[-1].isEmpty():
        next_ = levels[-1].join(ways, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        seen = reduce(DataFrame.unionByName, levels).select("s", "v")
        levels.append(cut(next_.join(seen, ["s", "v"], "left_anti")))
    levels = levels[:-1]
    shares, behind = [], None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("share", F.lit(0.0)) if behind is None else levels[k].join(behind, ["s", "v"], "left").na.fill(0.0, ["share"])
        here = cut(here.select("s", "v", "paths", "share"))
        shares.append(here.select("v", "share"))
        back = here.select("s", F.col("v").alias("w"), ((1 + F.col("share")) / F.col("paths")).alias("part")).join(ways, "w")
        behind = back.join(levels[k - 1], ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("part") * F.col("paths")).alias("share"))
    facts = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")).join(pivots.agg(F.count(F.lit(1)).alias("k"))))  # one row
    n, k = F.col("n").cast("double"), F.col("k")
    if not shares:
        return nodes.withColumn("betweenness", F.lit(0.0))
    through = reduce(DataFrame.unionByName, shares).groupBy(F.col("v").alias("node_id")).agg(F.sum("share").alias("through"))
    scaled = F.try_divide(F.coalesce("through", F.lit(0.0)) * n / k, (n - 1) * (n - 2))
    return nodes.join(through, "node_id", "left").join(facts).select("node_id", F.round(F.coalesce(scaled, F.lit(0.0)), 12).alias("betweenness"))
