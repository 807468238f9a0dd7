"""Queries of the graph as a whole: measures, overlays, contracts and check lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import checks as C
from quillgraph.operators import graph as G
from quillgraph.plans.catalog import _EDGES, _edges
from quillgraph.plans.registry import query
from quillgraph.sources import tables as S

# Suppliers, nations and regions as a forest: one tree for each region.
_FOREST = ", tree AS (SELECT 'supplier_' || symbol AS a, 'nation_' || industry AS b, exchange FROM dictionary UNION SELECT 'nation_' || industry, 'region_' || exchange, exchange FROM dictionary), ends AS (SELECT a AS node_id, exchange FROM tree UNION SELECT b, exchange FROM tree)"


def _forest(spark, d):
    x = S.dictionary(spark, d)
    low = x.select(F.concat(F.lit("supplier_"), "symbol").alias("src"), F.concat(F.lit("nation_"), "industry").alias("dst"))
    return low.union(x.select(F.concat(F.lit("nation_"), "industry"), F.concat(F.lit("region_"), "exchange"))).distinct()


@query("stock_graph_features", _EDGES + """, mood AS (SELECT src, count(*) FILTER (WHERE dst = 'sentiment_Positive') AS p, count(*) FILTER (WHERE dst = 'sentiment_Negative') AS m FROM edges WHERE relation = 'has_sentiment' GROUP BY 1),
 f AS (SELECT e.dst AS stock, count(*) AS mention_frequency, CAST(coalesce(sum(p), 0) AS BIGINT) AS positive, CAST(coalesce(sum(m), 0) AS BIGINT) AS negative FROM edges e LEFT JOIN mood USING (src) WHERE relation = 'mentions' GROUP BY 1)
 SELECT *, round(positive / (positive + negative + 0.001), 4) AS ratio FROM f""")
def _(spark, d):
    return G.stock_features(_edges(spark, d))


@query("industry_subgraph", _EDGES + """, seeds AS (SELECT 'industry_NATION_1' AS id UNION SELECT src FROM edges WHERE relation = 'belongs_to' AND dst = 'industry_NATION_1'), reach AS (SELECT id FROM seeds UNION SELECT dst FROM edges WHERE src IN (SELECT id FROM seeds))
 SELECT * FROM edges WHERE src IN (SELECT id FROM reach) AND dst IN (SELECT id FROM reach)""")
def _(spark, d):
    return G.industry_subgraph(_edges(spark, d), "NATION_1")


@query("owner_graph", """, own AS (SELECT * FROM dated WHERE owner % 10 = 7 AND impact > 50000) SELECT DISTINCT * FROM (SELECT 'news_' || news_id AS src, 'stock_' || symbol AS dst, 'mentions' AS relation FROM own UNION ALL SELECT 'news_' || news_id, 'event_' || event_type, 'contains_event' FROM own
 UNION ALL SELECT 'event_' || event_type, 'stock_' || symbol, 'affects' FROM own UNION ALL SELECT 'news_' || news_id, 'sentiment_' || sentiment, 'has_sentiment' FROM own UNION ALL SELECT 'stock_' || symbol, 'industry_' || industry, 'belongs_to' FROM dictionary WHERE symbol IN (SELECT symbol FROM own))""")
def _(spark, d):
    # The graph of some owners' rows that are marked as built, with the stocks that these name.
    own = S.dated_mentions(spark, d).filter("owner % 10 = 7 and impact > 50000")
    return G.edges_of(own, S.dictionary(spark, d).join(own.select("symbol"), "symbol", "left_semi"))


@query("graph_neighbours", _EDGES + "SELECT dst AS node_id FROM edges WHERE src = 'stock_1' UNION SELECT src FROM edges WHERE dst = 'stock_1'")
def _(spark, d):
    return G.neighbours(_edges(spark, d), "stock_1")


@query("comention_same_industry", "SELECT DISTINCT x.symbol AS a, y.symbol AS b, dx.industry FROM dated x JOIN dated y ON x.news_id = y.news_id AND x.symbol < y.symbol LEFT JOIN dictionary dx ON x.symbol = dx.symbol LEFT JOIN dictionary dy ON y.symbol = dy.symbol WHERE dx.industry IS NOT DISTINCT FROM dy.industry")
def _(spark, d):
    return G.missing_same_industry(S.dated_mentions(spark, d), S.dictionary(spark, d))


@query("connected_components", _FOREST + "SELECT node_id, min(node_id) OVER (PARTITION BY exchange) AS component FROM ends")
def _(spark, d):
    return G.components(_forest(spark, d))


@query("component_sizes", _FOREST + "SELECT count(*) AS components, max(n) AS largest FROM (SELECT exchange, count(*) AS n FROM ends GROUP BY 1)")
def _(spark, d):
    return G.components(_forest(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


@query("graph_centralities", _FOREST + """SELECT node_id, round(coalesce(CAST(r AS DOUBLE) * r / nullif(far * (n - 1), 0), 0), 9) AS closeness, round(coalesce(through, 0) / ((n - 1.0) * (n - 2)), 9) AS betweenness FROM
 (WITH RECURSIVE way AS (SELECT a AS v, b AS w FROM tree UNION SELECT b, a FROM tree), walk AS (SELECT node_id AS s, node_id AS v, 0 AS d FROM ends UNION SELECT s, w, d + 1 FROM walk JOIN way USING (v) WHERE d < 4),
  dist AS (SELECT s, v, min(d) AS d FROM walk GROUP BY 1, 2), near AS (SELECT s AS node_id, count(*) - 1 AS r, sum(d) AS far FROM dist GROUP BY 1),
  mid AS (SELECT x.v AS node_id, CAST(count(*) AS DOUBLE) AS through FROM dist x JOIN dist y ON x.v = y.s JOIN dist z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 GROUP BY 1)
  SELECT near.*, through, (SELECT count(*) FROM ends) AS n FROM near LEFT JOIN mid USING (node_id))""")
def _(spark, d):
    return G.centralities(_forest(spark, d))


_LEVELS = """, ways AS (SELECT DISTINCT src AS v, dst AS w FROM edges WHERE src <> dst), pv AS (SELECT node_id FROM nodes ORDER BY sha256(node_id), node_id LIMIT 50), l0 AS (SELECT node_id AS s, node_id AS v, 1.0::DOUBLE AS p FROM pv)""" + "".join(
    f", l{k} AS (SELECT s, w AS v, sum(p) AS p FROM l{k - 1} JOIN ways USING (v) WHERE " + " AND ".join(f"(s, w) NOT IN (SELECT (s, v) FROM l{j})" for j in range(k)) + " GROUP BY 1, 2)" for k in (1, 2, 3, 4)
) + ", h4 AS (SELECT *, 0.0::DOUBLE AS h FROM l4)" + "".join(
    f", h{k} AS (SELECT a.s, a.v, a.p, coalesce(sum(a.p * (1 + b.h) / b.p), 0) AS h FROM l{k} a LEFT JOIN ways ON ways.v = a.v LEFT JOIN h{k + 1} b ON b.s = a.s AND b.v = ways.w GROUP BY 1, 2, 3)" for k in (3, 2, 1)
) + ", t AS (SELECT v, sum(h) AS h FROM (SELECT v, h FROM h1 UNION ALL SELECT v, h FROM h2 UNION ALL SELECT v, h FROM h3 UNION ALL SELECT v, h FROM h4) GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM nodes)"


@query("sampled_betweenness", _EDGES + _LEVELS + "SELECT node_id, round(coalesce(h, 0) * n / 50 / ((n - 1) * (n - 2)), 12) AS betweenness FROM nodes LEFT JOIN t ON t.v = node_id, n")
def _(spark, d):
    return G.sampled_betweenness(_edges(spark, d))


@query("event_overlay", """, told AS (SELECT *, CASE WHEN event_type IN ('1-URGENT', '2-HIGH') THEN event_type END AS event FROM dated)
 SELECT news_id, symbol, coalesce(event, 'EXPERIMENTAL_NO_MATCH') AS event, CASE WHEN event IS NOT NULL THEN sentiment END AS sentiment, industry FROM told JOIN dictionary USING (symbol)""")
def _(spark, d):
    dated = S.dated_mentions(spark, d)
    event = dated.filter(F.col("event_type").isin("1-URGENT", "2-HIGH")).select("news_id", "symbol", F.struct("event_type", "sentiment").alias("e"))
    # The first matching event of a (news, symbol).
    first = event.groupBy("news_id", "symbol").agg(F.min("e").alias("e"))
    j = dated.select("news_id", "symbol").join(first, ["news_id", "symbol"], "left").join(S.dictionary(spark, d).select("symbol", "industry"), "symbol")
    return j.select("news_id", "symbol", F.coalesce("e.event_type", F.lit("EXPERIMENTAL_NO_MATCH")).alias("event"), F.col("e.sentiment").alias("sentiment"), "industry")


#: Types of the ends that a relation joins.
CONTRACT = {"mentions": ("news", "stock"), "contains_event": ("news", "event"), "affects": ("event", "stock"), "has_sentiment": ("news", "sentiment"), "belongs_to": ("stock", "company")}


@query("edge_contract", _EDGES + """, k(relation, s, t) AS (VALUES ('mentions', 'news', 'stock'), ('contains_event', 'news', 'event'), ('affects', 'event', 'stock'), ('has_sentiment', 'news', 'sentiment'), ('belongs_to', 'stock', 'company'))
 SELECT relation, count(*) AS edges, count(*) FILTER (WHERE split_part(src, '_', 1) <> s OR split_part(dst, '_', 1) <> t) AS violations FROM edges LEFT JOIN k USING (relation) GROUP BY 1""")
def _(spark, d):
    return G.contract_violations(_edges(spark, d), CONTRACT)


@query("merged_nodes", "SELECT 'stock_' || symbol AS node_id, 'stock' AS node_type, industry AS name FROM dictionary")
def _(spark, d):
    x = S.dictionary(spark, d).select(F.concat(F.lit("stock_"), "symbol").alias("node_id"), F.lit("stock").alias("node_type"), F.col("industry").alias("name"))
    return G.merge_nodes(x.withColumn("place", F.lit(1)).unionByName(x.withColumn("place", F.lit(0))))


@query("merged_edges", "SELECT DISTINCT 'edge:' || substring(sha256('event_' || event_type || '|affects|stock_' || symbol), 1, 24) AS edge_id, 'event_' || event_type AS src, 'stock_' || symbol AS dst, 'affects' AS relation FROM dated")
def _(spark, d):
    e = S.dated_mentions(spark, d).select(F.concat(F.lit("event_"), "event_type").alias("src"), F.concat(F.lit("stock_"), "symbol").alias("dst"), F.lit("affects").alias("relation"))
    return G.merge_edges(G.with_ids(e))


@query("outcome_layer", """, s AS (SELECT symbol, day, close, lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5, lead(day, 1) OVER w AS d1, lead(day, 3) OVER w AS d3, lead(day, 5) OVER w AS d5 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 o AS (SELECT symbol, day, close, unnest([1, 3, 5]) AS horizon, unnest([c1, c3, c5]) AS later, unnest([d1, d3, d5]) AS available_at FROM s)
 SELECT symbol, day, CAST(horizon AS INT) AS horizon, available_at, CASE WHEN later > close THEN 'UP' WHEN later < close THEN 'DOWN' ELSE 'FLAT' END AS direction, false AS safe FROM o WHERE available_at IS NOT NULL""")
def _(spark, d):
    w = Window.partitionBy("symbol").orderBy("day")
    each = [F.struct(F.lit(k).alias("horizon"), F.lead("close", k).over(w).alias("later"), F.lead("day", k).over(w).alias("available_at")) for k in (1, 3, 5)]
    rows = S.price_panel(spark, d).withColumn("o", F.array(*each)).select("symbol", "day", "close", F.explode("o").alias("o")).filter("o.available_at is not null")
    later = F.col("o.later")
    return rows.select("symbol", "day", "o.horizon", "o.available_at", F.when(later > F.col("close"), "UP").when(later < F.col("close"), "DOWN").otherwise("FLAT").alias("direction"), F.lit(False).alias("safe"))


@query("symbol_sets", "SELECT count(*) FILTER (WHERE a AND b) AS common, count(*) FILTER (WHERE a AND b IS NULL) AS only_one, count(*) FILTER (WHERE a IS NULL AND b) AS only_two, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS differ, count(*) FILTER (WHERE a IS NULL OR b IS NULL) = 0 AS equal FROM (SELECT DISTINCT symbol, true AS a FROM dated WHERE day < DATE '1993-01-10') x FULL JOIN (SELECT DISTINCT symbol, true AS b FROM dated WHERE day BETWEEN DATE '1993-01-05' AND DATE '1993-01-20') y USING (symbol)")
def _(spark, d):
    dated = S.dated_mentions(spark, d)
    return C.compare_sets(dated.filter("day < date '1993-01-10'"), dated.filter("day between date '1993-01-05' and date '1993-01-20'"), "symbol")


@query("one_to_one_join", "SELECT l.doc_id, quality, toxic, source, n_chars FROM labels l JOIN documents d USING (doc_id)")
def _(spark, d):
    return C.one_to_one(S.table(spark, d, "labels"), S.table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")


@query("group_sizes", "SELECT count(*) AS articles, count(*) FILTER (WHERE n = 3) AS of_three, count(*) FILTER (WHERE e = 1) AS one_event, max(n) AS largest FROM (SELECT news_id, count(*) AS n, count(DISTINCT event_type) AS e FROM dated GROUP BY 1)")
def _(spark, d):
    g = S.dated_mentions(spark, d).groupBy("news_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("e"))
    return g.agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("n") == 3).alias("of_three"), F.count_if(F.col("e") == 1).alias("one_event"), F.max("n").alias("largest"))


@query("review_state", """SELECT source, count(*) AS n, count(q) AS answered, CASE WHEN count(*) FILTER (WHERE q NOT IN (0, 1)) > 0 THEN 'INVALID' WHEN count(q) < count(*) THEN 'INCOMPLETE' WHEN avg(q) >= 0.5 THEN 'PASS' ELSE 'QUALITY_GATE_FAIL' END AS state
 FROM (SELECT source, CASE WHEN length(source) % 2 = 0 OR quality IS NOT NULL THEN coalesce(quality, 0) END AS q FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def _(spark, d):
    j = S.table(spark, d, "documents").select("doc_id", "source").join(S.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.when((F.length("source") % 2 == 0) | F.col("quality").isNotNull(), F.coalesce("quality", F.lit(0)))
    g = j.withColumn("q", q).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("q").alias("answered"), F.count_if(~F.col("q").isin(0, 1)).alias("odd"), F.avg("q").alias("share"))
    state = F.when(F.col("odd") > 0, "INVALID").when(F.col("answered") < F.col("n"), "INCOMPLETE").when(F.col("share") >= 0.5, "PASS").otherwise("QUALITY_GATE_FAIL")
    return g.select("source", "n", "answered", state.alias("state"))
