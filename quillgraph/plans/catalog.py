"""Queries of articles, mentions, prices, the display graph and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import cues as C
from quillgraph.functions import text as X
from quillgraph.operators import graph as G
from quillgraph.operators import metrics as M
from quillgraph.operators import quantiles as Q
from quillgraph.operators import relations as R
from quillgraph.operators import temporal as W
from quillgraph.plans.registry import QUERIES, query  # noqa: F401
from quillgraph.sources import sinks as K
from quillgraph.sources import tables as S
from quillgraph.streaming import events as E

#: Frequent words of the tables' invented prose stand in for cues.
UP, DOWN = ("tion", "ing the", "elle"), ("ough", "ent", "ciÓ")
PATTERNS = {"growth": ["that the", "the and"], "decline": ["la le", "de la"], "merger": ["der die", "und"]}


@query("stock_stats", """SELECT d.symbol, d.industry, d.exchange, count(m.symbol) AS mentions, count(*) FILTER (WHERE sentiment = 'Positive') AS positive,
 count(*) FILTER (WHERE sentiment = 'Negative') AS negative, count(*) FILTER (WHERE sentiment = 'Neutral') AS neutral FROM dictionary d LEFT JOIN mentions m ON d.symbol = m.symbol GROUP BY 1, 2, 3""")
def _(spark, d):
    return R.symbol_stats(S.mentions(spark, d), S.dictionary(spark, d))


@query("dashboard_totals", "SELECT count(*) AS rows, count(DISTINCT news_id) AS news, count(DISTINCT symbol) AS symbols, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (WHERE sentiment = 'Positive') AS positive FROM dated")
def _(spark, d):
    return S.dated_mentions(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("news_id").alias("news"), F.countDistinct("symbol").alias("symbols"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("sentiment") == "Positive").alias("positive"))


@query("sentiment_histogram", "SELECT sentiment, count(*) AS n FROM mentions GROUP BY 1")
def _(spark, d):
    return S.mentions(spark, d).groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))


@query("top_symbols", "SELECT symbol, count(*) AS n FROM mentions GROUP BY 1 ORDER BY n DESC, symbol LIMIT 10")
def _(spark, d):
    return R.top(S.mentions(spark, d), "symbol", 10)


@query("news_by_date", "SELECT day, count(*) AS n FROM articles GROUP BY 1 ORDER BY day DESC LIMIT 30")
def _(spark, d):
    return S.articles(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(30)


@query("feed_filter", "SELECT news_id, day, status FROM articles WHERE status = 'F' AND day BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND event_type ILIKE '%high%'")
def _(spark, d):
    a = S.articles(spark, d)
    return a.filter((F.col("status") == "F") & F.col("day").between(F.lit("1995-01-01").cast("date"), F.lit("1996-06-30").cast("date")) & F.col("event_type").ilike("%high%")).select("news_id", "day", "status")


@query("feed_membership_exact", "SELECT news_id, count(*) AS n FROM mentions GROUP BY 1 HAVING count(*) FILTER (WHERE symbol = 1) > 0")
def _(spark, d):
    m = S.mentions(spark, d)
    asked = m.filter("symbol = 1").select("news_id")
    return m.join(asked, "news_id", "left_semi").groupBy("news_id").agg(F.count(F.lit(1)).alias("n"))


@query("feed_page", "SELECT news_id, owner, day FROM articles ORDER BY news_id DESC LIMIT 50 OFFSET 100")
def _(spark, d):
    return R.page(S.articles(spark, d), "news_id", 100, 50).select("news_id", "owner", "day")


@query("owner_scope", "SELECT news_id, day FROM articles WHERE owner = 7")
def _(spark, d):
    return R.owned(S.articles(spark, d), 7).select("news_id", "day")


@query("funnel_stats", """SELECT count(*) AS rows, count(*) FILTER (WHERE status = 'F') AS ready, count(*) FILTER (WHERE impact < 50000) AS dropped,
 round(count(*) FILTER (WHERE status = 'F') * 100.0 / count(*), 1) AS pass_pct FROM articles""")
def _(spark, d):
    ready = F.count_if(F.col("status") == "F")
    return S.articles(spark, d).agg(F.count(F.lit(1)).alias("rows"), ready.alias("ready"), F.count_if(F.col("impact") < 50000).alias("dropped"), R.percent(ready, F.count(F.lit(1))).alias("pass_pct"))


@query("duplicate_groups", "SELECT owner, day, count(*) AS n FROM articles GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return R.duplicate_groups(S.articles(spark, d), ["owner", "day"])


@query("data_quality", """SELECT count(*) AS rows, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS missing, CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates FROM documents""")
def _(spark, d):
    t = S.table(spark, d, "documents")
    return t.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("missing"), (F.count(F.lit(1)) - F.countDistinct("text")).alias("duplicates"))


@query("labeling_accuracy", "SELECT count(*) AS n, round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END) * 100, 2) AS exact_pct FROM labels")
def _(spark, d):
    return S.table(spark, d, "labels").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("quality") == 1 - F.col("toxic"), 1.0).otherwise(0.0)) * 100, 2).alias("exact_pct"))


@query("batch_progress", "SELECT count(*) AS total, count(status) AS known, count(*) FILTER (WHERE status IS NULL OR status = 'F') AS done FROM (SELECT DISTINCT l_orderkey + 100000 * (l_linenumber // 7) AS id FROM lineitem) q LEFT JOIN articles ON id = news_id")
def _(spark, d):
    li = S.table(spark, d, "lineitem")
    ids = li.select((F.col("l_orderkey") + 100000 * F.floor(F.col("l_linenumber") / 7)).alias("id")).distinct()
    a = S.articles(spark, d)
    j = ids.join(a, ids["id"] == a["news_id"], "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count("status").alias("known"), F.count_if(F.col("status").isNull() | (F.col("status") == "F")).alias("done"))


@query("latest_prediction_per_symbol", "SELECT symbol, news_id, sentiment FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY news_id DESC) AS rn FROM mentions) WHERE rn = 1")
def _(spark, d):
    return R.latest_per_key(S.mentions(spark, d), "symbol", F.desc("news_id")).select("symbol", "news_id", "sentiment")


@query("symbol_rollup", "SELECT symbol, round(avg(impact), 4) AS mean_impact, count(DISTINCT event_type) AS events FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY news_id DESC) AS rn FROM dated) WHERE rn <= 5 GROUP BY 1")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("news_id")))
    return S.dated_mentions(spark, d).withColumn("rn", n).filter("rn <= 5").groupBy("symbol").agg(F.round(F.avg("impact"), 4).alias("mean_impact"), F.countDistinct("event_type").alias("events"))


@query("facet_counts", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def _(spark, d):
    t = S.table(spark, d, "documents")
    one = lambda c: t.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("facet"), "value", "n")
    return one("lang").unionByName(one("source"))


def _list_sql(keys):
    return "[" + ", ".join(f"'{k}'" for k in keys) + "]"


@query("keyword_hits", f"SELECT doc_id, array_to_string(list_filter({_list_sql(UP)}, lambda k: contains(lower(text), k)), ',') AS hits FROM documents")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.array_join(X.keyword_hits(F.col("text"), UP), ",").alias("hits"))


@query("event_detection", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN len(list_filter({_list_sql(v)}, lambda k: contains(lower(text), k))) > 0 THEN '{k}' END" for k, v in PATTERNS.items()) + ") AS events FROM documents")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.array_join(X.events(F.col("text"), PATTERNS), ",").alias("events"))


_HITS = f"p AS (SELECT doc_id, len(list_filter({_list_sql(UP)}, lambda k: contains(lower(text), k))) AS p, len(list_filter({_list_sql(DOWN)}, lambda k: contains(lower(text), k))) AS n FROM documents)"


@query("sentiment_score", ", " + _HITS + """, q AS (SELECT *, p * 1.0 / nullif(p + n, 0) AS r, least(p + n, 5) / 5.0 AS s FROM p)
SELECT doc_id, CASE WHEN p + n > 0 AND r >= 0.6 THEN 'Positive' WHEN p + n > 0 AND r <= 0.4 THEN 'Negative' ELSE 'Neutral' END AS label,
 CAST(CASE WHEN p + n > 0 AND (r >= 0.6 OR r <= 0.4) THEN round(least(greatest(50 + (r - 0.5) * 100 * s, 5), 95), 2) ELSE 50 END AS DOUBLE) AS score FROM q""")
def _(spark, d):
    t, none = F.col("text"), F.array().cast("array<double>")
    found = X.sentiment(F.size(X.keyword_hits(t, UP)), F.size(X.keyword_hits(t, DOWN)), none, none)
    return S.table(spark, d, "documents").select("doc_id", found.alias("s")).select("doc_id", "s.label", F.col("s.score").alias("score"))


@query("heuristic_trend", """SELECT news_id, symbol, CASE WHEN score > 15 THEN 'INCREASING' WHEN score < -15 THEN 'DECREASING' ELSE 'UNCHANGED' END AS trend, CAST(round(score, 4) AS DOUBLE) AS score FROM
 (SELECT news_id, symbol, 30 * (CASE sentiment WHEN 'Positive' THEN 1 WHEN 'Negative' THEN -1 ELSE 0 END) + CAST(impact AS DECIMAL(18, 2)) * 0.00004 - 20 AS score FROM dated)""")
def _(spark, d):
    zero, impact = F.lit(0), F.col("impact").cast("decimal(18,2)") / 10000
    t = X.trend(F.col("sentiment"), zero, impact, F.lit(0.5).cast("decimal(2,1)"), zero, zero)
    return S.dated_mentions(spark, d).select("news_id", "symbol", t.alias("t")).select("news_id", "symbol", "t.trend", F.col("t.score").cast("double").alias("score"))


@query("ticker_match", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\pL\pN_])thor($|[^\pL\pN_])')")
def _(spark, d):
    return S.table(spark, d, "documents").filter(X.word_bounded(F.col("text"), "thor")).select("doc_id")


@query("html_title", r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\x{00A0}]+', ' ', 'g')), '') AS title FROM pages")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


@query("url_host", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)', 1)), '^www\.', '') AS host FROM pages")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))


_BOILERPLATE = "|".join(rf"<{t}\b.*?</{t}>" for t in X.BOILERPLATE) + "|<!--.*?-->"


@query("html_body", rf"SELECT page_id, coalesce(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is){_BOILERPLATE}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g')), '') AS body FROM pages")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("body"))


#: A sentence of each order line: which way it moved and by how much, in per cent or not.
_LINES = """, told AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'Giảm mạnh ' ELSE 'tăng ' END || CAST(l_quantity AS INT) || CASE WHEN l_linestatus = 'O' THEN ',5 %' ELSE ' điểm' END
 || CASE WHEN l_linenumber % 3 = 0 THEN ', rồi giảm 4%' WHEN l_linenumber % 3 = 1 THEN '; Lãi kỷ lục' ELSE '' END AS text FROM lineitem)"""


def _lines(spark, d):
    text = F.concat(
        F.when(F.col("l_returnflag") == "R", "Giảm mạnh ").otherwise("tăng "), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linestatus") == "O", ",5 %").otherwise(" điểm"),
        F.when(F.col("l_linenumber") % 3 == 0, ", rồi giảm 4%").when(F.col("l_linenumber") % 3 == 1, "; Lãi kỷ lục").otherwise(""),
    )
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))


_MOVES = lambda way: f"list_transform(regexp_extract_all(lower(text), '{way}[^%\\n]{{0,20}}?(\\d{{1,3}}(?:[.,]\\d+)?)\\s*%', 1), lambda x: replace(x, ',', '.'))"


@query("magnitude_hits", _LINES + f"SELECT * EXCLUDE (text), array_to_string({_MOVES(C.UP)}, ' ') AS up, array_to_string({_MOVES(C.DOWN)}, ' ') AS down FROM told")
def _(spark, d):
    moves = lambda way: F.array_join(X.percent_moves(F.lower("text"), (way,)), " ")
    return _lines(spark, d).withColumns({"up": moves(C.UP), "down": moves(C.DOWN)}).drop("text")


@query("sentiment_of_moves", _LINES + f""", h AS (SELECT * EXCLUDE (text), len(list_filter({_list_sql(C.POSITIVE)}, lambda k: contains(lower(text), k))) AS p, len(list_filter({_list_sql(C.NEGATIVE)}, lambda k: contains(lower(text), k))) AS n,
  CAST({_MOVES(C.UP)} AS DOUBLE[]) AS up, CAST({_MOVES(C.DOWN)} AS DOUBLE[]) AS down FROM told), r AS (SELECT *, p / (p + n) AS ratio, (p / (p + n) - 0.5) * 100 * least(p + n, 5) / 5 AS swing FROM h)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN ratio >= 0.6 THEN 'Positive' WHEN ratio <= 0.4 THEN 'Negative' ELSE 'Neutral' END AS label, CAST(round(CASE WHEN ratio >= 0.6 THEN greatest(5, least(95, 50 + swing + CASE WHEN len(up) > 0 THEN least(list_avg(up), 40) / 40 * 20 ELSE 0 END))
  WHEN ratio <= 0.4 THEN greatest(5, least(95, 50 + swing - CASE WHEN len(down) > 0 THEN least(list_avg(down), 40) / 40 * 20 ELSE 0 END)) ELSE 50 END, 2) AS DOUBLE) AS score FROM r""")
def _(spark, d):
    low = F.col("text")
    moves = lambda way: F.transform(X.percent_moves(F.lower(low), (way,)), lambda x: x.cast("double"))
    mood = X.sentiment(F.size(X.keyword_hits(low, C.POSITIVE)), F.size(X.keyword_hits(low, C.NEGATIVE)), moves(C.UP), moves(C.DOWN))
    return _lines(spark, d).withColumn("m", mood).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "m.label", F.col("m.score").alias("score"))


# SQL has no look-around: tests hold these two against plain Python.
@query("ticker_mentions")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.explode(X.symbol_mentions(F.col("text"))).alias("symbol"))


@query("ticker_context_gate")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.explode(X.symbol_mentions(F.col("text"), ("the", "die", "que"))).alias("symbol"))


@query("strip_metadata", r"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN list_contains(other, true) THEN array_to_string(lines[list_position(other, true):], chr(10)) ELSE '' END AS body FROM
 (SELECT *, list_transform(lines, lambda x: NOT (trim(x) = '' OR trim(x) = trim(lines[1]) OR regexp_matches(x, '^\s*\d{1,2}[/-]\d{1,2}[/-]\d{4}.*$'))) AS other FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents))""")
def _(spark, d):
    t = S.table(spark, d, "documents")
    return t.select("doc_id", X.without_leading_lines(F.col("text"), F.split("text", "\n")[0]).alias("body"))


@query("stable_ids", "SELECT news_id, 'event:' || substring(sha256(CAST(news_id AS VARCHAR) || '|' || event_type), 1, 16) AS id FROM articles")
def _(spark, d):
    return S.articles(spark, d).select("news_id", X.stable_id("event:", 16, F.col("news_id"), F.col("event_type")).alias("id"))


_EDGES = """, edges AS (
 SELECT DISTINCT * FROM (SELECT 'news_' || news_id AS src, 'stock_' || symbol AS dst, 'mentions' AS relation FROM dated
 UNION ALL SELECT 'news_' || news_id, 'event_' || event_type, 'contains_event' FROM dated UNION ALL SELECT 'event_' || event_type, 'stock_' || symbol, 'affects' FROM dated
 UNION ALL SELECT 'news_' || news_id, 'sentiment_' || sentiment, 'has_sentiment' FROM dated UNION ALL SELECT 'stock_' || symbol, 'industry_' || industry, 'belongs_to' FROM dictionary)
), nodes AS (SELECT DISTINCT node_id, split_part(node_id, '_', 1) AS node_type FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges))
"""


def _edges(spark, d):
    return G.edges_of(S.dated_mentions(spark, d), S.dictionary(spark, d))


@query("graph_edges", _EDGES + "SELECT * FROM edges")
def _(spark, d):
    return _edges(spark, d)


@query("graph_type_counts", _EDGES + "SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def _(spark, d):
    return G.nodes_of(_edges(spark, d)).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query("graph_density", _EDGES + "SELECT n AS nodes, m AS edges, round(m / (n * (n - 1.0)), 12) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS m FROM edges)")
def _(spark, d):
    return G.density(_edges(spark, d))


@query("degree_centrality", _EDGES + "SELECT node_id, count(*) AS degree, round(count(*) / ((SELECT count(*) FROM nodes) - 1), 9) AS centrality FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1")
def _(spark, d):
    return G.degree_centrality(_edges(spark, d))


@query("ego_two_hop", _EDGES + """, h1 AS (SELECT dst AS id FROM edges WHERE src = 'event_1-URGENT'), h2 AS (SELECT dst AS id FROM edges WHERE src IN (SELECT id FROM h1)),
 reach AS (SELECT 'event_1-URGENT' AS id UNION SELECT id FROM h1 UNION SELECT id FROM h2) SELECT * FROM edges WHERE src IN (SELECT id FROM reach) AND dst IN (SELECT id FROM reach)""")
def _(spark, d):
    return G.ego(_edges(spark, d), spark.createDataFrame([("event_1-URGENT",)], "node_id string"))


@query("integrity_orphans", "SELECT symbol AS dst FROM mentions WHERE symbol NOT IN (SELECT symbol FROM dictionary WHERE exchange <> 'ASIA') GROUP BY 1")
def _(spark, d):
    edges = S.mentions(spark, d).select(F.col("news_id").alias("src"), F.col("symbol").alias("dst"))
    kept = S.dictionary(spark, d).filter("exchange <> 'ASIA'").select(F.col("symbol").alias("node_id"))
    return edges.select("dst").distinct().join(kept, F.col("dst") == F.col("node_id"), "left_anti")


@query("same_industry_edges", "SELECT x.symbol AS a, y.symbol AS b, x.industry FROM dictionary x JOIN dictionary y ON x.industry = y.industry AND x.symbol < y.symbol")
def _(spark, d):
    return G.same_industry(S.dictionary(spark, d)).select("a", "b", "industry")


@query("comention_first_seen", "SELECT x.symbol AS a, y.symbol AS b, min(x.day) AS first_seen, count(DISTINCT x.news_id) AS weight FROM dated x JOIN dated y ON x.news_id = y.news_id AND x.symbol < y.symbol GROUP BY 1, 2")
def _(spark, d):
    return R.co_mentions(S.dated_mentions(spark, d))


@query("history_counts", """, daily AS (SELECT symbol, day, count(*) AS n, count(*) FILTER (WHERE sentiment = 'Positive') AS p, count(*) FILTER (WHERE sentiment = 'Negative') AS m FROM dated GROUP BY 1, 2)
SELECT symbol, day, n AS today, CAST(coalesce(sum(n) OVER b, 0) AS BIGINT) AS before, CAST(coalesce(sum(p) OVER b, 0) AS BIGINT) AS positive_before, CAST(coalesce(sum(m) OVER b, 0) AS BIGINT) AS negative_before,
 CAST(coalesce(sum(n) OVER l30, 0) AS BIGINT) AS last30, CAST(coalesce(sum(n) OVER l90, 0) AS BIGINT) AS last90, CAST(day - max(day) OVER b AS INTEGER) AS days_since FROM daily
 WINDOW b AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), l30 AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING),
 l90 AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def _(spark, d):
    return W.history(S.dated_mentions(spark, d))


@query("industry30", """, x AS (SELECT industry, day, news_id, symbol FROM dated JOIN dictionary USING (symbol)), days AS (SELECT DISTINCT industry, day FROM x)
SELECT d.industry, d.day, count(DISTINCT x.news_id) AS articles, count(DISTINCT x.symbol) AS symbols FROM days d LEFT JOIN x ON x.industry = d.industry AND x.day < d.day AND x.day >= d.day - INTERVAL 30 DAYS GROUP BY 1, 2""")
def _(spark, d):
    return W.industry_history(S.dated_mentions(spark, d), S.dictionary(spark, d))


@query("moving_average", "SELECT symbol, day, close, CASE WHEN count(close) OVER w = 20 THEN round(avg(close) OVER w, 6) END AS ma20 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return W.moving_average(S.price_panel(spark, d), 20)


@query("forward_move", "SELECT symbol, day, close, CASE WHEN close <> 0 THEN round((lead(close, 3) OVER w - close) / close * 100, 3) END AS move FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day)")
def _(spark, d):
    return W.forward_move(S.price_panel(spark, d))


@query("volatility20", """, r AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS ret FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, day, close, CASE WHEN count(ret) OVER w >= 5 THEN round(stddev_samp(ret) OVER w, 6) END AS volatility FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return W.volatility(S.price_panel(spark, d))


@query("asof_label", """, asked AS (SELECT DISTINCT p_brand AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)
SELECT a.symbol, a.day, p.day AS session, p.close FROM asked a ASOF LEFT JOIN panel p ON a.symbol = p.symbol AND a.day <= p.day""")
def _(spark, d):
    o, li, p = (S.table(spark, d, t) for t in ("orders", "lineitem", "part"))
    asked = o.join(li, o["o_orderkey"] == li["l_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("p_brand").alias("symbol"), F.to_date("o_orderdate").alias("day")).distinct()
    return W.as_of_forward(asked, S.price_panel(spark, d))


@query("asof_feature", """, asked AS (SELECT DISTINCT p_brand AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)
SELECT a.symbol, a.day, p.day AS session, p.close FROM asked a ASOF LEFT JOIN panel p ON a.symbol = p.symbol AND a.day > p.day""")
def _(spark, d):
    o, li, p = (S.table(spark, d, t) for t in ("orders", "lineitem", "part"))
    asked = o.join(li, o["o_orderkey"] == li["l_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("p_brand").alias("symbol"), F.to_date("o_orderdate").alias("day")).distinct()
    return W.as_of_backward(asked, S.price_panel(spark, d))


@query("abnormal_return", """, idx AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / sum(l_quantity) AS close FROM lineitem GROUP BY 1),
 s AS (SELECT symbol, day, close, lead(day, 3) OVER w AS until, lead(close, 3) OVER w AS later FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day))
 SELECT symbol, s.day, until, later / s.close - 1 AS own, b.close / a.close - 1 AS market, (later / s.close - 1) - (b.close / a.close - 1) AS abnormal FROM s JOIN idx a ON a.day = s.day JOIN idx b ON b.day = s.until WHERE s.close <> 0 AND a.close <> 0""")
def _(spark, d):
    li = S.table(spark, d, "lineitem")
    index = li.groupBy(F.to_date("l_shipdate").alias("day")).agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("close"))
    return W.abnormal_return(S.price_panel(spark, d), index)


@query("price_band", """, r AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS ret FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 v AS (SELECT *, CASE WHEN count(ret) OVER w >= 5 THEN round(stddev_samp(ret) OVER w, 6) END AS vol, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 b AS (SELECT symbol, max(close) FILTER (WHERE rn = 1) AS close, min(close) AS low, max(close) AS high, max(vol) FILTER (WHERE rn = 1) AS volatility FROM v WHERE rn <= 20 GROUP BY 1 HAVING count(*) >= 10)
SELECT symbol, close, low, high, volatility, round(greatest(round(close * (1 - 2 * volatility), 2), low), 4) AS pullback FROM b WHERE volatility IS NOT NULL""")
def _(spark, d):
    return W.price_band(S.price_panel(spark, d))


_PAIRS = ", pairs AS (SELECT quality AS truth, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS predicted, source, doc_id FROM labels JOIN documents USING (doc_id))"


def _pairs(spark, d):
    j = S.table(spark, d, "labels").join(S.table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return j.select(F.col("quality").alias("truth"), F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("predicted"), "source", "doc_id")


@query("confusion_matrix", _PAIRS + "SELECT truth, predicted, count(*) AS n FROM pairs GROUP BY 1, 2")
def _(spark, d):
    return M.confusion(_pairs(spark, d))


@query("classification_metrics", _PAIRS + """, c AS (SELECT label, count(*) FILTER (WHERE truth = label AND predicted = label) AS tp, count(*) FILTER (WHERE truth <> label AND predicted = label) AS fp,
 count(*) FILTER (WHERE truth = label AND predicted <> label) AS fn FROM pairs, (SELECT unnest([0, 1]) AS label) GROUP BY 1)
SELECT label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def _(spark, d):
    return M.per_class(_pairs(spark, d))


@query("cohen_kappa", _PAIRS + """, n AS (SELECT count(*) AS t, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0 END) AS po, avg(truth) AS a, avg(predicted) AS b FROM pairs)
SELECT round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS weighted_kappa FROM n""")
def _(spark, d):
    return M.kappa(_pairs(spark, d))


@query("wilson_by_tier", _PAIRS + """, g AS (SELECT source AS tier, count(*) FILTER (WHERE truth = predicted) AS k, count(*) AS n FROM pairs GROUP BY 1), z AS (SELECT *, k / n AS p, 1.9599639845 AS z FROM g)
SELECT tier, k, n, round(greatest((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 0), 6) AS low, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM z""")
def _(spark, d):
    g = _pairs(spark, d).groupBy(F.col("source").alias("tier")).agg(F.count_if(F.col("truth") == F.col("predicted")).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("w", X.wilson(F.col("k"), F.col("n"))).select("tier", "k", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query("subgroup_metrics", _PAIRS + "SELECT source, count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0 END), 6) AS accuracy FROM pairs GROUP BY ROLLUP (source)")
def _(spark, d):
    return _pairs(spark, d).rollup("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("truth") == F.col("predicted"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


_DRAWN = """, u AS (SELECT c, s, n, draw, (CAST('0x' || substring(md5(c || '|' || draw || '|7'), 1, 10) AS BIGINT) + 0.5) / 1099511627776.0 AS u FROM
 (SELECT source AS c, sum(CASE WHEN truth = predicted THEN 1 ELSE 0 END) AS s, count(*) AS n FROM pairs GROUP BY 1), (SELECT unnest(range(1, 5001)) AS draw)),
 w AS (SELECT *, """ + " + ".join(f"(u >= {x})::INT" for x in ("0.367879441", "0.735758882", "0.919698603", "0.981011843", "0.996340153", "0.999405815")) + """ AS w FROM u),
 means AS (SELECT draw, sum(w * s) / sum(w * n) AS mean FROM w GROUP BY 1 HAVING sum(w * n) > 0)"""


@query("bootstrap_interval", _PAIRS + _DRAWN + "SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, round(avg(mean), 6) AS mean FROM means")
def _(spark, d):
    found = M.bootstrap_mean(_pairs(spark, d).withColumn("hit", (F.col("truth") == F.col("predicted")).cast("double")), "source", "hit", draws=5000)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


# Five ordered classes: an article's priority against the fifth of prices, by fixed limits, that it falls in.
_GRADES = ", grades AS (SELECT news_id, CAST(substring(event_type, 1, 1) AS INT) AS truth, CASE WHEN impact < 60000 THEN 1 WHEN impact < 110000 THEN 2 WHEN impact < 160000 THEN 3 WHEN impact < 220000 THEN 4 ELSE 5 END AS predicted, day, owner, impact FROM articles)"


def _grades(spark, d):
    grade = F.when(F.col("impact") < 60000, 1).when(F.col("impact") < 110000, 2).when(F.col("impact") < 160000, 3).when(F.col("impact") < 220000, 4).otherwise(5)
    return S.articles(spark, d).select("news_id", F.substring("event_type", 1, 1).cast("int").alias("truth"), grade.alias("predicted"), "day", "owner", "impact")


@query("cohen_kappa_ordered", _GRADES + """, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE truth <> predicted) AS off, sum((truth - predicted) ** 2) AS far FROM grades), t AS (SELECT truth AS a, count(*) AS nt FROM grades GROUP BY 1), p AS (SELECT predicted AS b, count(*) AS np FROM grades GROUP BY 1),
 e AS (SELECT sum(CASE WHEN a <> b THEN CAST(nt AS DOUBLE) * np ELSE 0 END) AS off, sum((a - b) ** 2 * CAST(nt AS DOUBLE) * np) AS far FROM t, p) SELECT round(1 - n.off / (e.off / n), 6) AS kappa, round(1 - n.far / (e.far / n), 6) AS weighted_kappa FROM n, e""")
def _(spark, d):
    return M.kappa(_grades(spark, d))


@query("overall_metrics", _GRADES + """, t AS (SELECT truth AS k, count(*) AS s, count(*) FILTER (WHERE truth = predicted) AS tp FROM grades GROUP BY 1), p AS (SELECT predicted AS k, count(*) AS g FROM grades GROUP BY 1),
 j AS (SELECT coalesce(s, 0) AS s, coalesce(tp, 0) AS tp, coalesce(g, 0) AS g FROM t FULL JOIN p USING (k)), f AS (SELECT *, coalesce(2.0 * tp / nullif(s + g, 0), 0) AS f1 FROM j),
 a AS (SELECT CAST(sum(s) AS BIGINT) AS n, CAST(sum(tp) AS DOUBLE) AS c, avg(tp / s) FILTER (WHERE s > 0) AS bal, avg(f1) AS macro, sum(f1 * s) / sum(s) AS weighted, sum(CAST(s AS DOUBLE) * g) AS sg, sum(CAST(s AS DOUBLE) * s) AS ss, sum(CAST(g AS DOUBLE) * g) AS gg FROM f)
 SELECT n, round(c / n, 6) AS accuracy, round(bal, 6) AS balanced_accuracy, round(macro, 6) AS macro_f1, round(weighted, 6) AS weighted_f1, round(coalesce((c * n - sg) / nullif(sqrt((CAST(n AS DOUBLE) * n - gg) * (CAST(n AS DOUBLE) * n - ss)), 0), 0), 6) AS mcc FROM a""")
def _(spark, d):
    return M.overall(_grades(spark, d))


@query("majority_class", _GRADES + "SELECT truth, count(*) AS n FROM grades GROUP BY 1 ORDER BY n DESC, truth LIMIT 1")
def _(spark, d):
    from quillgraph.operators.relations import top

    return top(_grades(spark, d), "truth", 1)


@query("mcnemar", _PAIRS + """, q AS (SELECT truth = predicted AS a, truth = CASE WHEN source < 'm' THEN 1 ELSE 0 END AS b FROM pairs), k AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS b, count(*) FILTER (WHERE b AND NOT a) AS c FROM q)
 SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM (SELECT unnest(range(0, least(b, c) + 1)) AS i))) END, 9) AS p FROM k""")
def _(spark, d):
    other = F.when(F.col("source") < "m", 1).otherwise(0)
    return M.mcnemar(_pairs(spark, d).select((F.col("truth") == F.col("predicted")).alias("first_right"), (F.col("truth") == other).alias("second_right")))


@query("spearman", """SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS a,
 rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS b FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL)""")
def _(spark, d):
    return Q.spearman(S.table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


@query("quintile_buckets", """, e AS (SELECT list_distinct(quantile_cont(impact, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS edges FROM articles), b AS (SELECT greatest(len(list_filter(edges, lambda x: x < impact)), 1) AS bucket, impact, owner FROM articles, e)
 SELECT CAST(bucket AS INT) AS bucket, count(*) AS n, round(avg(impact), 6) AS mean_value, round(avg(owner), 6) AS mean_result FROM b GROUP BY 1""")
def _(spark, d):
    return Q.buckets(S.articles(spark, d), "impact", "owner")


@query("subgroup_macro_f1", _GRADES + """, c AS (SELECT year(day) AS year, k, count(*) FILTER (WHERE truth = k AND predicted = k) AS tp, count(*) FILTER (WHERE truth = k) AS s, count(*) FILTER (WHERE predicted = k) AS g FROM grades, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY 1, 2)
 SELECT CAST(year AS INT) AS year, CAST(sum(s) AS BIGINT) AS n, round(avg(2.0 * tp / (s + g)) FILTER (WHERE s + g > 0), 6) AS macro_f1 FROM c GROUP BY 1""")
def _(spark, d):
    return M.grouped_macro_f1(_grades(spark, d).withColumn("year", F.year("day")), "year")


@query("band_table", "SELECT CASE WHEN l_discount < 0.03 THEN 'LOW' WHEN l_discount < 0.07 THEN 'MEDIUM' ELSE 'HIGH' END AS band, count(*) AS n, round(avg(l_discount), 6) AS mean, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), 6) AS realised FROM lineitem GROUP BY 1")
def _(spark, d):
    band = F.when(F.col("l_discount") < 0.03, "LOW").when(F.col("l_discount") < 0.07, "MEDIUM").otherwise("HIGH")
    return S.table(spark, d, "lineitem").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("realised"))


@query("layer_split", _EDGES + "SELECT CASE WHEN relation IN ('mentions', 'belongs_to') THEN 'CORE' WHEN relation = 'has_sentiment' THEN 'SEMANTIC' ELSE 'DERIVED' END AS layer, count(*) AS n FROM edges GROUP BY 1")
def _(spark, d):
    layer = F.when(F.col("relation").isin("mentions", "belongs_to"), "CORE").when(F.col("relation") == "has_sentiment", "SEMANTIC").otherwise("DERIVED")
    return _edges(spark, d).groupBy(layer.alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("competency", """SELECT 'one_date' AS question, count(*) FILTER (WHERE k = 1) AS numerator, count(*) AS denominator FROM (SELECT news_id, count(DISTINCT day) AS k FROM dated GROUP BY 1)
 UNION ALL SELECT 'queryable', count(DISTINCT m.symbol), count(DISTINCT d.symbol) FROM dictionary d LEFT JOIN mentions m ON d.symbol = m.symbol""")
def _(spark, d):
    days = S.dated_mentions(spark, d).groupBy("news_id").agg(F.countDistinct("day").alias("k")).agg(F.count_if(F.col("k") == 1).alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    m = S.mentions(spark, d).select(F.col("symbol").alias("seen")).distinct()
    q = S.dictionary(spark, d).join(m, F.col("symbol") == F.col("seen"), "left").agg(F.countDistinct("seen").alias("numerator"), F.countDistinct("symbol").alias("denominator"))
    return days.select(F.lit("one_date").alias("question"), "*").unionByName(q.select(F.lit("queryable").alias("question"), "*"))


@query("review_sample", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(news_id || '|42'), news_id) AS rn FROM articles) WHERE rn <= 20")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.md5(F.concat(F.col("news_id").cast("string"), F.lit("|42"))), "news_id"))
    return S.articles(spark, d).withColumn("rn", n).filter("rn <= 20").drop("rn")


@query("neo4j_nodes", _EDGES + """SELECT node_id AS ":ID", node_type AS ":LABEL", substring(node_id, length(node_type) + 2) AS name FROM nodes""")
def _(spark, d):
    return K.bulk_nodes(G.nodes_of(_edges(spark, d)))


@query("manifest_digest", _EDGES + "SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substring(sha256(concat_ws('|', src, dst, relation)), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM edges")
def _(spark, d):
    return K.digest(_edges(spark, d))


@query("sliding_rate", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def _(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return S.table(spark, d, "events").withColumn("us", seconds).select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("n"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    rows = S.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.windowed_counts(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))
