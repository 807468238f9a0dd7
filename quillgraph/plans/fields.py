"""Queries of filters, row functions, orders and small roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators.quantiles import percentiles
from quillgraph.plans.registry import query
from quillgraph.sources import tables as S


@query("complete_rows", "SELECT doc_id, quality, toxic, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    j = S.table(spark, d, "documents").select("doc_id", "source").join(S.table(spark, d, "labels"), "doc_id", "left")
    return j.dropna(subset=["quality", "toxic", "source"]).select("doc_id", "quality", "toxic", "source")


@query("any_label", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def _(spark, d):
    j = S.table(spark, d, "documents").select("doc_id").join(S.table(spark, d, "labels"), "doc_id", "left")
    return j.dropna(how="all", subset=["quality", "toxic"]).select("doc_id")


@query("user_search", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%#0000001%' OR c_mktsegment ILIKE '%mach%' OR CAST(c_custkey AS VARCHAR) ILIKE '%77%'")
def _(spark, d):
    fields = {"c_name": "%#0000001%", "c_mktsegment": "%mach%", "c_custkey": "%77%"}
    found = F.lit(False)
    for name, asked in fields.items():
        found = found | F.col(name).cast("string").ilike(asked)
    return S.table(spark, d, "customer").filter(found).select("c_custkey", "c_name", "c_mktsegment")


@query("informative_candidates", "SELECT news_id, symbol FROM dated WHERE event_type <> '4-NOT SPECIFIED' AND sentiment = 'Positive' AND impact > 100000 AND trim(event_type) <> ''")
def _(spark, d):
    c = (~F.col("event_type").isin("4-NOT SPECIFIED")) & (F.col("sentiment") == "Positive") & (F.col("impact") > 100000) & (F.trim("event_type") != "")
    return S.dated_mentions(spark, d).filter(c).select("news_id", "symbol")


@query("flag_parse", "SELECT l_returnflag AS flag, lower(trim(CASE l_returnflag WHEN 'A' THEN ' TRUE' WHEN 'N' THEN 'no' ELSE '1 ' END)) IN ('true', '1', 'yes') AS parsed, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    raw = F.when(F.col("l_returnflag") == "A", " TRUE").when(F.col("l_returnflag") == "N", "no").otherwise("1 ")
    return S.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), X.as_flag(raw).alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


@query("symbol_search", "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), lower('R#00000001')) OR contains(CAST(s_suppkey AS VARCHAR), '4')")
def _(spark, d):
    s = S.table(spark, d, "supplier")
    return s.filter(F.contains(F.lower("s_name"), F.lower(F.lit("R#00000001"))) | F.contains(F.col("s_suppkey").cast("string"), F.lit("4"))).select("s_suppkey", "s_name")


@query("peers_of_symbol", "SELECT symbol AS peer, count(*) AS shared FROM mentions WHERE news_id IN (SELECT news_id FROM mentions WHERE symbol = 1) AND symbol <> 1 GROUP BY 1 ORDER BY shared DESC, peer LIMIT 10")
def _(spark, d):
    m = S.mentions(spark, d)
    own = m.filter("symbol = 1").select("news_id")
    return m.join(own, "news_id", "left_semi").filter("symbol <> 1").groupBy(F.col("symbol").alias("peer")).agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), "peer").limit(10)


@query("industry_peers", "SELECT symbol, CAST(greatest(count(*) OVER (PARTITION BY industry) - 1, 0) AS BIGINT) AS peers FROM dictionary")
def _(spark, d):
    x = S.dictionary(spark, d)
    sizes = x.groupBy("industry").agg(F.count_distinct("symbol").alias("n"))
    return x.join(sizes, "industry").select("symbol", F.greatest(F.col("n") - 1, F.lit(0)).alias("peers"))


@query("order_book", "SELECT l_suppkey AS symbol, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS bid, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS ask, round(coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 0), 6) AS bid_share FROM lineitem GROUP BY 1")
def _(spark, d):
    side = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")).otherwise(0.0))
    g = S.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(side("O").alias("bid"), side("F").alias("ask"), F.sum("l_quantity").alias("all"))
    return g.select("symbol", "bid", "ask", F.round(F.coalesce(F.try_divide("bid", "all"), F.lit(0.0)), 6).alias("bid_share"))


@query("role_counts", "SELECT count(*) AS users, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS admins, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0) AS active_admins, array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN 'negative' END, CASE WHEN count(*) > 10 THEN 'many' END], lambda x: x IS NOT NULL), ',') AS alerts FROM customer")
def _(spark, d):
    admin = F.col("c_mktsegment") == "MACHINERY"
    g = S.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("users"), F.count_if(admin).alias("admins"), F.count_if(admin & (F.col("c_acctbal") > 0)).alias("active_admins"), F.count_if(F.col("c_acctbal") < 0).alias("below"))
    alerts = F.array_compact(F.array(F.when(F.col("below") > 0, "negative"), F.when(F.col("users") > 10, "many")))
    return g.select("users", "admins", "active_admins", F.array_join(alerts, ",").alias("alerts"))


@query("keyword_groups", "SELECT event_type, count(*) AS keywords, count(*) FILTER (WHERE value > 10) AS active, min(props) AS first_keyword FROM events GROUP BY 1")
def _(spark, d):
    return S.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("keywords"), F.count_if(F.col("value") > 10).alias("active"), F.min("props").alias("first_keyword"))


@query("refused_tally", "SELECT status, event_type, count(*) AS n, round(avg(impact), 4) AS mean_impact FROM articles WHERE status IN ('O', 'F') GROUP BY GROUPING SETS ((status, event_type), (status))")
def _(spark, d):
    # Predictions by event and the tally by status in one pass.
    a = S.articles(spark, d).filter(F.col("status").isin("O", "F"))
    return a.rollup("status", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("impact"), 4).alias("mean_impact")).filter("status is not null")


@query("symbols_per_article", "SELECT news_id, symbol, count(*) OVER (PARTITION BY news_id) AS symbols FROM mentions")
def _(spark, d):
    return S.mentions(spark, d).withColumn("symbols", F.count(F.lit(1)).over(Window.partitionBy("news_id"))).select("news_id", "symbol", "symbols")


@query("first_of_group", "SELECT owner, arg_min(news_id, (day, news_id)) AS news_id, min(day) AS day, arg_min(event_type, (day, news_id)) AS event_type FROM articles GROUP BY 1")
def _(spark, d):
    first = F.min(F.struct("day", "news_id", "event_type")).alias("f")
    return S.articles(spark, d).groupBy("owner").agg(first).select("owner", "f.news_id", "f.day", "f.event_type")


@query("review_queue", "SELECT news_id, day, CASE WHEN event_type = '1-URGENT' THEN 'CRITICAL' WHEN event_type <> '5-LOW' THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM articles ORDER BY CASE WHEN event_type = '1-URGENT' THEN 0 WHEN event_type <> '5-LOW' THEN 1 ELSE 2 END, day DESC, news_id LIMIT 100")
def _(spark, d):
    event = F.when(F.col("event_type") == "5-LOW", "OTHER").otherwise(F.col("event_type"))
    rows = S.articles(spark, d).select("news_id", "day", X.review_priority(event, ["1-URGENT"]).alias("priority"))
    place = F.when(F.col("priority") == "CRITICAL", 0).when(F.col("priority") == "HIGH", 1).otherwise(2)
    return rows.orderBy(place, F.desc("day"), "news_id").limit(100)


@query("news_label", r"SELECT page_id, CASE WHEN length(t) <= 42 THEN t ELSE rtrim(substring(t, 1, 41)) || '…' END AS label FROM (SELECT page_id, trim(regexp_replace(url, '[/_-]+', ' ', 'g')) AS t FROM pages)")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.short_label(F.regexp_replace("url", "[/_-]+", " "), F.concat(F.lit("#"), "page_id")).alias("label"))


# A fold with a state: tests hold it against plain Python.
@query("content_preview")
def _(spark, d):
    p = X.preview(F.col("text"))
    return S.table(spark, d, "documents").select("doc_id", p.alias("p")).select("doc_id", F.array_join("p.paragraphs", "\n").alias("preview"), "p.truncated")


@query("market_open", "SELECT event_id, dayofweek(ts + INTERVAL 7 HOURS) BETWEEN 1 AND 5 AND (hour(ts + INTERVAL 7 HOURS) * 60 + minute(ts + INTERVAL 7 HOURS) BETWEEN 540 AND 690 OR hour(ts + INTERVAL 7 HOURS) * 60 + minute(ts + INTERVAL 7 HOURS) BETWEEN 780 AND 885) AS open FROM events")
def _(spark, d):
    return S.table(spark, d, "events").select("event_id", X.market_open(F.col("ts")).alias("open"))


@query("evidence_score", """SELECT news_id, symbol, CAST((CASE WHEN sentiment = 'Positive' THEN 25 ELSE 0 END) + (CASE WHEN event_type LIKE '1%' THEN 20 ELSE 0 END) + 15 + 10 + (CASE WHEN owner % 2 = 0 THEN 10 ELSE 0 END) + (CASE WHEN event_type <> '5-LOW' THEN 10 ELSE 0 END) + (CASE WHEN impact > 200000 THEN 10 ELSE 0 END) AS INT) AS points FROM dated""")
def _(spark, d):
    m = S.dated_mentions(spark, d)
    points = X.evidence_points(
        F.when(F.col("sentiment") == "Positive", "HIGH_PRECISION"), F.when(F.col("event_type").startswith("1"), "TITLE_EXACT"), F.col("sentiment"), F.col("symbol").cast("string"),
        F.when(F.col("owner") % 2 == 0, "url").otherwise(" "), F.when(F.col("event_type") == "5-LOW", "OTHER").otherwise(F.col("event_type")), F.when(F.col("impact") > 200000, "HIGH"),
    )
    return m.select("news_id", "symbol", points.alias("points"))


@query("live_quotes", "SELECT p_partkey, price, CASE WHEN ref <> 0 THEN round(price - ref, 2) ELSE 0 END AS change FROM (SELECT *, CASE WHEN own = 0 THEN ref ELSE own END AS price FROM (SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS DOUBLE) AS own, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 10 END AS DOUBLE) AS ref FROM part))")
def _(spark, d):
    own = F.when(F.col("p_size") % 3 == 0, "none").otherwise(F.col("p_size").cast("string"))
    ref = F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("string")).otherwise("10")
    return S.table(spark, d, "part").select("p_partkey", X.quote(own, ref).alias("q")).select("p_partkey", "q.price", "q.change")


@query("settings_number", "SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)[}]', 1) AS DOUBLE), 0.6) AS value FROM events")
def _(spark, d):
    return S.table(spark, d, "events").select("event_id", X.as_number(F.get_json_object("props", "$.k"), 0.6).alias("value"))


@query("numeric_view", """, r AS (SELECT c_custkey, CASE WHEN c_nationkey % 4 <> 0 THEN c_acctbal END AS x FROM customer), m AS (SELECT coalesce(quantile_cont(x, 0.5), 0) AS m FROM r WHERE c_custkey % 5 < 4)
 SELECT c_custkey, round(ln(1 + greatest(coalesce(x, m), 0)), 9) AS value FROM r, m""")
def _(spark, d):
    rows = S.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_acctbal")).alias("x"))
    # The median is of the training rows alone.
    median = percentiles(rows.filter("c_custkey % 5 < 4"), "x", [0.5])[0] or 0.0
    return rows.select("c_custkey", F.round(F.log1p(F.greatest(F.coalesce("x", F.lit(median)), F.lit(0.0))), 9).alias("value"))


@query("date_parts", "SELECT news_id, strftime(day, '%Y-%m-%d') AS iso, substring(strftime(day, '%Y-%m-%d') || 'T00:00', 1, 10) AS prefix, TRY_CAST(CASE WHEN owner % 2 = 0 THEN strftime(day, '%Y-%m-%d') ELSE 'soon' END AS DATE) AS parsed FROM articles")
def _(spark, d):
    iso = F.date_format("day", "yyyy-MM-dd")
    raw = F.when(F.col("owner") % 2 == 0, iso).otherwise("soon")
    return S.articles(spark, d).select("news_id", iso.alias("iso"), F.substring(F.concat(iso, F.lit("T00:00")), 1, 10).alias("prefix"), raw.try_cast("date").alias("parsed"))


@query("symbol_hints", "SELECT news_id, 'see' || chr(10) || chr(10) || string_agg(symbol, ', ' ORDER BY symbol) AS text FROM (SELECT DISTINCT news_id, CAST(symbol AS VARCHAR) AS symbol FROM mentions) GROUP BY 1")
def _(spark, d):
    # An article holds at most seven symbols.
    g = S.mentions(spark, d).groupBy("news_id").agg(F.collect_set(F.col("symbol").cast("string")).alias("s"))
    return g.select("news_id", X.with_symbols(F.lit("see"), F.col("s")).alias("text"))


@query("primary_symbol", "SELECT news_id, coalesce(min(symbol) FILTER (WHERE sentiment = 'Positive'), min(symbol)) AS symbol FROM mentions GROUP BY 1")
def _(spark, d):
    row = F.struct("symbol", F.when(F.col("sentiment") == "Positive", "PRIMARY").otherwise("OTHER").alias("focus"))
    g = S.mentions(spark, d).groupBy("news_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return g.select("news_id", X.primary(F.col("rows"))["symbol"].alias("symbol"))
