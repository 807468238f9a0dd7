"""Queries of names, addresses, JSON, reviews, lists that grow, and the questions that the graph must answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import rows as R
from quillgraph.functions import text as X
from quillgraph.operators import upserts as U
from quillgraph.plans.catalog import _EDGES, _edges
from quillgraph.plans.registry import query
from quillgraph.sources import sinks as K
from quillgraph.sources import tables as S


@query("short_company", """, n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Công ty Cổ phần Tập đoàn ' || p_name WHEN 1 THEN 'Tổng Công ty ' || p_name || ' (' || p_brand || ')' WHEN 2 THEN 'Ngân hàng TMCP (' || p_type || ')' ELSE p_name || ' of a name much too long' END AS name, p_type AS symbol FROM part),
 b AS (SELECT *, trim(regexp_extract(name, '\\((.*)\\)', 1)) AS brand, CASE WHEN starts_with(name, 'Ngân hàng TMCP ') THEN 'NH ' || substring(name, 16) WHEN starts_with(name, 'Tổng Công ty ') THEN 'TCT ' || substring(name, 14) WHEN starts_with(name, 'Công ty Cổ phần Tập đoàn ') THEN 'CTCP TĐ ' || substring(name, 26) ELSE name END AS short FROM n)
 SELECT p_partkey, CASE WHEN length(brand) BETWEEN 2 AND 28 AND upper(brand) <> upper(symbol) THEN brand WHEN length(short) <= 28 THEN short ELSE rtrim(substring(short, 1, 27)) || '…' END AS label FROM b""")
def _(spark, d):
    p, kind, name = S.table(spark, d, "part"), F.col("p_size") % 4, F.col("p_name")
    full = F.when(kind == 0, F.concat(F.lit("Công ty Cổ phần Tập đoàn "), name)).when(kind == 1, F.concat(F.lit("Tổng Công ty "), name, F.lit(" ("), "p_brand", F.lit(")"))).when(kind == 2, F.concat(F.lit("Ngân hàng TMCP ("), "p_type", F.lit(")"))).otherwise(F.concat(name, F.lit(" of a name much too long")))
    return p.select("p_partkey", R.short_company(full, F.col("p_type")).alias("label"))


@query("normalised_names", "SELECT event_id, upper(left(event_type, 1)) || lower(substring(event_type, 2)) || ' Of User' AS label, upper(event_type) AS symbol, lower(upper(event_type)) AS alias FROM events")
def _(spark, d):
    e = S.table(spark, d, "events")
    return e.select("event_id", R.label_of(F.concat("event_type", F.lit("_of_user"))).alias("label"), R.symbol_of(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("symbol"), F.lower(F.upper("event_type")).alias("alias"))


@query("title_names_symbol", "SELECT p_partkey, regexp_matches(upper(p_name), '(^|[^A-Z0-9])' || split_part(upper(p_name), ' ', 2) || '($|[^A-Z0-9])') AS whole, regexp_matches(upper(p_name), '(^|[^A-Z0-9])' || left(split_part(upper(p_name), ' ', 2), 3) || '($|[^A-Z0-9])') AS part FROM part")
def _(spark, d):
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    return S.table(spark, d, "part").select("p_partkey", R.names_symbol(F.col("p_name"), second).alias("whole"), R.names_symbol(F.col("p_name"), F.left(second, F.lit(3))).alias("part"))


@query("canonical_json", """SELECT c_custkey, '{"name":"' || c_name || '","nation":"' || CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END || '"}' AS payload FROM customer""")
def _(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", R.canonical_json(nation=F.when(F.col("c_nationkey") % 2 != 0, F.col("c_nationkey")), name=F.col("c_name")).alias("payload"))


@query("json_attributes", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN regexp_extract(props, '([0-9]+)[}]', 1) END AS k FROM events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, "not {json").otherwise(F.col("props"))
    return S.table(spark, d, "events").select("event_id", R.attribute(raw, "k").alias("k"))


@query("first_nonempty", "SELECT user_id, coalesce(arg_min(event_type, (ts, event_id)) FILTER (WHERE value > 20), '') AS first FROM events GROUP BY 1")
def _(spark, d):
    value = F.when(F.col("value") > 20, F.col("event_type")).otherwise("  ")
    return S.table(spark, d, "events").groupBy("user_id").agg(R.first_nonempty(value, F.col("ts"), F.col("event_id")).alias("first"))


_REVIEW = """, review AS (SELECT news_id, CASE news_id % 4 WHEN 0 THEN 'yes ' WHEN 1 THEN 'NO' WHEN 2 THEN NULL ELSE 'perhaps' END AS correct, status AS auto, CASE WHEN owner % 2 = 0 THEN 'O' ELSE 'none' END AS corrected FROM articles)"""


def _review(spark, d):
    k = F.col("news_id") % 4
    return S.articles(spark, d).select("news_id", F.when(k == 0, "yes ").when(k == 1, "NO").when(k == 3, "perhaps").alias("correct"), F.col("status").alias("auto"), F.when(F.col("owner") % 2 == 0, "O").otherwise("none").alias("corrected"))


@query("reviewer_truth", _REVIEW + "SELECT news_id, CASE WHEN upper(trim(correct)) = 'YES' THEN auto ELSE corrected END AS truth FROM review")
def _(spark, d):
    return _review(spark, d).select("news_id", R.reviewer_truth(F.col("correct"), F.col("auto"), F.col("corrected")).alias("truth"))


@query("review_faults", _REVIEW + """SELECT * FROM (SELECT news_id, CASE WHEN correct IS NULL OR upper(trim(correct)) NOT IN ('YES', 'NO') THEN 'correctness must be YES or NO' WHEN upper(trim(correct)) = 'NO' AND upper(corrected) NOT IN ('O', 'F', 'P') THEN 'corrected label missing or unknown' END AS fault FROM review) WHERE fault IS NOT NULL""")
def _(spark, d):
    return _review(spark, d).select("news_id", R.review_fault(F.col("correct"), F.col("corrected"), ["O", "F", "P"]).alias("fault")).filter("fault is not null")


@query("lean", "SELECT news_id, u >= v AS up, round(CASE WHEN u + v > 0 THEN greatest(u, v) / (u + v) ELSE 0.5 END, 6) AS share, CASE WHEN u + v > 0 THEN abs(u / (u + v) - 0.5) < 0.03 ELSE true END AS coin_flip FROM (SELECT news_id, owner % 7 / 10.0::DOUBLE AS u, news_id % 5 / 10.0::DOUBLE AS v FROM articles)")
def _(spark, d):
    up, down = F.col("owner") % 7 / F.lit(10.0), F.col("news_id") % 5 / F.lit(10.0)
    found = R.lean(up, down)
    return S.articles(spark, d).select("news_id", found["up"].alias("up"), F.round(found["share"], 6).alias("share"), R.coin_flip(F.coalesce(F.try_divide(up, up + down), F.lit(0.5))).alias("coin_flip"))


@query("url_faults", """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'scheme' WHEN 1 THEN 'empty' WHEN 2 THEN 'inner address' WHEN 3 THEN 'host' WHEN 4 THEN 'inner address' WHEN 5 THEN CASE WHEN page_id % 256 BETWEEN 16 AND 31 THEN 'inner address' END END AS fault FROM pages""")
def _(spark, d):
    k = F.col("page_id") % 8
    url = F.when(k == 0, "ftp://a.example.com/").when(k == 1, " ").when(k == 2, "http://user@127.0.0.1:80/x").when(k == 3, "https:///x").when(k == 4, "http://[::1]/").when(k == 5, F.concat(F.lit("http://172."), F.col("page_id") % 256, F.lit(".0.1/"))).otherwise(F.col("url"))
    return S.table(spark, d, "pages").select("page_id", R.url_fault(url).alias("fault"))


@query("finite_rows", "SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 2")
def _(spark, d):
    k = F.col("c_nationkey") % 3
    rows = S.table(spark, d, "customer").select("c_custkey", "c_acctbal", F.when(k == 0, float("nan")).when(k == 2, F.col("c_acctbal")).alias("close"), F.when(k == 1, float("inf")).otherwise(F.col("c_acctbal")).alias("high"))
    return rows.filter(R.finite("c_acctbal", "close", "high")).select("c_custkey")


@query("yearly_values", "SELECT event_type, CAST(year(day) AS VARCHAR) AS year, round(sum(impact), 2) AS total FROM articles WHERE year(day) IN (1996, 1995) GROUP BY ALL")
def _(spark, d):
    wide = S.articles(spark, d).withColumn("year", F.year("day").cast("string")).groupBy("event_type").pivot("year", ["1995", "1996"]).agg(F.round(F.sum("impact"), 2))
    return wide.unpivot(["event_type"], R.year_columns(wide.columns), "year", "total").filter("total is not null")


# The columns are chosen by name, which SQL over the table cannot judge: a test holds this against plain Python.
@query("leaking_columns")
def _(spark, d):
    orders = S.table(spark, d, "orders")
    found = R.leaking_columns(orders.columns, ["price"], ["o_orders"])
    filled = orders.agg(*[F.count(c).alias(c) for c in found])
    return filled.unpivot([], found, "name", "filled")


@query("rows_of_list", "SELECT news_id, status FROM articles WHERE news_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def _(spark, d):
    asked = S.table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("news_id"))
    return S.articles(spark, d).select("news_id", "status").join(asked, "news_id", "left_semi")


@query("watchlist_quotes", "SELECT c_custkey, rank_at, p_retailprice AS price FROM (SELECT c_custkey, c_acctbal AS rank_at, c_custkey * 3 AS p_partkey FROM customer) JOIN part USING (p_partkey) ORDER BY rank_at, c_custkey")
def _(spark, d):
    listed = S.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("rank_at"), (F.col("c_custkey") * 3).alias("p_partkey"))
    return listed.join(S.table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price")), "p_partkey").select("c_custkey", "rank_at", "price").orderBy("rank_at", "c_custkey")


@query("article_authors", "SELECT o_orderkey AS news_id, a.c_name AS author, b.c_name AS labelled_by FROM orders JOIN customer a ON o_custkey = a.c_custkey LEFT JOIN customer b ON o_orderkey % 4000 = b.c_custkey")
def _(spark, d):
    c, o = S.table(spark, d, "customer"), S.articles(spark, d)
    authors = c.select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("author"))
    markers = c.select(F.col("c_custkey").alias("marker"), F.col("c_name").alias("labelled_by"))
    return o.select("news_id", "owner", (F.col("news_id") % 4000).alias("marker")).join(authors, "owner").join(markers, "marker", "left").select("news_id", "author", "labelled_by")


@query("pending_jobs", "SELECT event_type, count(*) AS total, count(*) FILTER (WHERE status <> 'P') AS analysed, count(*) FILTER (WHERE status = 'P') AS pending FROM articles GROUP BY 1 ORDER BY 1")
def _(spark, d):
    g = S.articles(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "P").alias("analysed"))
    return g.withColumn("pending", F.col("total") - F.col("analysed")).orderBy("event_type")


@query("keyword_patterns", "SELECT source, lang, contains(lower(text), 'the') AS hit, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    # No keyword is active, so the built-in list holds.
    keywords = spark.createDataFrame([("noise", "And", False)], "event string, keyword string, active boolean")
    found = X.events(F.col("text"), U.pattern_map(keywords, {"article": ["the"]}))
    return S.table(spark, d, "documents").groupBy("source", "lang", (F.size(found) > 0).alias("hit")).agg(F.count(F.lit(1)).alias("n"))


@query("entity_industries", "SELECT news_id, string_agg(industry, ',' ORDER BY place, industry) AS industries FROM (SELECT news_id, industry, min(place) AS place FROM (SELECT DISTINCT news_id, industry, 0 AS place FROM mentions JOIN dictionary USING (symbol) UNION ALL SELECT news_id, CASE WHEN event_type LIKE '1%' THEN 'FRANCE' ELSE 'CHINA' END, 1 FROM articles) GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    # Industries of the dictionary first, then those of keywords; an article holds at most seven symbols.
    own = S.mentions(spark, d).join(S.dictionary(spark, d), "symbol").groupBy("news_id").agg(F.array_sort(F.collect_set("industry")).alias("known"))
    cued = F.array(F.when(F.col("event_type").startswith("1"), "FRANCE").otherwise("CHINA"))
    both = F.array_distinct(F.concat(F.coalesce("known", F.array().cast("array<string>")), cued))
    return S.articles(spark, d).select("news_id", "event_type").join(own, "news_id", "left").select("news_id", F.array_join(both, ",").alias("industries"))


@query("price_cache", "SELECT symbol, day, close, day >= DATE '1995-01-01' OR symbol IN ('Brand#1', 'Brand#2') AS fresh FROM panel")
def _(spark, d):
    panel = S.price_panel(spark, d)
    held = panel.filter("day < '1995-01-01' and symbol not in ('Brand#1', 'Brand#2')")
    return U.extend(held.withColumn("fresh", F.lit(False)), panel.withColumn("fresh", F.lit(True)), ["symbol", "day"])


@query("missing_prices", "SELECT DISTINCT symbol FROM panel WHERE symbol IN ('Brand#1', 'Brand#2')")
def _(spark, d):
    panel = S.price_panel(spark, d)
    return U.missing_keys(panel, panel.filter("symbol not in ('Brand#1', 'Brand#2')"), "symbol")


@query("merged_dictionary", "SELECT symbol, CASE WHEN symbol % 2 = 0 THEN 'curated' ELSE industry END AS industry, exchange FROM dictionary WHERE symbol % 7 <> 0 ORDER BY symbol")
def _(spark, d):
    x = S.dictionary(spark, d)
    curated = x.filter("symbol % 2 = 0").select("symbol", F.lit("curated").alias("industry"), F.lit(None).cast("string").alias("exchange"))
    return U.merged_dictionary(x, curated, x.filter("symbol % 7 = 0"), "symbol", ["industry", "exchange"]).orderBy("symbol")


@query("watchlist_additions", "SELECT DISTINCT owner, symbol FROM dated WHERE symbol IN (SELECT symbol FROM dictionary WHERE exchange <> 'ASIA') AND NOT (owner % 2 = 0 AND sentiment = 'Positive') EXCEPT SELECT owner, symbol FROM dated WHERE owner % 2 = 0 AND sentiment = 'Positive'")
def _(spark, d):
    dated = S.dated_mentions(spark, d)
    return U.additions(dated, dated.filter("owner % 2 = 0 and sentiment = 'Positive'").distinct(), S.dictionary(spark, d).filter("exchange <> 'ASIA'"), ["owner", "symbol"], "symbol")


@query("failed_analyses", "SELECT news_id, CASE WHEN status <> 'P' THEN event_type END AS prediction, CASE WHEN status = 'P' THEN 'ERROR' ELSE 'SCORED' END AS decision, true AS is_analyzed, status = 'P' OR owner % 5 = 0 AS needs_review FROM articles")
def _(spark, d):
    rows = S.articles(spark, d).select("news_id", F.when(F.col("status") == "P", "timeout").alias("error"), F.col("event_type").alias("prediction"), F.lit("SCORED").alias("decision"), F.lit(False).alias("is_analyzed"), (F.col("owner") % 5 == 0).alias("needs_review"))
    return U.failed(rows, "error").drop("error")


@query("review_template", "SELECT doc_id, substring(trim(regexp_replace(text, '[\\s\\x{a0}]+', ' ', 'g')), 1, 700) AS preview, '' AS reviewer, '' AS is_correct, '' AS corrected FROM documents")
def _(spark, d):
    blank = [F.lit("").alias(c) for c in ("reviewer", "is_correct", "corrected")]
    return S.table(spark, d, "documents").select("doc_id", F.substring(X.clean(F.col("text")), 1, 700).alias("preview"), *blank)


@query("comention_counts_by_date", """, p AS (SELECT a.symbol AS a, b.symbol AS b, min(a.day) AS day FROM dated a JOIN dated b USING (news_id) WHERE a.symbol < b.symbol GROUP BY 1, 2), k AS (SELECT p.day, count(*) AS n FROM p JOIN dictionary x ON p.a = x.symbol JOIN dictionary y ON p.b = y.symbol WHERE x.industry <> y.industry GROUP BY 1), days AS (SELECT DISTINCT day FROM articles),
 fixed AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS edges, CAST(sum(n) AS BIGINT) AS nodes FROM (SELECT count(*) AS n FROM dictionary GROUP BY industry))
 SELECT day, nodes, CAST(edges + coalesce(sum(n) OVER (ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS edges FROM days LEFT JOIN k USING (day), fixed""")
def _(spark, d):
    """Nodes and edges of the projection of symbols as it stands before each day: pairs of one industry, and pairs named together earlier."""
    dated, x = S.dated_mentions(spark, d), S.dictionary(spark, d).select("symbol", "industry")
    named = dated.select("news_id", "symbol", "day").join(x, "symbol")
    one, two = (named.select("news_id", F.col("day"), F.col("symbol").alias(s), F.col("industry").alias(f"of_{s}")) for s in ("a", "b"))
    pairs = one.join(two.drop("day"), "news_id").filter("a < b and of_a <> of_b").groupBy("a", "b").agg(F.min("day").alias("day"))
    new = pairs.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    fixed = x.groupBy("industry").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("nodes"), F.sum(F.expr("n * (n - 1) div 2")).alias("edges"))
    # One row a calendar day: the window has as many rows as the years have days.
    before = Window.orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, -1)
    daily = S.articles(spark, d).select("day").distinct().join(new, "day", "left").withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return daily.join(F.broadcast(fixed)).select("day", "nodes", (F.col("edges") + F.col("earlier")).alias("edges"))


def _share(rows: DataFrame, question: str, good, least: float = 1.0) -> DataFrame:
    return _answer(rows.agg(F.count_if(good).alias("numerator"), F.count(F.lit(1)).alias("denominator")), question, least)


def _answer(g: DataFrame, question: str, least: float = 1.0) -> DataFrame:
    value = F.round(F.coalesce(F.try_divide("numerator", "denominator"), F.lit(0.0)), 6)
    return g.select(F.lit(question).alias("question"), "numerator", "denominator", value.alias("value"), F.when(value >= least, "PASS").otherwise("FAIL").alias("status"))


@query("competency_questions", _EDGES + """, e AS (SELECT DISTINCT src, dst, relation FROM edges), pairs AS (SELECT DISTINCT news_id, symbol FROM dated), told AS (SELECT src, relation, count(*) AS n FROM e GROUP BY 1, 2), news AS (SELECT DISTINCT 'news_' || news_id AS src FROM dated),
 q AS (SELECT 'CQ01' AS question, count(e.src) AS numerator, count(*) AS denominator FROM pairs LEFT JOIN e ON e.relation = 'mentions' AND e.src = 'news_' || news_id AND e.dst = 'stock_' || symbol
 UNION ALL SELECT 'CQ02', count(*) FILTER (WHERE s.n = 1 AND v.n = 1), count(*) FROM news LEFT JOIN told s ON s.src = news.src AND s.relation = 'has_sentiment' LEFT JOIN told v ON v.src = news.src AND v.relation = 'contains_event'
 UNION ALL SELECT 'CQ03', count(*) FILTER (WHERE t.n = 1), count(*) FROM dictionary LEFT JOIN told t ON t.src = 'stock_' || symbol AND t.relation = 'belongs_to'
 UNION ALL SELECT 'CQ04', count(e.src), count(*) FROM (SELECT DISTINCT news_id, event_type FROM dated) LEFT JOIN e ON e.relation = 'contains_event' AND e.src = 'news_' || news_id AND e.dst = 'event_' || event_type
 UNION ALL SELECT 'CQ06', count(*) FILTER (WHERE x.industry = substring(dst, 10)), count(*) FROM e LEFT JOIN dictionary x ON e.src = 'stock_' || x.symbol WHERE relation = 'belongs_to'
 UNION ALL SELECT 'CQ08', count(*) FILTER (WHERE split_part(dst, '_', 1) = 'sentiment'), count(*) FROM e WHERE relation = 'has_sentiment'
 UNION ALL SELECT 'CQ10', count(e.dst), count(*) FROM (SELECT DISTINCT symbol FROM dated) LEFT JOIN (SELECT DISTINCT dst FROM e WHERE relation = 'mentions') e ON e.dst = 'stock_' || symbol)
 SELECT *, round(coalesce(numerator / nullif(denominator, 0), 0), 6) AS value, CASE WHEN round(coalesce(numerator / nullif(denominator, 0), 0), 6) >= 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM q""")
def _(spark, d):
    e, dated, x = _edges(spark, d), S.dated_mentions(spark, d), S.dictionary(spark, d)
    node = lambda kind, c: F.concat(F.lit(kind + "_"), F.col(c).cast("string"))
    # Edges, and the rows that should have one, are dealt by their source once, in tasks by the table's size.
    wanted = lambda kind, c, relation: F.struct(node("news", "news_id").alias("src"), node(kind, c).alias("dst"), F.lit(relation).alias("relation"))
    asked = dated.select(F.explode(F.array(wanted("stock", "symbol", "mentions"), wanted("event", "event_type", "contains_event"))).alias("a")).select("a.*", F.lit(False).alias("edge"))
    both = S.dealt(spark, d, "lineitem", e.select("src", "dst", "relation", F.lit(True).alias("edge")).unionByName(asked), "src")
    rows = both.groupBy("src", "dst", "relation").agg(F.bool_or("edge").alias("edge"), F.bool_or(~F.col("edge")).alias("asked"))
    is_, there, asks = lambda relation: F.col("relation") == relation, F.col("edge") & F.col("dst").isNotNull(), F.col("asked")
    by_source = rows.groupBy("src").agg(
        F.count_if(asks & there & is_("mentions")).alias("n1"), F.count_if(asks & is_("mentions")).alias("d1"), F.count_if(asks & there & is_("contains_event")).alias("n4"), F.count_if(asks & is_("contains_event")).alias("d4"),
        F.count_if(F.col("edge") & is_("contains_event")).alias("events"), F.count_if(F.col("edge") & is_("has_sentiment")).alias("d8"), F.count_if(F.col("edge") & is_("has_sentiment") & F.col("dst").startswith("sentiment_")).alias("n8"),
    )
    one = (F.col("d8") == 1) & (F.col("events") == 1)
    sums = by_source.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "d1", "n4", "d4", "n8", "d8")], F.count_if((F.col("d1") > 0) & one).alias("n2"), F.count_if(F.col("d1") > 0).alias("d2"))
    sums = K.cut(sums)
    whole = lambda k: _answer(sums.select(F.col(f"n{k}").alias("numerator"), F.col(f"d{k}").alias("denominator")), f"CQ0{k}")
    # Of these edges only what symbols bound is kept.
    few = e.filter(is_("belongs_to") | is_("mentions")).select(F.when(is_("belongs_to"), F.col("src")).alias("src"), "dst", "relation").distinct()
    few = K.cut(few)
    belongs, met = few.filter(is_("belongs_to")).select("src", "dst"), few.filter(is_("mentions")).select("dst", F.lit(True).alias("there"))
    stocks = x.select(node("stock", "symbol").alias("src"), "industry")
    named = dated.select(node("stock", "symbol").alias("dst")).distinct().join(met, "dst", "left")
    parts = [
        whole(1), whole(2), _share(stocks.join(belongs.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src", "left"), "CQ03", F.col("n") == 1), whole(4),
        _share(belongs.join(stocks, "src", "left"), "CQ06", F.col("dst") == node("industry", "industry")), whole(8), _share(named, "CQ10", F.col("there").isNotNull()),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("readiness", "SELECT bool_and(ok) AS ready, count(*) AS reports, string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT ok) AS open FROM (SELECT event_type AS name, avg(impact) > 150000 AND count(*) FILTER (WHERE status = 'P') * 100 < count(*) * 34 AS ok FROM articles GROUP BY 1)")
def _(spark, d):
    # One report for each event: its gates, then all reports together.
    ok = (F.avg("impact") > 150000) & (F.count_if(F.col("status") == "P") * 100 < F.count(F.lit(1)) * 34)
    reports = S.articles(spark, d).groupBy(F.col("event_type").alias("name")).agg(ok.alias("ok"))
    names = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ",")
    return reports.agg(F.bool_and("ok").alias("ready"), F.count(F.lit(1)).alias("reports"), F.nullif(names, F.lit("")).alias("open"))
