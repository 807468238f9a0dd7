"""Queries of evaluation: weights, returns, ensembles, intervals of a difference, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import audit as A
from quillgraph.operators import metrics as M
from quillgraph.operators import temporal as W
from quillgraph.operators.spans import epoch_day
from quillgraph.plans.catalog import _GRADES, _PAIRS, _grades, _pairs
from quillgraph.plans.registry import query
from quillgraph.sources import tables as S


@query("weighted_metrics", _GRADES + """, c AS (SELECT k, sum(CAST(impact AS DECIMAL(18, 2))) FILTER (WHERE truth = k) AS s, sum(CAST(impact AS DECIMAL(18, 2))) FILTER (WHERE predicted = k) AS g,
 sum(CAST(impact AS DECIMAL(18, 2))) FILTER (WHERE truth = k AND predicted = k) AS tp FROM grades, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY 1), d AS (SELECT CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(g, 0) AS DOUBLE) AS g, CAST(coalesce(tp, 0) AS DOUBLE) AS tp FROM c)
 SELECT round(sum(tp) / sum(s), 6) AS weighted_accuracy, round(avg(2 * tp / (s + g)), 6) AS macro_f1 FROM d WHERE s + g > 0""")
def _(spark, d):
    return M.weighted(_grades(spark, d), F.col("impact").cast("decimal(18,2)"))


@query("class_mean_return", _GRADES + "SELECT truth, count(*) AS n, round(avg(impact), 4) AS mean_return FROM grades WHERE day < DATE '1996-01-01' GROUP BY 1")
def _(spark, d):
    train = _grades(spark, d).filter(F.col("day") < F.lit("1996-01-01").cast("date"))
    return train.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("impact"), 4).alias("mean_return"))


@query("hit_rates", """, s AS (SELECT close, lag(close) OVER w AS before, lead(close, 3) OVER w AS later FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 r AS (SELECT later / close - 1 AS realised, close < before AS up, before FROM s WHERE later IS NOT NULL AND before IS NOT NULL AND close <> 0), l AS (SELECT *, up = (realised > 0) AS hit FROM r WHERE abs(realised) >= 0.02)
 SELECT count(*) AS n, round(avg(CAST(hit AS INT)), 6) AS hit_rate, round(avg(CAST(realised > 0 AS INT)), 6) AS base_rate, round(avg(abs(realised)), 6) AS mean_move, round(0.5 + 0.004 / (2 * avg(abs(realised))), 6) AS break_even FROM l""")
def _(spark, d):
    moves = W.moves(S.price_panel(spark, d)).filter(F.abs("realised") >= 0.02)
    return M.hit_rates(moves, "up", "realised", cost=0.004)


@query("band_verdict", """, b AS (SELECT least(CAST(floor(l_discount * 50) AS INT), 4) AS band, count(*) AS n, avg(l_discount) * 10 AS mean, avg(CAST(l_returnflag = 'R' AS INT)) AS share FROM lineitem GROUP BY 1), c AS (SELECT *, lag(share) OVER (ORDER BY band) AS before FROM b)
 SELECT count(*) AS bands, CASE WHEN count(*) < 2 OR NOT bool_and(coalesce(share > before, true)) THEN 'DOES_NOT_RANK' WHEN avg(mean - share) > 0 THEN 'RANKS_WELL_BUT_OVERSTATES_LEVEL' ELSE 'RANKS_WELL' END AS verdict FROM c""")
def _(spark, d):
    band = F.least(F.floor(F.col("l_discount") * 50).cast("int"), F.lit(4))
    bands = S.table(spark, d, "lineitem").groupBy(band.alias("band")).agg((F.avg("l_discount") * 10).alias("mean"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("share"))
    return M.band_verdict(bands)


@query("ensemble", """, e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [(l_discount + l_tax) / 2, (l_tax + 0.04) / 2, (0.05 + l_discount) / 2] AS p FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(list_position(p, list_max(p)) AS INT) AS best, round(p[1] * -0.03 + p[2] * 0.001 + p[3] * 0.04 - 0.004, 9) AS expected_net FROM e""")
def _(spark, d):
    one = F.array("l_discount", "l_tax", F.lit(0.05))
    two = F.array("l_tax", F.lit(0.04), "l_discount")
    e = S.table(spark, d, "lineitem").withColumn("p", M.mean_probability(one, two))
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.best_class(F.col("p")).alias("best"), F.round(M.expected_net(F.col("p"), (-0.03, 0.001, 0.04), 0.004), 9).alias("expected_net"))


# Against a plain guess of the other class, resampled by source.
_DELTA = _PAIRS + """, u AS (SELECT c, s, n, draw, (CAST('0x' || substring(md5(c || '|' || draw || '|7'), 1, 10) AS BIGINT) + 0.5) / 1099511627776.0 AS u FROM
 (SELECT source AS c, sum(CAST(truth = predicted AS INT) - CAST(truth = 1 AS INT)) AS s, count(*) AS n FROM pairs GROUP BY 1), (SELECT unnest(range(1, 1001)) AS draw)),
 w AS (SELECT *, """ + " + ".join(f"(u >= {x})::INT" for x in ("0.367879441", "0.735758882", "0.919698603", "0.981011843", "0.996340153", "0.999405815")) + """ AS w FROM u),
 means AS (SELECT draw, sum(w * s) / sum(w * n) AS mean FROM w GROUP BY 1 HAVING sum(w * n) > 0), i AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM means),
 v AS (SELECT avg(CAST(truth = predicted AS INT) - CAST(truth = 1 AS INT)) AS delta FROM pairs)"""


@query("bootstrap_delta", _DELTA + "SELECT round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, delta >= 0.02 AND low > 0 AS primary_gate, delta >= 0 AS strict_gate FROM v, i")
def _(spark, d):
    rows = _pairs(spark, d).select("source", (F.col("truth") == F.col("predicted")).cast("int").alias("a"), (F.col("truth") == 1).cast("int").alias("b"))
    return M.gated_delta(rows, "source", "a", "b", least=0.02)


_METRICS = _GRADES + """, g AS (SELECT owner AS c, truth, predicted, count(*) AS n FROM grades GROUP BY ALL), u AS (SELECT g.*, draw, (CAST('0x' || substring(md5(c || '|' || draw || '|7'), 1, 10) AS BIGINT) + 0.5) / 1099511627776.0 AS u FROM g, (SELECT unnest(range(1, 201)) AS draw)),
 w AS (SELECT draw, truth, predicted, sum(n * (""" + " + ".join(f"(u >= {x})::INT" for x in ("0.367879441", "0.735758882", "0.919698603", "0.981011843", "0.996340153", "0.999405815")) + """)) AS n FROM u GROUP BY 1, 2, 3),
 t AS (SELECT draw, truth AS k, sum(n) AS s, sum(n) FILTER (WHERE truth = predicted) AS tp FROM w WHERE n > 0 GROUP BY 1, 2), p AS (SELECT draw, predicted AS k, sum(n) AS g FROM w WHERE n > 0 GROUP BY 1, 2),
 f AS (SELECT draw, avg(2.0 * coalesce(tp, 0) / (coalesce(s, 0) + coalesce(g, 0))) AS macro_f1 FROM t FULL JOIN p USING (draw, k) GROUP BY 1),
 a AS (SELECT draw, sum(n)::DOUBLE AS n, sum(n) FILTER (WHERE truth = predicted)::DOUBLE AS r, sum(n * (truth - predicted) ** 2)::DOUBLE AS far FROM w GROUP BY 1),
 e AS (SELECT t.draw, sum(CASE WHEN t.k = p.k THEN s::DOUBLE * g ELSE 0 END) AS chance, sum((t.k - p.k) ** 2 * s::DOUBLE * g) AS apart FROM t JOIN p USING (draw) GROUP BY 1),
 m AS (SELECT unnest([{'metric': 'accuracy', 'v': r / n}, {'metric': 'macro_f1', 'v': macro_f1}, {'metric': 'kappa', 'v': (r / n - chance / n / n) / (1 - chance / n / n)}, {'metric': 'weighted_kappa', 'v': 1 - far / n / (apart / n / n)}], recursive := true) FROM a JOIN f USING (draw) JOIN e USING (draw))
 """


@query("bootstrap_metrics", _METRICS + "SELECT metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg(v), 6) AS mean FROM m GROUP BY 1")
def _(spark, d):
    return M.bootstrap_metrics(_grades(spark, d), "owner")


@query("prediction_pivot", _GRADES + "SELECT news_id, max(truth) AS base, max(predicted) AS graph, max(truth) = max(predicted) AS agree FROM grades GROUP BY 1")
def _(spark, d):
    g = _grades(spark, d)
    long = g.select("news_id", F.lit("base").alias("feature_set"), F.col("truth").alias("guess")).unionByName(g.select("news_id", F.lit("graph").alias("feature_set"), F.col("predicted").alias("guess")))
    wide = long.groupBy("news_id").pivot("feature_set", ["base", "graph"]).agg(F.max("guess"))
    return wide.withColumn("agree", F.col("base") == F.col("graph"))


@query("quality_gates", _GRADES + """, m AS (SELECT 'accuracy' AS metric, avg(CAST(truth = predicted AS INT)) AS value FROM grades UNION ALL SELECT 'near', avg(CAST(abs(truth - predicted) <= 1 AS INT)) FROM grades UNION ALL SELECT 'filled', avg(CAST(truth IS NOT NULL AND predicted IS NOT NULL AS INT)) FROM grades)
 SELECT metric, round(value, 6) AS value, threshold, value >= threshold AS passed FROM m JOIN (VALUES ('accuracy', 0.9::DOUBLE), ('near', 0.4::DOUBLE), ('filled', 1.0::DOUBLE)) t(metric, threshold) USING (metric)""")
def _(spark, d):
    share = lambda c: F.avg(c.cast("int"))
    t, p = F.col("truth"), F.col("predicted")
    found = _grades(spark, d).agg(share(t == p).alias("accuracy"), share(F.abs(t - p) <= 1).alias("near"), share(t.isNotNull() & p.isNotNull()).alias("filled"))
    return M.gates(found, {"accuracy": 0.9, "near": 0.4, "filled": 1.0})


@query("tier_gate", _PAIRS + """, g AS (SELECT source AS tier, count(*) FILTER (WHERE truth = predicted) AS k, count(*) AS n FROM pairs GROUP BY 1), z AS (SELECT *, k / n AS p, 1.9599639845 AS z FROM g)
 SELECT tier, round(p, 6) AS precision, p >= 0.9 AND (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n) >= 0.85 AS released FROM z""")
def _(spark, d):
    g = _pairs(spark, d).groupBy(F.col("source").alias("tier")).agg(F.count_if(F.col("truth") == F.col("predicted")).alias("k"), F.count(F.lit(1)).alias("n"))
    rate = F.col("k") / F.col("n")
    return g.select("tier", F.round(rate, 6).alias("precision"), ((rate >= 0.9) & (X.wilson(F.col("k"), F.col("n"))["low"] >= 0.85)).alias("released"))


_AUDIT = """, r AS (SELECT symbol, datediff('day', DATE '1970-01-01', day) AS d, sentiment FROM dated), g AS (SELECT symbol, d, count(*) AS n, count(*) FILTER (WHERE sentiment = 'Positive') AS p, count(*) FILTER (WHERE sentiment = 'Negative') AS m FROM r GROUP BY 1, 2),
 w AS (SELECT symbol, d, coalesce(sum(n) OVER b, 0) AS n, coalesce(sum(p) OVER b, 0) AS p, coalesce(sum(m) OVER b, 0) AS m, sum(n) OVER t AS tn, sum(p) OVER t AS tp, sum(m) OVER t AS tm FROM g WINDOW b AS (PARTITION BY symbol ORDER BY d RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING), t AS (PARTITION BY symbol ORDER BY d RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)),
 again AS (SELECT a.symbol, a.d, coalesce(sum(h.n), 0) AS n, coalesce(sum(h.p), 0) AS p, coalesce(sum(h.m), 0) AS m FROM g a LEFT JOIN g h ON h.symbol = a.symbol AND h.d >= a.d - 30 AND h.d < a.d WHERE (a.symbol * 31 + a.d) % 4 = 0 GROUP BY 1, 2),
 c AS (SELECT again.n = w.n AND again.p = w.p AND again.m = w.m AS kept, again.n = tn AND again.p = tp AND again.m = tm AS leaky FROM again JOIN w USING (symbol, d)) """


@query("feature_parity", _AUDIT + "SELECT form, count(*) AS n, count(*) FILTER (WHERE ok) AS same, count(*) FILTER (WHERE ok) >= 0.999 * count(*) AS passed FROM (SELECT 'strictly_before' AS form, kept AS ok FROM c UNION ALL SELECT 'with_today', leaky FROM c) GROUP BY 1")
def _(spark, d):
    # The window form passes; the form that counts the day itself is found out.
    dated = S.dated_mentions(spark, d)
    chosen = (F.col("symbol") * 31 + F.col("d")) % 4 == 0
    leaky = A.windowed(dated.withColumn("d", epoch_day(F.col("day"))), with_today=True)
    rows = lambda form, features: A.audited(dated, chosen, features).select(F.lit(form).alias("form"), "n", "same", "passed")
    return rows("strictly_before", None).unionByName(rows("with_today", leaky))


@query("index_log_return", """, i AS (SELECT CASE WHEN r_name LIKE 'A%' THEN 'A_INDEX' ELSE 'MAIN_INDEX' END AS index, CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
 SELECT index, day, round(coalesce(ln(CAST(s AS DOUBLE) / lag(CAST(s AS DOUBLE)) OVER (PARTITION BY index ORDER BY day)), 0), 9) AS log_return FROM i""")
def _(spark, d):
    o, c, n, r = (S.table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    key = F.when(F.col("r_name").startswith("A"), "A_INDEX").otherwise("MAIN_INDEX")
    level = rows.groupBy(key.alias("index"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("close"))
    return W.log_return(level, "index").select("index", "day", F.round("log_return", 9).alias("log_return"))


@query("entry_ladder", """, q AS (SELECT s_suppkey AS symbol, CASE WHEN s_acctbal < 2000 THEN 'LOW' WHEN s_acctbal < 6000 THEN 'MID' ELSE 'HIGH' END AS grp, -(s_acctbal - floor(s_acctbal)) / 10 AS depth FROM supplier),
 l AS (SELECT *, list_sort([{'d': abs(-0.01 - depth), 'i': 1}, {'d': abs(-0.02 - depth), 'i': 2}, {'d': abs(-0.03 - depth), 'i': 3}, {'d': abs(-0.05 - depth), 'i': 4}])[1].i AS i FROM q),
 cells(grp, reliable, level, fill) AS (VALUES ('LOW', true, 1, 0.61::DOUBLE), ('LOW', true, 2, 0.42::DOUBLE), ('MID', false, 1, 0.5::DOUBLE), ('HIGH', true, 4, 0.33::DOUBLE), ('ALL', true, 1, 0.55::DOUBLE), ('ALL', true, 2, 0.4::DOUBLE), ('ALL', true, 3, 0.28::DOUBLE), ('ALL', true, 4, 0.15::DOUBLE)),
 g AS (SELECT l.*, CASE WHEN EXISTS (SELECT 1 FROM cells c WHERE c.grp = l.grp AND reliable) THEN grp ELSE 'ALL' END AS cell FROM l)
 SELECT symbol, cell AS volatility_group, g.i AS level, fill AS fill_rate FROM g JOIN cells c ON c.grp = g.cell AND c.level = g.i""")
def _(spark, d):
    balance = F.col("s_acctbal")
    group = F.when(balance < 2000, "LOW").when(balance < 6000, "MID").otherwise("HIGH")
    asked = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), group.alias("group"), (-(balance - F.floor(balance)) / 10).alias("depth"))
    cells = spark.createDataFrame([("LOW", True, 1, 0.61), ("LOW", True, 2, 0.42), ("MID", False, 1, 0.5), ("HIGH", True, 4, 0.33), ("ALL", True, 1, 0.55), ("ALL", True, 2, 0.4), ("ALL", True, 3, 0.28), ("ALL", True, 4, 0.15)], "group string, reliable boolean, level int, fill_rate double")
    return W.ladder_entry(asked, cells, (-0.01, -0.02, -0.03, -0.05))
