"""Core operators against plain Python on small rows, with odd ones among them."""

import datetime as dt
import math
import random
import re

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import graph as G
from quillgraph.operators import metrics as M
from quillgraph.operators import relations as R
from quillgraph.operators import temporal as W
from quillgraph.sources import sinks as K
from quillgraph.sources import tables as S


def _day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(k)


def test_as_of_both_ways(spark):
    chance = random.Random(1)
    panel = sorted({(s, _day(chance.randrange(2000))) for s in "AB" for _ in range(25)})
    asked = sorted({(s, _day(chance.randrange(-50, 2050))) for s in "ABC" for _ in range(60)})
    p = spark.createDataFrame([(s, d, float(k)) for k, (s, d) in enumerate(panel)], "symbol string, day date, close double")
    a = spark.createDataFrame(asked, "symbol string, day date")
    ahead = {(s, d): min((x for t, x in panel if t == s and x >= d), default=None) for s, d in asked}
    behind = {(s, d): max((x for t, x in panel if t == s and x < d), default=None) for s, d in asked}
    assert {(r.symbol, r.day): r.session for r in W.as_of_forward(a, p).collect()} == ahead
    assert {(r.symbol, r.day): r.session for r in W.as_of_backward(a, p).collect()} == behind


def test_industry_history(spark):
    chance = random.Random(2)
    rows = [(n, chance.randrange(5), _day(chance.randrange(200))) for n in range(120)]
    industry = {k: "XY"[k % 2] for k in range(5)}
    found = W.industry_history(spark.createDataFrame(rows, "news_id int, symbol int, day date"), spark.createDataFrame(list(industry.items()), "symbol int, industry string")).collect()
    for r in found:
        inside = [(n, s) for n, s, d in rows if industry[s] == r.industry and 1 <= (r.day - d).days <= 30]
        assert (r.articles, r.symbols) == (len({n for n, _ in inside}), len({s for _, s in inside}))
    assert len(found) == len({(industry[s], d) for _, s, d in rows})


def test_price_band_without_volatility(spark):
    rows = [("A", _day(k), 10.0 + k % 3) for k in range(30)] + [("B", _day(k), 5.0) for k in range(4)] + [("C", _day(k), float("nan") if k % 2 else -1.0) for k in range(40)]
    assert [r.symbol for r in W.price_band(spark.createDataFrame(rows, "symbol string, day date, close double")).collect()] == ["A"]


def test_symbols_and_their_context(spark):
    text = "AAA gains. Stocks of BBB and AAA rise" + " x" * 60 + " CCC (xDDD EEEEEE 9FFF) GGG, cổ phiếu HHH"
    row = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    found = [r[0] for r in row.select(X.symbol_mentions(F.col("t"))).collect()]
    assert found == [["AAA", "BBB", "CCC", "GGG", "HHH"], None, []]
    plain = re.compile(r"(?<!\w)[A-Z]{2,5}(?!\w)")
    gated = []
    for m in plain.finditer(text):
        around = text[max(0, m.start() - 40 - len("stocks")) : m.start()].lower(), text[m.end() : m.end() + 40 + len("stocks")].lower()
        if any("stocks" in part for part in around) and m[0] not in gated:
            gated.append(m[0])
    assert row.select(X.symbol_mentions(F.col("t"), ("stocks",))).first()[0] == gated == ["AAA", "BBB"]


def test_percent_moves_and_sentiment(spark):
    row = spark.createDataFrame([("Tăng mạnh 12,5% và tăng\n 3% rồi giảm 4%",)], "t string")
    assert row.select(X.percent_moves(F.col("t"), ("tăng",))).first()[0] == ["12.5"]
    none, ups = F.array().cast("array<double>"), F.array(F.lit(40.0))
    scores = row.select(X.sentiment(F.lit(5), F.lit(0), ups, none)["score"], X.sentiment(F.lit(0), F.lit(0), none, none)["score"], X.sentiment(F.lit(1), F.lit(4), none, none)["label"]).first()
    assert tuple(scores) == (95.0, 50.0, "Negative")


def test_html_text(spark):
    html = "<html><HEAD><title>T</title><script>a<b</script></head><nav>x</nav><p>one&nbsp;<!-- c -->  two</p><footer>f</footer></html>"
    assert spark.createDataFrame([(html,), (None,)], "h string").select(X.html_text(F.col("h"))).collect() == [("T one&nbsp; two",), ("",)]


def test_measures(spark):
    chance = random.Random(3)
    rows = [(chance.randrange(4), chance.randrange(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "truth int, predicted int")
    n = len(rows)
    t, p = ([sum(r[k] == c for r in rows) for c in range(4)] for k in (0, 1))
    far = sum((a - b) ** 2 for a, b in rows) / (sum((a - b) ** 2 * t[a] * p[b] for a in range(4) for b in range(4)) / n)
    got = M.kappa(df).first()
    right = sum(a == b for a, b in rows)
    chance_right = sum(a * b for a, b in zip(t, p)) / n
    assert math.isclose(got.weighted_kappa, 1 - far, abs_tol=1e-6) and math.isclose(got.kappa, (right - chance_right) / (n - chance_right), abs_tol=1e-6)
    o = M.overall(df).first()
    f1 = [2 * sum(a == b == c for a, b in rows) / (t[c] + p[c]) for c in range(4)]
    assert math.isclose(o.macro_f1, sum(f1) / 4, abs_tol=1e-6) and math.isclose(o.accuracy, right / n, abs_tol=1e-6)
    for b, c in ((0, 0), (3, 0), (5, 9), (40, 41), (300, 350)):
        pair = spark.createDataFrame([(True, False)] * b + [(False, True)] * c + [(True, True)], "first_right boolean, second_right boolean")
        want = min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0
        assert math.isclose(M.mcnemar(pair).first().p, want, abs_tol=1e-8)


def test_density_and_orphans(spark):
    edges = spark.createDataFrame([("a_1", "b_1", "r"), ("b_1", "c_1", "r")], "src string, dst string, relation string")
    assert tuple(G.density(edges).first()) == (3, 2, round(2 / 6, 12))
    assert [r.dst for r in R.orphans(edges, spark.createDataFrame([("a_1",), ("b_1",)], "node_id string")).collect()] == ["c_1"]
    assert len({r.edge_id for r in G.with_ids(edges).collect()}) == 2
    assert K.bulk_edges(edges).columns == [":START_ID", ":END_ID", ":TYPE"]


def test_tables_written_and_read(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 3, "c", True)], "id int, at int, v string, deleted boolean")
    assert [(r.id, r.v) for r in K.latest(log, ["id"], [F.desc("at")]).collect()] == [(1, "b")]
    path = tmp_path / "a.csv"
    path.write_text('﻿title,content,source,url,published_date\n"A ""b""","line 1\nline 2",s,u,2020-01-01\n" ",x,s,u,\n', encoding="utf-8")
    assert [(r.title, r.content) for r in S.read_article_csv(spark, f"file://{path}").collect()] == [('A "b"', "line 1\nline 2")]
    rows = S.read_text_csv(spark, f"file://{path}", ["content", "published_date"]).collect()
    assert [tuple(r) for r in rows] == [("line 1\nline 2", "2020-01-01"), ("x", "")]
    K.write_fresh(log, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4


def test_bootstrap_draws_each_cluster_once(spark, monkeypatch):
    from quillgraph.operators import metrics as M

    given, plain = [], M._drawn
    monkeypatch.setattr(M, "_drawn", lambda groups, *rest: given.append(groups) or plain(groups, *rest))
    rows = spark.createDataFrame([(k % 5, k % 3, k % 4 % 3) for k in range(60)], "owner int, truth int, predicted int")
    assert M.bootstrap_metrics(rows, "owner", draws=10).count() == 4 and given[0].count() == 5


def test_context_gate_looks_around_words_only(spark):
    import time

    from pyspark.sql import functions as F

    from quillgraph.functions import text as X

    rows = spark.createDataFrame([("the AB, xAB ABCDEF CD" + " y" * 30 + " EF and Gh IJ\nque, KLé LM the NO" + " z" * 25 + " PQ",), ("plain text without any " * 40_000 + "THE",)], "t string")
    rows.select(X.symbol_mentions(F.col("t"), ("the",))).limit(1).count()  # compiles
    began = time.time()
    assert [r["s"] for r in rows.select(X.symbol_mentions(F.col("t"), ("the", "die", "que")).alias("s")).collect()] == [["AB", "CD", "EF", "IJ", "LM", "NO"], []]
    assert time.time() - began < 4
