"""Queries of the learning stages: features, and the classifier by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import learning as L
from quillgraph.operators import metrics as M
from quillgraph.plans.registry import query
from quillgraph.sources import sinks as K
from quillgraph.sources import tables as S


#: Bytes of a table's files for each task that takes texts apart: a sign gives three parts.
TEXT_BYTES = 1 << 19


@query("char_tfidf", r""", t AS (SELECT conv_id * 1000 + turn AS id, conv_id % 5 < 4 AS train, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) || ' ' AS w FROM conversations),
 g AS (SELECT id, train, w, unnest([3, 4, 5]) AS n FROM t), p AS (SELECT id, train, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM g WHERE length(w) >= n), c AS (SELECT id, train, substring(w, i, n) AS name, count(*) AS tf FROM p GROUP BY ALL),
 v AS (SELECT name, count(*) AS df, sum(tf) AS total FROM c WHERE train GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, name LIMIT 50000), n AS (SELECT count(*) AS n FROM conversations WHERE conv_id % 5 < 4),
 x AS (SELECT id, name, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN v USING (name), n)
 SELECT id, name, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 7) AS value FROM x""")
def _(spark, d):
    rows = S.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "text")
    # Dealt as texts: their parts, many times as large, stay where these lie.
    rows = S.dealt(spark, d, "conversations", rows, "id", part_bytes=TEXT_BYTES)
    terms = L.fit_terms(rows.filter("conv_id % 5 < 4"), "text")
    return L.term_features(rows, "text", terms).select("id", "name", F.round("value", 7).alias("value"))


def _articles(spark, d):
    status = F.array_position(F.array(*map(F.lit, "FOP")), F.col("status")).cast("double") - 1
    return S.articles(spark, d).select(F.col("news_id").alias("id"), "day", "event_type", (F.col("owner") % 25).alias("group"), "impact", F.dayofyear("day").alias("in_year"), F.concat_ws(" ", F.lower("event_type"), F.date_format("day", "EEEE MMMM")).alias("text"), status.alias("label"))


@query("category_features", ", t AS (SELECT event_type, CAST(owner % 25 AS VARCHAR) AS g FROM articles WHERE day < DATE '1997-01-01' AND event_type <> '5-LOW') SELECT news_id AS id, 'event_type' AS block, event_type AS name, 1.0::DOUBLE AS value FROM articles WHERE event_type IN (SELECT event_type FROM t) UNION ALL SELECT news_id, 'group', CAST(owner % 25 AS VARCHAR), 1.0 FROM articles WHERE CAST(owner % 25 AS VARCHAR) IN (SELECT g FROM t)")
def _(spark, d):
    rows = _articles(spark, d)
    return L.category_features(rows, rows.filter("day < '1997-01-01' and event_type <> '5-LOW'"), ["event_type", "group"])


@query("number_features", ", t AS (SELECT avg(impact) AS m, stddev_pop(impact) AS s, avg(dayofyear(day)) AS m2, stddev_pop(dayofyear(day)) AS s2 FROM articles WHERE day < DATE '1997-01-01') SELECT news_id AS id, 'impact' AS name, round((impact - m) / s, 7) AS value FROM articles, t UNION ALL SELECT news_id, 'in_year', round((dayofyear(day) - m2) / s2, 7) FROM articles, t")
def _(spark, d):
    rows = _articles(spark, d)
    return L.number_features(rows, rows.filter("day < '1997-01-01'"), ["impact", "in_year"]).select("id", "name", F.round("value", 7).alias("value"))


#: Sets of features that are compared.
SETS = {"majority": {}, "text": {"text": "text"}, "market": {"categories": ["event_type", "group"], "numbers": ["impact", "in_year"]}, "text_market": {"text": "text", "categories": ["event_type", "group"], "numbers": ["impact", "in_year"]}}


# A fitted model: tests hold it against its own optimum.
@query("chronological_ablation")
def _(spark, d):
    """Measures of each set of features: train to validation, then both to test, always forward in time."""
    rows = K.cut(_articles(spark, d))
    train, valid, test = rows.filter("day < '1998-01-01'"), rows.filter("day >= '1998-01-01' and day < '2000-01-01'"), rows.filter("day >= '2000-01-01'")
    parts = []
    for split, known, asked in (("validation", train, valid), ("test", train.unionByName(valid), test)):
        for name, blocks in SETS.items():
            found = L.predict(known, asked, "label", rounds=100, **blocks)
            parts.append(M.overall(found.select(F.col("truth").cast("int").alias("truth"), F.col("predicted").cast("int").alias("predicted"))).select(F.lit(split).alias("split"), F.lit(name).alias("features"), "*"))
    return reduce(DataFrame.unionByName, parts)
