"""Features as rows (id, block, name, value) and a linear classifier over them.

A block is fitted on training rows and then describes any rows: parts of words
with TF-IDF weights, categories, scaled numbers. What a block has not seen in
training makes no row. The rows of all blocks together are one sparse vector
for each id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.sources.sinks import cut

#: Shares of the features' names that are numbered each by itself.
SHARES = 256
#: Training rows to a task of a fit. A round is a job of its own, so that tasks with few rows cost more than they do.
FIT_ROWS = 50_000


def word_parts(text: Column, least: int = 3, most: int = 5) -> Column:
    """All parts of ``least`` to ``most`` signs of each lower-cased word with a blank on both sides; parts do not cross words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    parts = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))
    some = lambda w: F.flatten(F.array(*[F.when(F.length(w) >= n, parts(w, n)).otherwise(F.array().cast("array<string>")) for n in range(least, most + 1)]))
    return F.flatten(F.transform(words, lambda w: some(F.concat(F.lit(" "), w, F.lit(" ")))))


def _counts(rows: DataFrame, text: str) -> DataFrame:
    return rows.select("id", F.explode(word_parts(F.col(text))).alias("name")).groupBy("id", "name").agg(F.count(F.lit(1)).alias("tf"))


def fit_terms(train: DataFrame, text: str, least_rows: int = 2, most_terms: int = 50_000, copies: str | None = None) -> DataFrame:
    """name, idf: terms of at least ``least_rows`` rows, the commonest ``most_terms`` of them (ties by name). A row stands for as many as its column ``copies`` says."""
    n = train.agg((F.sum(copies) if copies else F.count(F.lit(1))).alias("n"))  # one row
    counts = _counts(train, text)
    if copies:
        counts = counts.join(train.select("id", F.col(copies).alias("_k")), "id")
        df, all_ = F.sum("_k"), F.sum(F.col("tf") * F.col("_k"))
    else:
        df, all_ = F.count(F.lit(1)), F.sum("tf")
    terms = counts.groupBy("name").agg(df.alias("df"), all_.alias("all")).filter(F.col("df") >= least_rows)
    kept = terms.orderBy(F.desc("all"), "name").limit(most_terms)
    return kept.join(F.broadcast(n)).select("name", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def term_features(rows: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """Weights (1 + ln tf) * idf, of length 1 for each row. ``terms`` has at most the number of rows that its fit allows.

    A row's terms go together as one list: where rows lie by id, no term is shuffled.
    """
    w = _counts(rows, text).join(F.broadcast(terms), "name").select("id", "name", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    own = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("name", "w")).alias("own"))
    return own.select("id", "norm", F.explode("own").alias("t")).select("id", F.lit("text").alias("block"), F.col("t.name").alias("name"), (F.col("t.w") / F.col("norm")).alias("value"))


def category_features(rows: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 for the value of each column, if training rows have it."""
    long = lambda df, *ids: df.unpivot(list(ids), list(columns), "block", "name")
    seen = long(train.select(*[F.col(c).cast("string").alias(c) for c in columns])).distinct()
    own = long(rows.select("id", *[F.col(c).cast("string").alias(c) for c in columns]), "id")
    return own.join(seen, ["block", "name"], "left_semi").select("id", "block", "name", F.lit(1.0).alias("value"))


def number_features(rows: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers less the training mean, by the training deviation (of the population; 1 where that is 0)."""
    long = lambda df, *ids: df.unpivot(list(ids), list(columns), "name", "x")
    scale = long(train.select(*[F.col(c).cast("double").alias(c) for c in columns])).groupBy("name").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    own = long(rows.select("id", *[F.col(c).cast("double").alias(c) for c in columns]), "id")
    by = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    return own.join(F.broadcast(scale), "name").select("id", F.lit("number").alias("block"), "name", ((F.col("x") - F.col("m")) / by).alias("value"))  # a row for each column


def numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """block, name, place (from 0) of all features of the training rows, and their number.

    Names are dealt to ``SHARES`` by hash and numbered within their share, from
    where the shares before it end; so no task orders all of them.
    """
    names = blocks.select("block", "name").distinct().withColumn("_share", F.pmod(F.xxhash64("block", "name"), F.lit(SHARES)).cast("int"))
    sizes = names.groupBy("_share").agg(F.count(F.lit(1)).alias("_k"))  # a row for each share
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_share").orderBy("block", "name")) - 1
    places = names.join(F.broadcast(sizes.select("_share", before.alias("_before"))), "_share")
    return places.select("block", "name", (F.col("_before") + own).cast("int").alias("place")), names.count()


def vectors(rows: DataFrame, blocks: DataFrame, places: DataFrame, size: int, texts: DataFrame | None = None) -> DataFrame:
    """``rows`` with a sparse column ``features``, written; a row without features has an empty one.

    ``texts`` has the features of texts, whose id is the column ``text_id`` of
    ``rows``: they are put together once for each text. The parts of a vector
    are put together as columns and read again as a vector, whose stored form
    they have: no Python runs for it.
    """
    at = lambda some, key, name: some.join(places, ["block", "name"]).groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("place", "value")).alias(name))
    none = F.array().cast("array<struct<place: int, value: double>>")
    whole, parts = rows.join(at(blocks, "id", "_at"), "id", "left"), ["_at"]
    if texts is not None:
        whole, parts = whole.join(at(texts, "text_id", "_of_text"), "text_id", "left"), ["_at", "_of_text"]
    whole = whole.withColumn("_at", F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts])))
    sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.transform("_at", lambda p: p["place"]).alias("indices"), F.transform("_at", lambda p: p["value"]).alias("values"))
    whole = whole.withColumn("features", sparse).drop("_at", "_of_text")
    return cut(whole, T.StructType([T.StructField("features", VectorUDT()) if f.name == "features" else f for f in whole.schema]))


def balanced(train: DataFrame, label: str, copies: str | None = None) -> DataFrame:
    """A column ``weight``: rows / (classes * rows of the class), times the rows that a row stands for."""
    k = F.col(copies) if copies else F.lit(1)
    sizes = train.groupBy(label).agg(F.sum(k).alias("k"))
    all_ = sizes.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("c"))
    weights = sizes.join(F.broadcast(all_)).select(label, (F.col("n") / (F.col("c") * F.col("k"))).alias("_each"))
    return train.join(F.broadcast(weights), label).withColumn("weight", F.col("_each") * k).drop("_each")  # a row for each class


def fit_linear(train: DataFrame, label: str, strength: float = 1.0, rounds: int = 2000, copies: str | None = None):
    """Multinomial logistic regression over ``features``, classes in balance; the penalty is half the squared weights, against ``strength`` times the summed loss."""
    rows = balanced(train, label, copies)
    total, count = rows.agg(F.sum("weight"), F.count(F.lit(1))).first()
    rows = rows.coalesce(-(-count // FIT_ROWS) or 1)
    return LogisticRegression(family="multinomial", labelCol=label, weightCol="weight", standardization=False, regParam=1 / (strength * total), elasticNetParam=0.0, maxIter=rounds).fit(rows)


def majority(train: DataFrame, label: str) -> DataFrame:
    """One row: the commonest label (ties to the smaller)."""
    return train.groupBy(label).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), label).limit(1).select(F.col(label).alias("predicted"))


def predict(train: DataFrame, rows: DataFrame, label: str, text: str | None = None, categories: Sequence[str] = (), numbers: Sequence[str] = (), rounds: int = 2000) -> DataFrame:
    """id, truth, predicted of ``rows`` by what ``train`` teaches; without any block, the majority."""
    if not (text or categories or numbers):
        return rows.select("id", F.col(label).alias("truth")).join(F.broadcast(majority(train, label)))
    # Equal texts are taken apart once, and equal rows enter the fit as one.
    keyed = lambda some: some.withColumn("text_id", F.sha2(F.coalesce(text, F.lit("")), 256)) if text else some
    train, rows = keyed(train), keyed(rows)
    same = train.groupBy(label, *(["text_id"] if text else []), *categories, *numbers)
    merged = cut(same.agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *([F.first(text).alias(text)] if text else [])))
    texts = lambda some, k: some.groupBy(F.col("text_id").alias("id")).agg(F.first(text).alias(text), k.alias("copies"))
    known = texts(merged, F.sum("copies")) if text else None
    terms = cut(fit_terms(known, text, copies="copies")) if text else None

    def described(some: DataFrame) -> DataFrame:
        blocks = [category_features(some, train, categories)] if categories else []
        blocks += [number_features(some, train, numbers)] if numbers else []
        return reduce(DataFrame.unionByName, blocks) if blocks else none

    none = train.sparkSession.createDataFrame([], train.select("id").schema.add("block", "string").add("name", "string").add("value", "double"))
    # The fit reads its rows many times: what it needs is written once.
    learnt, learnt_texts = cut(described(merged)), cut(term_features(known, text, terms)) if text else None
    names = lambda some: some.select("block", "name").distinct()
    places, size = numbered(names(learnt).union(names(learnt_texts)) if text else learnt)
    places = cut(places)
    own = ["id", label, *(["text_id"] if text else [])]
    model = fit_linear(vectors(merged.select(*own, "copies"), learnt, places, size, learnt_texts).select("features", label, "copies"), label, rounds=rounds, copies="copies")
    asked_texts = term_features(texts(rows, F.count(F.lit(1))), text, terms) if text else None
    return model.transform(vectors(rows.select(*own), described(rows), places, size, asked_texts)).select("id", F.col(label).alias("truth"), F.col("prediction").cast("int").alias("predicted"))
