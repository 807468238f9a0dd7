"""Tables that take new rows beside what they hold: caches, dictionaries, lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_keys(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Keys to fetch: those asked for that the cache lacks."""
    return asked.select(key).distinct().join(held.select(key), key, "left_anti")


def extend(held: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cache and the fresh rows, one row for each key; what is held stays."""
    return held.unionByName(fresh.join(held.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))


def merged_dictionary(reference: DataFrame, curated: DataFrame, blocked: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Every key of either side but the blocked ones; a curated field wins over the reference's."""
    r, c = reference.alias("r"), curated.alias("c")
    j = r.join(c, key, "full").select(key, *[F.coalesce(F.col(f"c.{f}"), F.col(f"r.{f}")).alias(f) for f in fields])
    return j.join(blocked.select(key), key, "left_anti")


def additions(asked: DataFrame, held: DataFrame, universe: DataFrame, keys: Sequence[str], symbol: str) -> DataFrame:
    """Rows to add to a list: not on it yet, and of a known symbol."""
    return asked.select(*keys).distinct().join(held.select(*keys), list(keys), "left_anti").join(universe.select(symbol), symbol, "left_semi")


def pattern_map(keywords: DataFrame, built_in: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Active keywords by event, lower-cased and in order; the built-in ones if there are none. Keywords are settings that people type."""
    rows = keywords.filter("active").groupBy("event").agg(F.array_sort(F.collect_set(F.lower("keyword"))).alias("words")).collect()
    return {r["event"]: r["words"] for r in sorted(rows, key=lambda r: r["event"])} or {k: list(v) for k, v in built_in.items()}


def failed(rows: DataFrame, error: str) -> DataFrame:
    """Rows with an error get no prediction, the decision ERROR, and go to review as analysed."""
    bad = F.col(error).isNotNull()
    return rows.select(
        *[c for c in rows.columns if c not in ("prediction", "decision", "is_analyzed", "needs_review")], F.when(~bad, F.col("prediction")).alias("prediction"),
        F.when(bad, "ERROR").otherwise(F.col("decision")).alias("decision"), F.lit(True).alias("is_analyzed"), (bad | F.col("needs_review")).alias("needs_review"),
    )
