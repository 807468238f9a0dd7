"""A leakage audit: features of sampled keys recomputed from the rows strictly before their day, by a range join.

The range join is split by blocks of days as long as the range, so that a key's
rows meet only the asked days of their own block and the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.metrics import parity
from quillgraph.operators.spans import counts_before, epoch_day


def _counts() -> dict[str, Column]:
    return {"news": F.lit(1), "positive": (F.col("sentiment") == "Positive").cast("int"), "negative": (F.col("sentiment") == "Negative").cast("int")}


def recomputed(rows: DataFrame, asked: DataFrame, days: int = 30) -> DataFrame:
    """For each (symbol, d) of ``asked``: counts of rows (symbol, d, sentiment) with a day in [d - days, d)."""
    block = lambda d: F.floor(d / days).cast("int")
    wanted = asked.select("symbol", F.col("d").alias("_day"), F.explode(F.array_distinct(F.array(block(F.col("d") - days), block(F.col("d") - 1)))).alias("_block"))
    met = wanted.join(rows.withColumn("_block", block(F.col("d"))), ["symbol", "_block"]).filter((F.col("d") >= F.col("_day") - days) & (F.col("d") < F.col("_day")))
    sums = met.groupBy("symbol", F.col("_day").alias("d")).agg(*[F.sum(c).alias(f"{n}_{days}") for n, c in _counts().items()])
    return asked.join(sums, ["symbol", "d"], "left").na.fill(0)


def windowed(rows: DataFrame, days: int = 30, with_today: bool = False) -> DataFrame:
    """The same counts of every (symbol, d) by windows; ``with_today`` makes the mistake that the audit is there to find."""
    if not with_today:
        return counts_before(rows, ["symbol"], {n: (c, [days]) for n, c in _counts().items()}, {})
    daily = rows.groupBy("symbol", "d").agg(*[F.sum(c).alias(n) for n, c in _counts().items()])
    w = Window.partitionBy("symbol").orderBy("d").rangeBetween(-days, 0)
    return daily.select("symbol", "d", *[F.sum(n).over(w).alias(f"{n}_{days}") for n in _counts()])


def audited(samples: DataFrame, chosen: Column, features: DataFrame | None = None, days: int = 30) -> DataFrame:
    """n, same, passed: whether the features of the chosen (symbol, d) agree with their recomputation. ``features``: those to audit, or the window form."""
    rows = samples.withColumn("d", epoch_day(F.col("day")))
    asked = rows.select("symbol", "d").distinct().filter(chosen)
    names = [f"{n}_{days}" for n in _counts()]
    found = windowed(rows, days) if features is None else features
    return parity(recomputed(rows, asked, days), found, ["symbol", "d"], names)
