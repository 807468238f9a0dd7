"""Exact ranks and quantiles by counts over ranges of values.

No task holds a column's order: a sketch proposes edges, one aggregation counts
the values between them, and what is asked for lies in a known range. A range
is split again until what is left of it is one value or ``SMALL`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of one split, and rows of a range that are sorted at once.
RANGES, SMALL = 256, 4096


def _part(value: Column, edges: Sequence[float]) -> Column:
    """How many edges lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value)) if edges else F.lit(0)


def _edges(rows: DataFrame, value: str, ranges: int) -> list[float]:
    return sorted(set(rows.approxQuantile(value, [k / ranges for k in range(1, ranges)], 1 / (2 * ranges))))


def order_values(rows: DataFrame, value: str, places: Sequence[int], ranges: int = RANGES, small: int = SMALL) -> dict[int, float]:
    """The values at these places, from 0, of the ascending order of ``value``, whose rows hold neither null nor NaN."""
    rows, found = rows.select(F.col(value).cast("double").alias(value)), {}
    todo = [(rows, 0, sorted(set(places)))]
    while todo:
        some, start, wanted = todo.pop()
        edges = _edges(some, value, ranges)
        parts = some.groupBy(_part(F.col(value), edges).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for r in sorted(parts.collect(), key=lambda r: r["part"]):  # at most ``ranges`` rows
            inside = [p for p in wanted if start <= p < start + r["n"]]
            if inside and r["low"] == r["high"]:
                found |= dict.fromkeys(inside, r["low"])
            elif inside:
                own = some.filter(F.col(value).between(r["low"], r["high"]))
                if r["n"] <= small:
                    values = [x[0] for x in own.orderBy(value).collect()]
                    found |= {p: values[p - start] for p in inside}
                else:
                    todo.append((own, start, inside))
            start += r["n"]
    return found


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], ranges: int = RANGES, small: int = SMALL) -> list[float | None]:
    """Exact quantiles with linear interpolation, nulls and NaN left out; nulls for an empty column."""
    rows = rows.select(value).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    count = rows.count()
    if not count:
        return [None] * len(shares)
    at = [s * (count - 1) for s in shares]
    values = order_values(rows, value, [p for x in at for p in (math.floor(x), math.ceil(x))], ranges, small)
    low, high = [values[math.floor(x)] for x in at], [values[math.ceil(x)] for x in at]
    return [a + (b - a) * (x - math.floor(x)) for a, b, x in zip(low, high, at, strict=True)]


def value_ranks(counts: DataFrame, value: str, count: str, rank: str) -> DataFrame:
    """(value, rank): the mean rank of each of the distinct values, which occur ``count`` times.

    Counts are summed by ranges of values; each range's start comes from a
    small table of range totals. Only the ends of the ranges come from a sketch.
    """
    part = _part(F.col(value), _edges(counts, value, RANGES))
    placed = counts.withColumn("_part", part)
    totals = placed.groupBy("_part").agg(F.sum(count).alias("_all"))  # at most RANGES rows
    before = F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(count).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.join(F.broadcast(totals.select("_part", before.alias("_before"))), "_part")
    return placed.select(value, (F.col("_before") + F.coalesce(inside, F.lit(0)) + (F.col(count) + 1) / 2).alias(rank))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns, rows with a null left out.

    Rows become counts of distinct pairs first, so that a value of very many
    rows is one row for each partner by the time it meets its rank.
    """
    pairs = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    ranks = lambda c: value_ranks(pairs.groupBy(c).agg(F.sum("n").alias("n")), c, "n", f"_{c}")
    total = F.broadcast(pairs.agg(((F.sum("n") + 1) / 2).alias("_mean")))  # one row
    placed = pairs.join(ranks("a"), "a").join(ranks("b"), "b").join(total)
    x, y, n = F.col("_a") - F.col("_mean"), F.col("_b") - F.col("_mean"), F.col("n")
    rho = F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y)))
    return placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(rho, 6).alias("rho"))


def buckets(rows: DataFrame, value: str, result: str, count: int = 5) -> DataFrame:
    """bucket, n, mean of ``value`` and of ``result`` between the quantiles of ``value``; equal edges are one."""
    edges = sorted({e for e in percentiles(rows, value, [k / count for k in range(count + 1)]) if e is not None})
    placed = rows.filter(F.col(value).isNotNull()).withColumn("bucket", F.greatest(_part(F.col(value), edges), F.lit(1)))
    return placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.avg(result), 6).alias("mean_result"))
