"""Features from strictly earlier days, as-of joins and price windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _day() :
    return F.datediff("day", F.lit("1970-01-01").cast("date"))


def history(dated: DataFrame) -> DataFrame:
    """For each (symbol, day): articles before that day, in the 30 and 90 days before, polar ones, days since the last.

    Rows are first summed by (symbol, day), so windows run over days only.
    """
    daily = dated.groupBy("symbol", "day").agg(F.count("news_id").alias("n"), F.count_if(F.col("sentiment") == "Positive").alias("p"), F.count_if(F.col("sentiment") == "Negative").alias("m")).withColumn("d", _day())
    w = Window.partitionBy("symbol").orderBy("d")
    before, last = w.rangeBetween(Window.unboundedPreceding, -1), lambda k: w.rangeBetween(-k, -1)
    total = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    return daily.select(
        "symbol", "day", F.col("n").alias("today"), total("n", before).alias("before"), total("p", before).alias("positive_before"), total("m", before).alias("negative_before"),
        total("n", last(30)).alias("last30"), total("n", last(90)).alias("last90"), (F.col("d") - F.max("d").over(before)).alias("days_since"),
    )


def industry_history(dated: DataFrame, dictionary: DataFrame, days: int = 30) -> DataFrame:
    """For each (industry, day): distinct articles and symbols in the days before.

    A symbol counts from the day after an article until ``days`` after it. Where
    these spans of a symbol join they are one; +1 stands at its start and -1
    behind its end, so that one running sum per industry counts the symbols.
    """
    rows = dated.join(dictionary, "symbol").select("industry", "symbol", "day", "news_id").withColumn("d", _day())
    daily = rows.groupBy("industry", "day", "d").agg(F.countDistinct("news_id").alias("n"))
    by = Window.partitionBy("industry", "symbol").orderBy("d")
    own = rows.select("industry", "symbol", "d").distinct().select("industry", "d", (F.col("d") - F.lag("d").over(by)).alias("since"), (F.lead("d").over(by) - F.col("d")).alias("until"))
    opens = own.filter((F.col("since") > days) | F.col("since").isNull()).select("industry", (F.col("d") + 1).alias("d"), F.lit(1).alias("change"))
    closes = own.filter((F.col("until") > days) | F.col("until").isNull()).select("industry", (F.col("d") + days + 1).alias("d"), F.lit(-1).alias("change"))
    changes = opens.unionByName(closes).groupBy("industry", "d").agg(F.sum("change").alias("change"))
    w = Window.partitionBy("industry").orderBy("d")
    both = daily.join(changes, ["industry", "d"], "full")
    out = both.select("industry", "day", F.coalesce(F.sum("n").over(w.rangeBetween(-days, -1)), F.lit(0)).alias("articles"), F.coalesce(F.sum("change").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long").alias("symbols"))
    return out.filter("day is not null")


def moving_average(panel: DataFrame, size: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(1 - size, 0)
    return panel.withColumn(f"ma{size}", F.when(F.count("close").over(w) == size, F.round(F.avg("close").over(w), 6)))


def volatility(panel: DataFrame, size: int = 20, least: int = 5) -> DataFrame:
    """Sample deviation of the last log returns; prices not above 0 give no return."""
    by = Window.partitionBy("symbol").orderBy("day")
    before = F.lag("close").over(by)
    rows = panel.withColumn("ret", F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before)))
    w = by.rowsBetween(1 - size, 0)
    return rows.withColumn("volatility", F.when(F.count("ret").over(w) >= least, F.round(F.stddev_samp("ret").over(w), 6))).drop("ret")


def forward_move(panel: DataFrame, sessions: int = 3) -> DataFrame:
    """Per cent change over the next sessions, rounded before any limit is applied."""
    by = Window.partitionBy("symbol").orderBy("day")
    later = F.lead("close", sessions).over(by)
    return panel.withColumn("move", F.when(F.col("close") != 0, F.round((later - F.col("close")) / F.col("close") * 100, 3)))


def _as_of(asked: DataFrame, panel: DataFrame, forward: bool, same_day: bool) -> DataFrame:
    """Each asked (symbol, day) with the panel row next to it in one direction.

    Both sides become one sequence for each symbol and year, and a running
    window carries the last panel row on: one shuffle, work in proportion to
    the rows, and no symbol's whole history in one task. Where a year has none,
    the nearest row of the nearest year that has one comes from a small table.
    """
    values = [c for c in panel.columns if c not in ("symbol", "day")]
    row, year = F.struct("day", *values), F.year("day").alias("_year")
    none = F.lit(None).cast(panel.select(row.alias("r")).schema["r"].dataType)
    up = asked.select("symbol", "day", year, F.lit(1 if same_day else 0).alias("_place"), none.alias("_row"), F.struct(*asked.columns).alias("_asked"))
    down = panel.select("symbol", "day", year, F.lit(0 if same_day else 1).alias("_place"), row.alias("_row"), F.lit(None).cast(up.schema["_asked"].dataType).alias("_asked"))
    both = up.unionByName(down)
    order = (lambda c: F.desc(c)) if forward else (lambda c: F.asc(c))
    within = Window.partitionBy("symbol", "_year").orderBy(order("day"), "_place").rowsBetween(Window.unboundedPreceding, 0)
    held = F.when(F.col("_row").isNotNull(), F.col("day"))
    nearest = F.min_by("_row", held) if forward else F.max_by("_row", held)
    years = both.groupBy("symbol", "_year").agg(nearest.alias("_near"))
    others = Window.partitionBy("symbol").orderBy(order("_year")).rowsBetween(Window.unboundedPreceding, -1)
    years = years.select("symbol", "_year", F.last("_near", ignorenulls=True).over(others).alias("_other"))
    found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(within)).filter("_asked is not null").join(years, ["symbol", "_year"])
    found = found.select("_asked", F.coalesce("_row", "_other").alias("_row"))
    return found.select("_asked.*", F.col("_row.day").alias("session"), *[F.col(f"_row.{c}").alias(c) for c in values])


def as_of_forward(asked: DataFrame, panel: DataFrame) -> DataFrame:
    """Each asked (symbol, day) with the first panel row of that day or later."""
    return _as_of(asked, panel, True, True)


def as_of_backward(asked: DataFrame, panel: DataFrame) -> DataFrame:
    """Each asked (symbol, day) with the last panel row before that day."""
    return _as_of(asked, panel, False, False)


def abnormal_return(panel: DataFrame, index: DataFrame, sessions: int = 3) -> DataFrame:
    """Per (symbol, day): the return over the next sessions less that of the index (day, close) between the same two days."""
    by = Window.partitionBy("symbol").orderBy("day")
    rows = panel.select("symbol", "day", "close", F.lead("day", sessions).over(by).alias("until"), F.lead("close", sessions).over(by).alias("later")).filter("until is not null and close <> 0")
    start, end = (index.select(F.col("day").alias(d), F.col("close").alias(c)) for d, c in (("day", "index_start"), ("until", "index_end")))
    rows = rows.join(start, "day").join(end, "until").filter("index_start <> 0")
    own, market = F.col("later") / F.col("close") - 1, F.col("index_end") / F.col("index_start") - 1
    return rows.select("symbol", "day", "until", own.alias("own"), market.alias("market"), (own - market).alias("abnormal"))


def price_band(panel: DataFrame, size: int = 20, least: int = 10) -> DataFrame:
    """Per symbol: last close, low and high of the last sessions, pullback by two volatilities, not below the low.

    Rows without a finite price are no sessions. No band without a volatility
    or with fewer than ``least`` sessions.
    """
    panel = panel.filter(F.col("close").isNotNull() & ~F.isnan("close") & (F.abs("close") < float("inf")))
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))
    rows = volatility(panel, size).withColumn("_n", newest).filter(F.col("_n") <= size)
    band = rows.groupBy("symbol").agg(F.max_by("close", "day").alias("close"), F.min("close").alias("low"), F.max("close").alias("high"), F.max_by(F.coalesce("volatility", F.lit(float("nan"))), "day").alias("volatility"), F.count("close").alias("n"))
    band = band.filter((F.col("n") >= least) & ~F.isnan("volatility"))
    return band.withColumn("pullback", F.round(F.greatest(F.round(F.col("close") * (1 - 2 * F.col("volatility")), 2), F.col("low")), 4)).drop("n")


def moves(panel: DataFrame, sessions: int = 3) -> DataFrame:
    """Per (symbol, day) with a price before and ``sessions`` later: the return until then, and a guess that a fallen price rises."""
    by = Window.partitionBy("symbol").orderBy("day")
    rows = panel.select("symbol", "day", "close", F.lag("close").over(by).alias("before"), F.lead("close", sessions).over(by).alias("later"))
    return rows.filter("later is not null and before is not null and close <> 0").select("symbol", "day", (F.col("close") < F.col("before")).alias("up"), (F.col("later") / F.col("close") - 1).alias("realised"))


def log_return(levels: DataFrame, key: str) -> DataFrame:
    """Per key and day the log of the level over that of the session before; the first is 0."""
    before = F.lag("close").over(Window.partitionBy(key).orderBy("day"))
    return levels.withColumn("log_return", F.coalesce(F.ln(F.col("close") / before), F.lit(0.0)))


def ladder_entry(asked: DataFrame, cells: DataFrame, levels: Sequence[float]) -> DataFrame:
    """symbol, volatility_group, level and fill_rate: the cell of the group, or ALL if it is not reliable, at the level nearest to ``depth``.

    ``cells`` (group, reliable, level, fill_rate) has one row for each group and
    level. A symbol without such a cell gives no row.
    """
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(float(v)) - F.col("depth")).alias("d"), F.lit(k).alias("level")) for k, v in enumerate(levels, 1)]))["level"]
    sure = cells.filter("reliable").select("group").distinct().withColumn("_sure", F.lit(True))
    placed = asked.withColumn("level", near).join(sure, "group", "left").withColumn("group", F.when(F.col("_sure"), F.col("group")).otherwise("ALL"))
    return placed.join(cells.select("group", "level", "fill_rate"), ["group", "level"]).select("symbol", F.col("group").alias("volatility_group"), "level", "fill_rate")
