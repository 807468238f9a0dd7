"""Features and labels on streams, equal to the batch forms for rows that are not too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Days that a symbol's recent counts look back over.
RECENT = (30, 90)
OUT = "symbol long, day date, today long, before long, positive_before long, negative_before long, last30 long, last90 long, days_since int"
#: Totals so far, the last day seen, the days that still count (day, rows), and the days that wait for the watermark (day, rows, positive, negative).
STATE = "before long, positive long, negative long, last int, recent array<array<long>>, waiting array<array<long>>"
_EPOCH = pd.Timestamp("1970-01-01")


def fold(symbol: int, state: tuple, counted: list[list[int]], until: int) -> tuple[list[tuple], tuple]:
    """Take in counts (day number, rows, positive, negative); give the features of the waiting days up to ``until``, each read before its day is added."""
    before, positive, negative, last, recent, waiting = state
    days = {d: [n, p, m] for d, n, p, m in waiting}
    for d, n, p, m in counted:
        own = days.setdefault(d, [0, 0, 0])
        own[0], own[1], own[2] = own[0] + n, own[1] + p, own[2] + m
    out = []
    for d in sorted(k for k in days if k <= until):
        n, p, m = days.pop(d)
        recent = [(r, k) for r, k in recent if r >= d - max(RECENT)]
        spans = [sum(k for r, k in recent if r >= d - span) for span in RECENT]
        out.append((symbol, (_EPOCH + pd.Timedelta(days=d)).date(), n, before, positive, negative, *spans, None if last < 0 else d - last))
        before, positive, negative, last = before + n, positive + p, negative + m, d
        recent = [*recent, (d, n)]
    return out, (before, positive, negative, last, [list(x) for x in recent], [[d, *x] for d, x in sorted(days.items())])


def history_stream(mentions: DataFrame, late: str = "2 days") -> DataFrame:
    """(symbol, day, features) of a stream (symbol long, day date, sentiment), in append mode.

    Rows are counted by symbol and day first. A symbol's days wait in its state
    until the watermark, ``late`` behind the newest day, has passed them; then
    each gives its features from the state as it was and is added to it. State
    holds the days of the last 90 and those that wait. Rows whose day the
    watermark has passed are dropped, as by any watermark.
    """
    rows = mentions.filter("symbol is not null and day is not null").select("symbol", F.col("day").cast("timestamp").alias("at"), F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("d"), "sentiment").withWatermark("at", late)

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0, 0, -1, [], [])
        # Days end at midnight: a day is over once the watermark has passed its end.
        until = state.getCurrentWatermarkMs() // 86_400_000 - 1
        counted = []
        for part in parts:
            by = part.assign(p=part["sentiment"].eq("Positive"), m=part["sentiment"].eq("Negative"), n=1)[["d", "n", "p", "m"]].groupby("d", as_index=False).sum()
            counted += [[int(x) for x in r] for r in by.itertuples(index=False) if r.d > until]
        out, held = fold(int(key[0]), held, counted, until)
        state.update(held)
        if held[5]:
            state.setTimeoutTimestamp(max((held[5][0][0] + 1) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"days_since": "Int32"})

    return rows.groupBy("symbol").applyInPandasWithState(work, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def labels_when_known(asked: DataFrame, known: DataFrame, wait_days: int = 7, late: str = "2 days") -> DataFrame:
    """Each (symbol, day, ...) of the stream ``asked`` with what the stream ``known`` (symbol, day, available_at, direction) later says of it.

    A join of two streams by symbol and day, with the label's time from the day
    itself up to ``wait_days`` later: both sides' state is dropped once the
    watermarks have passed that range, and rows for which no label came by then
    go out with nulls.
    """
    left = asked.withColumn("asked_at", F.col("day").cast("timestamp")).withWatermark("asked_at", late)
    right = known.select(F.col("symbol").alias("_symbol"), F.col("day").alias("_day"), "direction", F.col("available_at").cast("timestamp").alias("known_at")).withWatermark("known_at", late)
    in_time = (F.col("known_at") >= F.col("asked_at")) & (F.col("known_at") <= F.col("asked_at") + F.expr(f"INTERVAL {wait_days} DAYS"))
    joined = left.join(right, (F.col("symbol") == F.col("_symbol")) & (F.col("day") == F.col("_day")) & in_time, "leftOuter")
    return joined.select(*asked.columns, "direction", F.to_date("known_at").alias("available_at"))
