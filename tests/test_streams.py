"""Streams fed out of order and late, against the batch forms."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillgraph.operators import temporal as W
from quillgraph.streaming import events as E
from quillgraph.streaming import features as S

DAY = dt.date(2024, 1, 1)
MENTIONS = "news_id long, symbol long, day date, sentiment string"


def _fed(spark, tmp_path, name, schema, batches):
    """A stream that gives one written file in each batch, in order."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def _ran(spark, stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_fold_reads_before_it_adds():
    out, state = S.fold(7, (0, 0, 0, -1, [], []), [[10, 2, 1, 0], [5, 1, 0, 1], [99, 1, 0, 0]], 50)
    assert [r[2:] for r in out] == [(1, 0, 0, 0, 0, 0, None), (2, 1, 0, 1, 1, 1, 5)] and state[:4] == (3, 1, 1, 10) and state[5] == [[99, 1, 0, 0]]
    out, _ = S.fold(7, state, [], 99)
    assert [r[2:] for r in out] == [(1, 3, 1, 1, 0, 2, 89)]


def test_history_out_of_order_and_late(spark, tmp_path):
    chance = random.Random(5)
    rows = [(n, chance.randrange(4), DAY + dt.timedelta(days=chance.randrange(n // 2, n // 2 + 5)), chance.choice(["Positive", "Neutral", "Negative"])) for n in range(240)]
    batches = [rows[k : k + 40] for k in range(0, 240, 40)]
    for b in batches:
        chance.shuffle(b)
    # Far behind the watermark by then, so it must change nothing.
    batches[4].append((999, 1, DAY, "Positive"))
    last = DAY + dt.timedelta(days=400)
    batches += [[(1000, 99, last, "Neutral")], [(1001, 99, last, "Neutral")]]
    with_watermark = S.history_stream(_fed(spark, tmp_path, "mentions", MENTIONS, batches), "30 days")
    got = [r for r in _ran(spark, with_watermark, "history_rows", tmp_path) if r[0] != 99]
    batch = W.history(spark.createDataFrame(rows, MENTIONS))
    want = sorted((tuple(r) for r in batch.select("symbol", "day", "today", "before", "positive_before", "negative_before", "last30", "last90", "days_since").collect()), key=str)
    assert got == want and len(want) > 100


def test_labels_known_later(spark, tmp_path):
    asked = [[(s, DAY + dt.timedelta(days=d)) for s in (1, 2) for d in range(k, k + 4)] for k in range(0, 16, 4)]
    known = [(s, DAY + dt.timedelta(days=d), DAY + dt.timedelta(days=d + 3 + s), "UP" if d % 2 else "DOWN") for s in (1, 2) for d in range(16) if d % 5]
    # One label comes before its day, one after the range: neither joins.
    known += [(1, DAY + dt.timedelta(days=5), DAY + dt.timedelta(days=40), "LATE"), (2, DAY, DAY - dt.timedelta(days=1), "EARLY")]
    random.Random(1).shuffle(known)
    far = DAY + dt.timedelta(days=300)
    left = _fed(spark, tmp_path, "asked", "symbol long, day date", [*asked, [(9, far)], [(9, far)], [(9, far)]])
    right = _fed(spark, tmp_path, "known", "symbol long, day date, available_at date, direction string", [known[:10], known[10:20], known[20:], [], [(9, far, far, "UP")], [(9, far, far, "UP")], [(9, far, far, "UP")]])
    got = [r for r in _ran(spark, S.labels_when_known(left, right, late="60 days"), "labelled_rows", tmp_path) if r[0] != 9]
    flat = [r for b in asked for r in b]
    label = {(s, d): (way, at) for s, d, at, way in known if d <= at <= d + dt.timedelta(days=7)}
    assert got == sorted([(s, d, *label.get((s, d), (None, None))) for s, d in flat], key=str)


def test_repeated_addresses_are_read_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [[(f"u{k % 7}", at + dt.timedelta(minutes=k)) for k in range(b, b + 6)] for b in range(0, 24, 6)]
    stream = _fed(spark, tmp_path, "urls", "url string, ts timestamp", rows)
    found = E.first_of_key(stream, "url")
    assert len(_ran(spark, found.select(F.col("url")), "url_rows", tmp_path)) == 7
