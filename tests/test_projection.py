"""Degrees by day, without the pairs of an industry."""

import datetime

import numpy as np
import pytest

from quillgraph.operators import epochs, graph
from quillgraph.plans import QUERIES


def test_degrees_by_day_make_no_pairs_of_an_industry(spark, monkeypatch):
    def pairs(_):
        raise AssertionError("pairs of an industry were made")

    monkeypatch.setattr(graph, "same_industry", pairs)
    first = datetime.date(2020, 1, 1)
    dated = spark.createDataFrame([(1, 0, first), (1, 1, first), (1, 600, first), (2, 0, first + datetime.timedelta(1)), (2, 600, first + datetime.timedelta(1))], "news_id long, symbol long, day date")
    symbols = spark.createDataFrame([(k, "x" if k < 600 else None) for k in range(602)], "symbol long, industry string")
    found = {(r["symbol"], r["day"]): (r["nodes"], r["edges"], r["degree"]) for r in epochs.degrees_by_day(dated, symbols).collect()}
    fixed = 600 * 599 // 2
    later = first + datetime.timedelta(1)
    assert found[0, first] == (602, fixed, round(599 / 601, 9)) and found[600, first] == (602, fixed, 0.0)
    # 0 and 1 are of one industry; 600 has met both.
    assert found[0, later] == (602, fixed + 2, round(600 / 601, 9)) and found[600, later] == (602, fixed + 2, round(2 / 601, 9))


@pytest.mark.parametrize("name", ["features_without_labels", "features_with_sentiment", "projection_by_day"])
def test_samples_meet_their_counts_without_a_shuffled_join(spark, sf_dir, name):
    """Samples are dealt by symbol once: no join shuffles them, or the pairs of an article, again."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_a_walk_takes_no_step_that_finds_nothing():
    """From every symbol of a star all are reached in two steps: one step is read, one made, and one back."""
    n, steps = 300, []

    class Counting(epochs.Matrix):
        def spread(self, x):
            steps.append(len(x))
            return super().spread(x)

    joined = Counting(n)
    joined.join(np.zeros(n - 1, np.int64), np.arange(1, n))
    reached, far, through = epochs.walk(joined, np.arange(n), n)
    assert steps == [n, n]
    assert reached.tolist() == [n - 1] * n and far.tolist() == [n - 1] + [1 + 2 * (n - 2)] * (n - 1)
    assert through.tolist() == [(n - 1) * (n - 2)] + [0] * (n - 1)


def test_hundreds_of_symbols_are_one_block(spark):
    """An epoch's sources are not dealt to blocks that each get all pairs and give a row for every symbol."""
    symbols = spark.range(400).selectExpr("id as symbol", "id % 4 as industry")
    dated = spark.createDataFrame([(1, 1, datetime.date(2020, 1, 1)), (1, 2, datetime.date(2020, 1, 1)), (2, 1, datetime.date(2020, 1, 3))], "news_id long, symbol long, day date")
    found = epochs.centralities_by_day(dated, symbols)
    assert "sum(through" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["symbol"], r["day"].day, r["nodes"]) for r in found.collect()} == {(1, 1, 400), (2, 1, 400), (1, 3, 400)}
