"""Each query against its SQL in DuckDB; queries without SQL run."""

import math
import os

import duckdb
import pytest

from quillgraph.plans import ORACLES, QUERIES


def _ordered(rows, columns):
    """Rows with columns by name, sorted by what is not a float and then by the floats in brief."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rows = [tuple(r[k] for k in order) for r in rows]
    return sorted(rows, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [f"{v:.3g}" for v in r if isinstance(v, float)]))


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return str(a) == str(b)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    rows = found.collect()
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(found.columns)
        left, right = _ordered(rows, found.columns), _ordered(want.fetchall(), want.columns)
        assert len(left) == len(right)
        assert [p for p in zip(left, right) if not all(map(_same, *p))] == []


def test_whole_tables(spark, sf_dir, duck):
    """Every mention and every line's id enters, whatever its date."""
    one = lambda sql: duck.sql(sql).fetchall()[0][0]
    mentions = one("SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
    assert QUERIES["graph_edges"](spark, sf_dir).filter("relation = 'mentions'").count() == mentions
    ids = one("SELECT count(DISTINCT l_orderkey + 100000 * (l_linenumber // 7)) FROM lineitem")
    assert QUERIES["batch_progress"](spark, sf_dir).first()["total"] == ids
    assert QUERIES["manifest_digest"](spark, sf_dir).first()["n_rows"] == QUERIES["graph_edges"](spark, sf_dir).count()
