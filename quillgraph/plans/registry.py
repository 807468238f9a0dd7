"""The registry of queries and their SQL.

Every entry of QUERIES takes (spark, sf_dir). ORACLES has the same result in
DuckDB SQL, over the same tables; SQL of shared inputs stands in BASE.
"""

from __future__ import annotations

BASE = """
WITH dictionary AS (
  SELECT s_suppkey AS symbol, n_name AS industry, r_name AS exchange FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), articles AS (
  SELECT o_orderkey AS news_id, o_custkey AS owner, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS event_type, o_totalprice AS impact, o_orderstatus AS status FROM orders
), mentions AS (
  SELECT l_orderkey AS news_id, l_suppkey AS symbol, CASE max(l_returnflag) WHEN 'A' THEN 'Positive' WHEN 'N' THEN 'Neutral' ELSE 'Negative' END AS sentiment FROM lineitem GROUP BY 1, 2
), dated AS (
  SELECT m.*, a.day, a.event_type, a.impact, a.owner FROM mentions m JOIN articles a USING (news_id)
), panel AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / sum(l_quantity) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
)
"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = BASE + sql
        return f

    return put
