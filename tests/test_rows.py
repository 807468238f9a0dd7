"""Names, addresses, JSON and reviews, row by row; lists that grow."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillgraph.functions import rows as R
from quillgraph.operators import upserts as U
from quillgraph.plans import QUERIES


def _one(spark, column, *values, names="a b c"):
    fields = ", ".join(f"{n} string" for n in names.split()[: len(values)])
    return spark.createDataFrame([values], fields).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "symbol", "want"), [
    ("Công ty Cổ phần Sữa Việt Nam (Vinamilk)", "VNM", "Vinamilk"), ("Công ty Cổ phần FPT (FPT)", "fpt", "CTCP FPT (FPT)"), ("Ngân hàng TMCP Á Châu", "ACB", "NH Á Châu"),
    ("Tổng Công ty " + "x" * 40, "A", "TCT " + "x" * 23 + "…"), ("Plain", None, "Plain"), (None, "A", None),
])
def test_short_company(spark, name, symbol, want):
    assert _one(spark, R.short_company(F.col("a"), F.col("b")), name, symbol) == want


@pytest.mark.parametrize(("url", "want"), [
    ("https://example.com/a", None), (" HTTP://Example.com:8080 ", None), ("ftp://example.com", "scheme"), ("example.com", "scheme"), ("", "empty"), (None, "empty"), ("http:///a", "host"),
    ("http://10.0.0.1/", "inner address"), ("http://u:p@192.168.1.1/", "inner address"), ("http://172.32.0.1/", None), ("http://169.254.169.254/latest", "inner address"), ("http://8.8.8.8", None), ("http://localhost/", "inner address"), ("http://[::1]:80/", "inner address"),
])
def test_url_fault(spark, url, want):
    assert _one(spark, R.url_fault(F.col("a")), url) == want


def test_names_symbol(spark):
    said = R.names_symbol(F.col("a"), F.col("b"))
    assert _one(spark, said, "Cổ phiếu hpg tăng", "HPG") and _one(spark, said, "(HPG)", "HPG")
    assert not _one(spark, said, "HPG1 tăng", "HPG") and not _one(spark, said, "AHPG", "HPG") and not _one(spark, said, "HxG", "H.G")


def test_attribute(spark):
    assert _one(spark, R.attribute(F.col("a"), "k"), '{"k": "v"}') == "v"
    assert _one(spark, R.attribute(F.col("a"), "k"), "broken") is None
    assert _one(spark, R.attribute(F.col("a"), "k", strict=True), '{"k": 1}') == "1"
    with pytest.raises(PySparkException):
        _one(spark, R.attribute(F.col("a"), "k", strict=True), "broken")


def test_canonical_json(spark):
    assert _one(spark, R.canonical_json(b=F.col("a"), a=F.col("b")), "tăng", None) == '{"a":"","b":"tăng"}'


def test_columns_by_name():
    assert R.year_columns(["2022", "name", "2024", "20245", "2023"]) == ["2024", "2023", "2022"]
    assert R.leaking_columns(["close", "Return_3d", "future_x", "x_label"], ["return", "label"], ["future_"]) == ["Return_3d", "future_x", "x_label"]


def test_pattern_map(spark):
    rows = spark.createDataFrame([("b", "Lãi Tăng", True), ("b", "lãi tăng", True), ("a", "x", True), ("a", "y", False)], "event string, keyword string, active boolean")
    assert U.pattern_map(rows, {}) == {"a": ["x"], "b": ["lãi tăng"]}
    assert U.pattern_map(rows.filter("not active"), {"k": ["w"]}) == {"k": ["w"]}


def test_extend(spark):
    held = spark.createDataFrame([("A", 1, 10)], "symbol string, day int, close int")
    fresh = spark.createDataFrame([("A", 1, 99), ("A", 2, 11), ("A", 2, 11), ("B", 1, 5)], held.schema)
    assert sorted(map(tuple, U.extend(held, fresh, ["symbol", "day"]).collect())) == [("A", 1, 10), ("A", 2, 11), ("B", 1, 5)]
    assert [r[0] for r in U.missing_keys(fresh, held, "symbol").collect()] == ["B"]


def test_leaking_columns_query(spark, sf_dir):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf_dir}/orders.parquet").to_pydict()
    want = {n: sum(v is not None for v in values) for n, values in rows.items() if "price" in n.lower() or n.lower().startswith("o_orders")}
    assert want and {r["name"]: r["filled"] for r in QUERIES["leaking_columns"](spark, sf_dir).collect()} == want
