"""Readers, and the stand-in tables that the queries run on.

``mentions`` is the unit of fact: one row for each (article, symbol). Orders are
articles, suppliers are symbols, nations industries, regions exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, industry, exchange."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("industry"), F.col("r_name").alias("exchange"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news_id, owner, day, event_type, title_value, status."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("news_id"), F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("event_type"), F.col("o_totalprice").alias("impact"), F.col("o_orderstatus").alias("status"))


SENTIMENT = {"A": "Positive", "N": "Neutral", "R": "Negative"}


#: Bytes of a table's files for each partition that its rows are dealt to.
PART_BYTES = 4 << 20


def dealt(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame, *keys: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``rows`` of a table dealt by ``keys`` to as many partitions as its files' size asks for, so that a task's share does not grow with the table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    parts = -(-path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() // part_bytes)
    return rows.repartition(max(parts, spark.sparkContext.defaultParallelism), *keys)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news_id, symbol, sentiment: one row for each (article, symbol), by its greatest flag.

    Rows are dealt by article once: what follows by article needs no shuffle of them.
    """
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("news_id"), F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("flag"))
    li = dealt(spark, sf_dir, "lineitem", li, "news_id").groupBy("news_id", "symbol").agg(F.max("flag").alias("flag"))
    names = F.create_map(*[F.lit(x) for kv in SENTIMENT.items() for x in kv])
    return li.select("news_id", "symbol", names[F.col("flag")].alias("sentiment"))


def dated_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).join(articles(spark, sf_dir).select("news_id", "day", "event_type", "impact", "owner"), "news_id")


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (brand), day, close: unit price of a brand's lines shipped that day, weighted by quantity."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")  # exact, whatever the order
    rows = li.join(p.select("p_partkey", "p_brand"), li["l_partkey"] == p["p_partkey"])
    return rows.groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg((money / F.sum("l_quantity")).alias("close"))


ARTICLE_CSV = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "content", "source", "url", "published_date")])


def read_article_csv(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded articles: rows with a blank title go, titles are cut to 500."""
    rows = spark.read.schema(ARTICLE_CSV).options(header=True, multiLine=True, escape='"', enforceSchema=False).csv(path)
    return rows.filter(F.trim("title") != "").withColumn("title", F.substring("title", 1, 500))


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text, with empty cells as '' and not null; raises if a column is missing."""
    head = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    if missing := set(columns) - set(head.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return head.na.fill("").select(*columns)
