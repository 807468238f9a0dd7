"""File sources: uploads, data sets, typed and literal CSV, JSON artifacts, GraphML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that a typed reading takes as empty.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Limits of an upload: bytes of its file and rows.
UPLOAD_BYTES, UPLOAD_ROWS = 10 * 1024 * 1024, 2000


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder."""
    files, at = _file_system(spark, path)
    return files.getContentSummary(at).getLength()


def _line_end(spark: SparkSession, path: str) -> str:
    """How the first line of a file, or of a folder's first file with content, ends."""
    head = spark.read.text(path, lineSep="\n").limit(1).first()
    return "\r\n" if head and head[0].endswith("\r") else "\n"


def text_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Every cell as text, an empty one as '' and not null; a byte-order mark before the header goes. Only ``columns`` are read; one that is missing is an error."""
    rows = spark.read.options(header=True, multiLine=True, escape='"', emptyValue="", nullValue="\x00", lineSep=_line_end(spark, path)).csv(path)
    if missing := set(columns or ()) - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = rows.select(*[F.col(f"`{c}`") for c in columns]) if columns else rows
    return rows.na.fill("")


def typed_csv(spark: SparkSession, path: str, types: Mapping[str, str], na: Sequence[str] = NA) -> DataFrame:
    """The columns named in ``types``, in that order, as these types; cells of ``na``, and those that are not of the type, are null. Only these columns are read."""
    rows = text_csv(spark, path, list(types))
    cell = lambda c: F.when(~F.col(f"`{c}`").isin(*na), F.col(f"`{c}`"))
    return rows.select(*[cell(c).try_cast(t).alias(c) if t != "string" else cell(c).alias(c) for c, t in types.items()])


def upload(spark: SparkSession, path: str, most_bytes: int = UPLOAD_BYTES, most_rows: int = UPLOAD_ROWS) -> DataFrame:
    """(title, content, source, url, published_date) of an uploaded CSV. Empty cells are null, blank titles go, titles are cut to 500.

    A larger file, more rows or no column ``title`` is an error.
    """
    if size(spark, path) > most_bytes:
        raise ValueError(f"the file has more than {most_bytes} bytes")
    rows = text_csv(spark, path)
    if "title" not in rows.columns:
        raise ValueError("the file has no column title")
    if rows.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"the file has more than {most_rows} rows")
    cell = lambda c: F.when(F.trim(c) != "", F.trim(c)) if c in rows.columns else F.lit(None).cast("string")
    found = rows.select(*[cell(c).alias(c) for c in ("title", "content", "source", "url", "published_date")])
    return found.filter("title is not null").withColumn("title", F.substring("title", 1, 500))


def data_set(spark: SparkSession, path: str, columns: Sequence[str], key: str = "sample_id", day: str = "published_date") -> DataFrame:
    """A data set of text cells with ``day`` as a date. A column that is missing, a repeated key or a day that is no date fails, the last two in the job that reads them."""
    rows = text_csv(spark, path)
    if missing := set(columns) | {key, day} - set(rows.columns):
        missing -= set(rows.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
    date = F.col(day).try_cast("date")
    rows = rows.withColumn(day, F.when(date.isNotNull(), date).otherwise(F.raise_error(F.concat(F.lit("no date: "), F.col(day)))))
    own = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in rows.columns if c != key])).alias("_r"))
    own = own.withColumn("_r", F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), F.col(key)))))
    return own.select(key, "_r.*").select(*rows.columns)


def artifact(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row (status, value) of a JSON file: READ, MISSING or DAMAGED; the value is null unless it was read, never a default."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([("MISSING", None)], T.StructType([T.StructField("status", T.StringType()), T.StructField("value", schema)]))
    whole = spark.read.text(path, wholetext=True).select("value")
    # A text that is no object, or that breaks off, has no parsed form.
    valid = F.coalesce(F.try_parse_json(F.coalesce("value", F.lit(""))).isNotNull() & F.col("value").rlike(r"^\s*\{"), F.lit(False))
    found = whole.unionByName(spark.createDataFrame([("",)], "value string")).limit(1).select(F.when(valid, F.from_json("value", schema)).alias("value"))
    return found.select(F.when(F.col("value").isNotNull(), "READ").otherwise("DAMAGED").alias("status"), "value")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(node_id) and (source, target) of a GraphML file, whose elements are read as rows in many tasks."""
    read = lambda tag, schema: spark.read.format("xml").options(rowTag=tag, attributePrefix="_").schema(schema).load(path)
    nodes, edges = read("node", "_id string"), read("edge", "_source string, _target string")
    return nodes.select(F.col("_id").alias("node_id")), edges.select(F.col("_source").alias("source"), F.col("_target").alias("target"))


def graphml_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: nodes, edges."""
    nodes, edges = graphml(spark, path)
    one = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))
