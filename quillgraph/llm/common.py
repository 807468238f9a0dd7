"""Shared helpers: written cut points in the shared folder and table readers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts of the text operators name it.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names.

    Where it is unset, a master on this one machine (tests) gets a temporary
    folder, and any other an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local"):
        found = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*cuts: DataFrame) -> None:
    """Delete the files of results of ``cut`` that nothing will read again."""
    for df in cuts:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores added until no table has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows that a task works on at once.
ROWS_AT_ONCE = 500
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


_RESIDENT: dict = {}


def resident(key: tuple, build: Callable):
    """What ``build`` gives for this key, kept in a worker until it needs something else: a reused worker holds one large object at a time."""
    if key not in _RESIDENT:
        no_resident()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def no_resident() -> None:
    """Let go of what earlier tasks left in this worker."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def with_found(docs: DataFrame, keep: Sequence[str], make: Callable, added: dict[str, str], source: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the ``added`` ones, named with their types.

    ``make()`` gives, once in each task, a function from a list of the values
    of ``source`` to the added columns' lists. Kept columns stay in Arrow, so that
    none of their values changes.
    """
    rows = docs.select(*keep, *([] if source in keep else [source]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for part in _parts(batches):
            found = find(part[source].to_pylist())
            yield pa.RecordBatch.from_arrays([part[c] for c in keep] + [pa.array(x, ARROW[t]) for x, t in zip(found, added.values(), strict=True)], [*keep, *added])

    return rows.mapInArrow(work, T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.DataType.fromDDL(t)) for c, t in added.items()]]))


def each_found(docs: DataFrame, keep: Sequence[str], make: Callable, added: dict[str, str]) -> DataFrame:
    """As ``with_found``, with any number of rows for a text: the function also gives, first, each row's place in its list."""
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for part in _parts(batches):
            places, *found = find(part["text"].to_pylist())
            places = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([part[c].take(places) for c in keep] + [pa.array(x, ARROW[t]) for x, t in zip(found, added.values(), strict=True)], [*keep, *added])

    return rows.mapInArrow(work, T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.DataType.fromDDL(t)) for c, t in added.items()]]))


def only(docs: DataFrame, make: Callable) -> DataFrame:
    """The rows of ``docs`` for whose texts the function that ``make()`` gives is true; all columns as they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for part in _parts(batches):
            yield part.filter(pa.array(find(part["text"].to_pylist()), pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(col):
    return F.translate(col, UPPER, UPPER.lower())


#: Integer components of vectors stay below this, so that products and squared distances fit a long.
MOST_WHOLE = 1 << 27


def finite(v):
    """Whether no component of an array column is null, infinite or no number."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(v):
    """floor(256 * x) for each component x as a double; an error beyond MOST_WHOLE, but not for components that are not finite."""
    large = lambda x: (F.abs(x.cast("double")) * 256 >= MOST_WHOLE) & ~F.isnan(x) & (F.abs(x) < float("inf"))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * 256))
    return F.when(F.exists(v, large), F.raise_error(F.lit("a vector component is too large for integer distances"))).otherwise(scaled)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose arrays all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
