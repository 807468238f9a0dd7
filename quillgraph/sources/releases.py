"""Releases of tables: staged, described by a manifest, and made current by one rename.

A release is a folder of its own. Its tables and its manifest (rows, and the
SHA-256 of every file as it was written) are complete before a small file names
it as the current one; that file is replaced by a rename, so a reader sees the
old release or the new one, and a job that fails leaves the old one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.files import _file_system, exists

POINTER = "CURRENT"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small UTF-8 file beside ``path`` and rename it there, over any older one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files, at = _file_system(spark, path)
    staged = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(staged, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(at.makeQualified(files.getUri(), files.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(staged), context.makeQualified(at), over)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below a folder, each hashed in a task; a file has at most two gigabytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def with_mark(df: DataFrame) -> DataFrame:
    """``df`` with a byte-order mark before its first column's name: so every CSV file with a header begins with one."""
    first, *rest = df.columns
    return df.select(F.col(f"`{first}`").alias("﻿" + first), *[F.col(f"`{c}`") for c in rest])


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], fmt: str = "csv", facts: Mapping[str, object] | None = None, rows_per_file: int = 5_000_000) -> dict:
    """Write a release of ``tables`` below ``root`` and make it current; its manifest."""
    folder = f"{root.rstrip('/')}/release-{uuid.uuid4().hex}"
    manifest: dict = {"release": folder.rsplit("/", 1)[1], **(facts or {}), "tables": {}}
    for name, df in tables.items():
        options = {"header": True, "escape": '"', "quoteAll": False, "emptyValue": ""} if fmt == "csv" else {}
        (with_mark(df) if fmt == "csv" else df).write.option("maxRecordsPerFile", rows_per_file).options(**options).format(fmt).save(f"{folder}/{name}")
        read = spark.read.options(**({"header": True, "multiLine": True, "escape": '"'} if fmt == "csv" else {})).format(fmt).load(f"{folder}/{name}")
        files = [r.asDict() for r in file_digests(spark, f"{folder}/{name}").orderBy("file").collect() if not r["file"].startswith("_")]  # a row for each file
        manifest["tables"][name] = {"rows": read.count(), "files": files}
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=1))
    write_text(spark, f"{root.rstrip('/')}/{POINTER}", manifest["release"])
    return manifest


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the current release, if there is one."""
    pointer = f"{root.rstrip('/')}/{POINTER}"
    return f"{root.rstrip('/')}/{read_text(spark, pointer)}" if exists(spark, pointer) else None


def altered(spark: SparkSession, folder: str) -> DataFrame:
    """(table, file) of a release whose bytes are not those of its manifest: changed, missing or added."""
    manifest = json.loads(read_text(spark, f"{folder}/manifest.json"))
    wanted = spark.createDataFrame([(t, f["file"], f["sha256"]) for t, own in manifest["tables"].items() for f in own["files"]], "table string, file string, sha256 string")
    there = None
    for t in manifest["tables"]:
        own = file_digests(spark, f"{folder}/{t}").filter(~F.col("file").startswith("_")).select(F.lit(t).alias("table"), "file", F.col("sha256").alias("now"))
        there = own if there is None else there.unionByName(own)
    return wanted.join(there, ["table", "file"], "full").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("table", "file")
