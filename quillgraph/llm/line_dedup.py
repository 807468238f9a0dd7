"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased. Keys enter as two 64-bit hashes of independent seeds. Batches of
documents go from the largest ``doc_id`` down. Each batch is summed per key,
merge-anti-joined with the runs so far (bucketed and sorted by hash, so the
runs are not shuffled again) and written as a run of level 0. When a level
holds ``fanout`` runs they are compacted into one run of the next level.

Defined cases: a null text is one empty line. A null ``doc_id`` counts as one
document below all others. Rows that repeat a ``doc_id`` count as one document,
and each keeps its own row in the result. Other columns pass through, and a
column named like a result column gives way to it. An empty table gives an
empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE, cut, fresh, lower_ascii, partitions

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3


class LineRuns:
    """Sorted runs (h1, h2, docs, keeper), by level.

    ``docs`` counts a batch's documents with the key. ``keeper`` is the largest
    doc_id of the batch that first brought the key, null in later batches.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.buckets = partitions(spark)
        self.made = 0

    def _write(self, run: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        run.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").format("parquet").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def rows(self) -> DataFrame | None:
        """All runs, one above another."""
        out = None
        for table in (t for level in self.levels for t in level):
            run = self.spark.table(table)
            out = run if out is None else out.unionByName(run)
        return out

    def absorb(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch of (h1, h2, doc_id), then add its run."""
        own = (
            batch.select("h1", "h2", "doc_id").distinct()
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
        )
        known = [self.spark.table(t).select("h1", "h2") for level in self.levels for t in level]
        fresh = own
        for run in known:
            fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        if known:
            fresh = own.select("h1", "h2", "docs").join(fresh.select("h1", "h2", "keeper"), ["h1", "h2"], "left")
        self._write(fresh.select("h1", "h2", "docs", "keeper"), 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fanout:
                merged = self.spark.table(full[0])
                for table in full[1:]:
                    merged = merged.unionByName(self.spark.table(table))
                self._write(summed(merged), level + 1)
                self.levels[level] = []
                for table in full:
                    self.spark.sql(f"DROP TABLE {table}")
            level += 1

    def close(self) -> None:
        for table in (t for level in self.levels for t in level):
            self.spark.sql(f"DROP TABLE {table}")
        self.levels = []


def summed(runs: DataFrame) -> DataFrame:
    """One row per key. The explicit repartition stands because Spark 4.1 takes a union of bucketed scans as co-located."""
    return runs.repartition("h1", "h2").groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row (doc_id, text_hash, pos, h1, h2) for each line long enough."""
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("line", F.btrim("line", F.lit(SPACE)))
        .filter(F.length("line") >= min_chars)
        .withColumn("line", lower_ascii(F.col("line")))
        .select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    )


def _deduped(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the new text and the number of lines before and dropped, in columns of names that it did not have."""
    spark = docs.sparkSession
    names = {c: fresh(c, docs) for c in ("gone", "gone_id", "gone_hash", "n_lines", "n_dropped")}
    gone, gone_id, gone_hash = (names[c] for c in ("gone", "gone_id", "gone_hash"))
    keys = cut(_line_keys(docs, min_chars), "line-keys")
    # Only the ends of the batches come from the sketch of quantiles; every row is in one batch.
    ends = sorted(set(keys.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)), reverse=True)
    doc_id, above, runs = F.col("doc_id"), None, LineRuns(spark, fanout)
    try:
        for end in [*ends, None]:
            here = F.lit(True) if end is None else doc_id >= int(end)
            if above is not None:
                here = here & (doc_id.isNull() | (doc_id < int(above)))
            runs.absorb(keys.filter(here))
            above = end
        verdict = cut(summed(runs.rows()).filter((F.col("docs") >= min_docs) & F.col("keeper").isNotNull()).drop("docs"), "line-verdict")
    finally:
        runs.close()
    # One key may hold a third of all lines: both sides are shuffled, so that adaptive execution splits it.
    dropped = (
        keys.join(verdict.hint("merge"), ["h1", "h2"])
        .filter(~doc_id.eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias(gone))
        .withColumnsRenamed({"doc_id": gone_id, "text_hash": gone_hash})
    )
    lines = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    joined = docs.join(dropped.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs["text"]) == F.col(gone_hash)), "left")
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n"))
    out = joined.select(
        *[kept.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias(names["n_lines"]),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(names["n_dropped"]),
    )
    return out, names


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, plus n_lines and n_dropped.

    Keys of ``min_chars`` code points or more that ``min_docs`` documents hold
    lose all their lines but those in the largest doc_id that holds them.
    """
    return _deduped(docs.drop("n_lines", "n_dropped"), min_chars, min_docs, batches, fanout)[0]


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """As ``dedup_lines``, with the columns of ``docs`` and no others."""
    return _deduped(docs, min_chars, min_docs, batches, fanout)[0].select(*docs.columns)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """op5: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (c.k IS NOT NULL AND c.keeper <> l.doc_id) AS gone
  FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
