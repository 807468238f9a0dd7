"""Centroid clustering with a LAESA pivot table.

Each vector's distances to a few fixed pivots are measured once and stored with
it. In every round the centroids are measured against the same pivots: for a
pivot p, |d(v, p) - d(c, p)| never exceeds d(v, c), so the largest such
difference bounds each centroid's distance from below. A vector visits the
centroids by rising bound and stops at the first bound beyond the nearest exact
distance so far; only the centroids visited get an exact integer distance. The
bounds give way by a margin for rounding, so none is passed over wrongly.

A task sums its vectors for each centroid and component, and the driver gets
centroids x components sums: what moves in a round does not grow with the
vectors. The pivots come from a bounded sample (``sample_rows``); the centroids
and all sums from all rows. The pivot table is written once, so that a lost
executor costs one task's share of a round.

Defined cases: vectors that are null, of another length or hold null or
non-finite components take no part. Rows that repeat a vec_id are vectors of
their own; those of one id start as centroids in the order of their
components, and rows with a null id after all others. With fewer vectors than
centroids there are as many centroids as vectors. Other columns do not enter.
An empty table gives an empty result. A component beyond ``common.MOST_WHOLE``
once it is an integer is an error, as the distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, finite, forget, matrix, whole

PIVOTS, SAMPLE_ROWS = 8, 1024
FAR = np.iinfo(np.int64).max


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it, all distances added up."""
    if not len(sample):
        return sample
    chosen, total = [0], np.zeros(len(sample))
    while len(chosen) < min(count, len(sample)):
        total += distances(sample, sample[chosen[-1:]])[:, 0]
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return sample[chosen]


def distances(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances [rows, points], each the root of an exact integer."""
    return np.sqrt(np.stack([((v - p) ** 2).sum(axis=1) for p in points], axis=1).astype(np.float64))


def bounds(to_pivots: np.ndarray, centroid_pivots: np.ndarray) -> np.ndarray:
    """Lower bounds [rows, centroids] of the squared distances."""
    low = np.zeros((len(to_pivots), len(centroid_pivots)))
    for mine, theirs in zip(to_pivots.T, centroid_pivots.T, strict=True):
        np.maximum(low, np.abs(mine[:, None] - theirs) - 1e-9 * (mine[:, None] + theirs), out=low)
    return low * low * (1 - 1e-9)


def assign(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number) and exact squared distance of each row, and how many distances that took."""
    low = bounds(to_pivots, centroid_pivots)
    order = np.argsort(low, axis=1, kind="stable")
    cluster, best = np.full(len(v), len(centroids)), np.full(len(v), FAR)
    open_, taken = np.arange(len(v)), 0
    for k in range(len(centroids)):
        number = order[open_, k]
        near = low[open_, number] <= best[open_]
        open_, number = open_[near], number[near]
        if not len(open_):
            break
        taken += len(open_)
        exact = ((v[open_] - centroids[number]) ** 2).sum(axis=1)
        better = (exact < best[open_]) | ((exact == best[open_]) & (number < cluster[open_]))
        best[open_[better]], cluster[open_[better]] = exact[better], number[better]
    return cluster, best, taken


def vectors_of(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, v array of longs) of the vectors that take part."""
    v = F.col("embedding")
    return vectors.filter(F.coalesce((F.size(v) == size) & finite(v), F.lit(False))).select("vec_id", whole(v).alias("v"))


def _measured(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = distances(matrix(batch["v"]), pivots) if len(batch) else np.empty((0, len(pivots)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(pivots), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], lists], ["vec_id", "v", "to_pivots"])

    return rows.mapInArrow(work, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<long>, to_pivots array<double>")


def _sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(cluster, place, total, rows): each cluster's sum of a component, and its vectors."""
    own = distances(centroids, pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if len(batch):
                v = matrix(batch["v"])
                cluster = assign(v, matrix(batch["to_pivots"]), centroids, own)[0]
                np.add.at(total, cluster, v)
                rows += np.bincount(cluster, minlength=len(rows))
        held = np.flatnonzero(rows)
        dims = total.shape[1]
        columns = [np.repeat(held, dims), np.tile(np.arange(dims), len(held)), total[held].ravel(), np.repeat(rows[held], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["cluster", "place", "total", "rows"])

    parts = table.select("v", "to_pivots").mapInArrow(work, "cluster int, place int, total long, rows long")
    return parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))


def cluster(vectors: DataFrame, size: int = 64, count: int = 40, rounds: int = 5, seed: str = "2:", pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each vector of ``size`` components.

    The first centroids are the ``count`` vectors with the smallest SHA-256 of
    ``seed`` and the decimal vec_id.
    """
    spark = vectors.sparkSession
    rows = cut(vectors_of(vectors, size), "whole-vectors")
    named = rows.withColumn("name", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    centroids = np.array([r["v"] for r in named.orderBy(F.col("name").asc_nulls_last(), "v").select("v").limit(count).collect()], np.int64).reshape(-1, size)
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "v").select("v").limit(sample_rows).collect()], np.int64).reshape(-1, size)
    points = pivots_of(sample, pivots)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table = cut(_measured(rows, points), "pivot-table")
    forget(rows)
    for _ in range(rounds):
        for r in _sums(table, centroids, points).collect():  # a row for each centroid and component
            centroids[r["cluster"], r["place"]] = r["total"] // r["rows"]
    own = distances(centroids, points)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                number, exact, _ = assign(matrix(batch["v"]), matrix(batch["to_pivots"]), centroids, own)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(number, pa.int32()), pa.array(exact, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = cut(table.mapInArrow(work, f"vec_id {kind}, cluster int, distance long"), "assigned-vectors")
    forget(table)
    within = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    shown = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(k, d, sum(within.values()), shown[k]) for k, d in within.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def centroid_clusters(vectors: DataFrame) -> DataFrame:
    """op13: 40 centroids over vectors of 64 components, five rounds."""
    return cluster(vectors.select("vec_id", "embedding"))


def _sql(size: int = 64, count: int = 40, rounds: int = 5, seed: str = "2:") -> str:
    near = """SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS distance, arg_min(k, (d, k)) AS cluster
    FROM (SELECT r, vec_id, kept.v, k, list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept CROSS JOIN {c} c) GROUP BY r"""
    steps = []
    for k in range(rounds):
        steps.append(f"near{k} AS MATERIALIZED ({near.format(c=f'c{k}')})")
        mean = "(t - ((t % n) + n) % n) // n"
        steps.append(
            f"moved{k} AS (SELECT cluster AS k, list(({mean})::BIGINT ORDER BY i) AS v FROM (SELECT cluster, i, sum(v[i]) AS t, count(*) AS n FROM near{k}, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY cluster, i) GROUP BY cluster)"
        )
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN moved{k} m USING (k))")
    steps.append(f"final AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    chain = ",\n  ".join(steps)
    return f"""WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), v) - 1 AS k, v FROM kept QUALIFY k < {count}),
  {chain}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM final JOIN c{rounds} c ON c.k = final.cluster"""


CENTROIDS_SQL = _sql()
