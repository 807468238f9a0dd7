"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance by one more component that
brings every candidate to the length of the longest. ``tables`` hash tables of
``hashes`` functions floor((a.v + b) / width), a normal, cut the space. A query
visits perturbed buckets in the order of their estimated success: the offset of
a neighbour at distance r along a is normal with deviation r, so the chance of
every bucket is a product of normal probabilities.

A query asks twice. The first round visits the likeliest buckets of each table,
up to ``FIRST`` of the chance at a distance fitted on a sample. What it finds
gives each query its own distance and the score that others must reach. The
second round visits further buckets until the chances at that distance add up
to what ``recall`` needs, and hands on only candidates that reach that score,
so that rows grow with queries and not with what they are compared with. Bucket
members and the queries that probe them meet in blocks of bounded size; a
bucket of any size is split into blocks, so no candidate is left out. The
tables' candidates are merged per query and rank by exact double products.

Only the scale of distances (r, the number of functions) is fitted, on at most
``sample_rows`` rows; every row is indexed. The number of functions is the one
with the least work: more of them make buckets smaller and probes more, and on
evenly spread vectors the probes soon grow faster. A query whose neighbours lie
so far away that it would visit more than ``MOST_PROBES`` buckets of a table
meets all rows instead.

Defined cases: vectors that are null, zero, hold null or non-finite components,
have a null id or another length than most take no part. Of rows that repeat a
vec_id the smallest vector counts. Ties go to the smaller vec_id. Other columns
do not enter. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, forget

SAMPLE_ROWS = 4096
#: Rows of a bucket, and queries that probe it, in one block; rows of blocks that share a call.
BLOCK_ROWS, BLOCK_QUERIES, PACK_ROWS = 8192, 8192, 16384
#: Queries of a block that are scored at once; rows of probes that are handed on at once.
QUERIES_AT_ONCE, PROBES_AT_ONCE = 512, 16384
#: Scored rows that cost as much as a probe; buckets of a table from which on a query meets all rows, and the key of these.
PROBE_COST, MOST_PROBES, EVERY = 2000, 4096, -1
#: Chance that the first round covers in each table.
FIRST = 0.2


@dataclass
class Hashes:
    """Fitted functions: ``direction`` [tables, hashes, dims + 1], ``shift`` [tables, hashes]."""

    direction: np.ndarray
    shift: np.ndarray
    width: float
    longest: float
    near: float
    need: float

    def places(self, v: np.ndarray, own: bool) -> np.ndarray:
        """Positions in units of a bucket, [rows, tables, hashes]; own: a candidate, which gets its last component."""
        scaled = v / self.longest
        last = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1))) if own else np.zeros(len(v))
        full = np.column_stack([scaled, last])
        return np.einsum("nd,lmd->nlm", full, self.direction) / self.width + self.shift

    def probes(self, place: np.ndarray, radius: float, need: float) -> np.ndarray | None:
        """Buckets [probes, hashes] of one table for a query, likeliest first, until their chances reach ``need``; None if they are too many."""
        spread = radius / self.width
        buckets, chance = np.zeros((1, 0), np.int64), np.ones(1)
        spare = (1 - need) / (2 * len(place))  # chance that each function's unlikely buckets may lose
        for x in place:
            reach = np.arange(math.floor(x - 4 * spread), math.floor(x + 4 * spread) + 1)
            own = np.diff(_normal((np.append(reach, reach[-1] + 1) - x) / spread))
            buckets = np.column_stack([np.repeat(buckets, len(reach), axis=0), np.tile(reach, len(buckets))])
            chance = np.outer(chance, own).ravel()
            order = np.argsort(-chance, kind="stable")
            kept = order[: np.searchsorted(np.cumsum(chance[order]), chance.sum() - spare) + 1]
            if len(kept) > MOST_PROBES:
                return None
            buckets, chance = buckets[kept], chance[kept]
        return buckets[: np.searchsorted(np.cumsum(chance), need) + 1]


def _normal(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z])


def _keys(table: int, buckets: np.ndarray) -> np.ndarray:
    """One long for each bucket [rows, hashes]; two that fall together are one bucket of both."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(buckets), np.uint64)
        # The table comes first, so that single functions of two tables differ too.
        for column in (np.full(len(buckets), table + 1), *buckets.T):
            out = (out ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """One (vec_id, v double array) for each vec_id that takes part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.filter(F.size("v") == (size["size"] if size else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def fit(rows: DataFrame, top: int, recall: float, tables: int, seed: int = 11, sample_rows: int = SAMPLE_ROWS) -> Hashes | None:
    """Choose distances and functions; None for an empty table."""
    stats = rows.agg(F.count("vec_id").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    if not stats["n"]:
        return None
    longest = math.sqrt(stats["square"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    v = np.array([r["v"] for r in sample]) / longest
    inner = v[:512] @ v.T
    rank = min(len(v) - 1, max(1, round(top * len(v) / stats["n"])))
    inner[np.arange(len(inner)), np.arange(len(inner))] = -np.inf
    kth = np.sort(inner, axis=1)[:, -rank] if len(v) > 1 else np.ones(1)
    near = math.sqrt(max(float(np.median((v[: len(inner)] ** 2).sum(axis=1) + 1 - 2 * kth)), 1e-3))
    width = 2 * near
    chance = np.random.default_rng(seed)
    most = 16
    found = Hashes(chance.normal(size=(tables, most, v.shape[1] + 1)), chance.random((tables, most)), width, longest, near, 1 - (1 - recall) ** (1 / tables))
    # The functions with the least work: probes of a query times what each costs.
    at = np.floor(found.places(v * longest, True)[:, 0]).astype(np.int64)
    asked = found.places(v[:: max(1, len(v) // 32)] * longest, False)[:, 0]
    least, hashes = math.inf, 1
    for k in range(1, most + 1):
        lists = [found.probes(place[:k], near, found.need) for place in asked]
        if any(x is None for x in lists):
            break
        size = np.unique(_keys(0, at[:, :k]), return_counts=True)[1]
        rows_met = (size * (size - 1)).sum() / max(len(v) * (len(v) - 1), 1) * stats["n"]
        work = np.mean([len(x) for x in lists]) * (rows_met + PROBE_COST)
        if work < least:
            least, hashes = work, k
    found.direction, found.shift = found.direction[:, :hashes], found.shift[:, :hashes]
    return found


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _index(rows: DataFrame, hashes: Hashes) -> DataFrame:
    """(bucket, id, v): a row for each table of each vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v = _vectors(batch["v"])
                at = np.floor(hashes.places(v, True)).astype(np.int64)
                data = pa.array([x.tobytes() for x in v], pa.binary())
                for t in range(at.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(t, at[:, t])), batch["vec_id"], data], ["bucket", "id", "v"])

    return rows.mapInArrow(work, "bucket long, id long, v binary")


def _probe(asks: DataFrame, hashes: Hashes, again: bool) -> DataFrame:
    """(bucket, id, v, floor) for the buckets that queries (vec_id, v, floor, kth) visit, in their first round or again; EVERY for those that meet all rows."""

    def found(p: np.ndarray, usual: float, own: float) -> list[np.ndarray]:
        lists = []
        for t in range(len(p)):
            first, more = hashes.probes(p[t], usual, FIRST), hashes.probes(p[t], own, hashes.need) if again else None
            if first is None or (again and more is None):
                return [np.array([EVERY])]
            first = _keys(t, first)
            lists.append(np.setdiff1d(_keys(t, more), first) if again else first)
        return lists

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = _vectors(batch["v"])
            place, square = hashes.places(v, False), (v**2).sum(axis=1) / hashes.longest**2
            data = pa.array([x.tobytes() for x in v], pa.binary())
            keys, rows = [], []
            for k, (p, s, kth) in enumerate(zip(place, square, batch["kth"].to_pylist(), strict=True)):
                usual = math.sqrt(max(s + hashes.near**2 - 1, 1e-3))
                own = math.sqrt(max(s + 1 - 2 * kth / hashes.longest**2, 1e-3)) if kth is not None else math.sqrt(s) + 1
                for own_keys in found(p, usual, own):
                    keys.append(own_keys)
                    rows += [k] * len(own_keys)
                if len(rows) >= PROBES_AT_ONCE or k == len(v) - 1:
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch["vec_id"].take(at), data.take(at), batch["floor"].take(at)], ["bucket", "id", "v", "floor"])
                    keys, rows = [np.empty(0, np.int64)], []

    return asks.mapInArrow(work, "bucket long, id long, v binary, floor double")


def _whole(rows: DataFrame) -> DataFrame:
    """(bucket, id, v): all rows in the one bucket EVERY."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                data = pa.array([x.tobytes() for x in _vectors(batch["v"])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), EVERY)), batch["vec_id"], data], ["bucket", "id", "v"])

    return rows.mapInArrow(work, "bucket long, id long, v binary")


def best_of(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, c: np.ndarray, c_ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and exact scores of each query's ``top`` candidates that reach its floor, its own id left out."""
    c_ids, order = np.unique(c_ids, return_index=True)
    c = c[order]
    rough = q @ c.T
    own = np.searchsorted(c_ids, q_ids)
    same = np.flatnonzero(np.append(c_ids, -1)[own] == q_ids) if len(c_ids) else []
    same = [k for k in same if own[k] < len(c_ids)]
    rough[same, own[same]] = -np.inf
    if rough.shape[1] > top:
        floor = np.maximum(floor, np.partition(rough, -top, axis=1)[:, -top])
    size = np.maximum(1.0, np.abs(np.where(np.isfinite(floor), floor, 1.0)))
    k, j = np.nonzero((rough >= (floor - 1e-9 * size)[:, None]) & np.isfinite(rough))
    # Exact products add up component by component, so that equal vectors tie exactly.
    exact = np.zeros(len(k))
    for d in range(q.shape[1]):
        exact += q[k, d] * c[j, d]
    order = np.lexsort((c_ids[j], -exact, k))
    k, j, exact = k[order], j[order], exact[order]
    first = np.searchsorted(k, k)
    kept = np.arange(len(k)) - first < top
    return q_ids[k[kept]], c_ids[j[kept]], exact[kept]


def _met(members: DataFrame, asked: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """(query_id, vec_id, score): what queries find in the buckets that they visit."""
    if not asked.filter(F.col("bucket") == EVERY).isEmpty():
        members = members.unionByName(_whole(rows))
    counts = lambda df, name: df.groupBy("bucket").agg(F.count("id").alias(name))
    blocks = lambda name, size: F.ceil(F.col(name) / size).cast("int")
    sizes = counts(members, "held").join(counts(asked, "asking"), "bucket").withColumns({"parts": blocks("held", BLOCK_ROWS), "asked_parts": blocks("asking", BLOCK_QUERIES)})
    sizes = cut(sizes, "nearest-sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    held = members.join(sizes, "bucket").select("bucket", own(F.col("parts")).alias("part"), every(F.col("asked_parts")).alias("asked_part"), F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("floor"))
    asking = asked.join(sizes, "bucket").select("bucket", every(F.col("parts")).alias("part"), own(F.col("asked_parts")).alias("asked_part"), F.lit(True).alias("asks"), "id", "v", "floor")

    def work(pack: pa.Table) -> pa.Table:
        pack = pack.sort_by([(c, "ascending") for c in ("bucket", "part", "asked_part", "asks")])
        key = np.column_stack([pack[c].to_numpy() for c in ("bucket", "part", "asked_part")])
        asks, ids = pack["asks"].to_numpy(), pack["id"].to_numpy()
        floor = np.nan_to_num(pack["floor"].to_numpy(), nan=-np.inf)
        v = np.frombuffer(b"".join(pack["v"].to_pylist())).reshape(len(pack), -1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(key)), strict=True):
            m = a + np.searchsorted(asks[a:b], True)
            for k in range(m, b, QUERIES_AT_ONCE) if a < m else ():
                few = slice(k, min(k + QUERIES_AT_ONCE, b))
                out.append(best_of(v[few], ids[few], floor[few], v[a:m], ids[a:m], top))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    # Small blocks share a call. Rows of a bucket come once for each block that they meet.
    dealt = sizes.agg(F.sum(F.col("held") * F.col("asked_parts") + F.col("asking") * F.col("parts"))).first()[0] or 0
    packs = max(1, dealt // PACK_ROWS)
    found = held.unionByName(asking).groupBy(F.pmod(F.xxhash64("bucket", "part", "asked_part"), F.lit(packs)).alias("pack")).applyInArrow(work, "query_id long, vec_id long, score double")
    return cut(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "nearest-found")


def nearest(vectors: DataFrame, is_query, top: int = 20, recall: float = 0.93, tables: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (a Column over vec_id) marks, its ``top`` nearest found."""
    rows = cut(usable(vectors), "nearest-rows")
    hashes = fit(rows, top, recall, tables)
    if hashes is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    members = cut(_index(rows, hashes), "nearest-members")
    asks = rows.filter(is_query)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    none = F.lit(None).cast("double")
    asked = cut(_probe(asks.select("vec_id", "v", none.alias("floor"), none.alias("kth")), hashes, False), "nearest-probes")
    found = _met(members, asked, rows, top)
    forget(asked)
    # Of a query's ``top`` nearest, the first round has found about this many.
    share = 1 - (1 - FIRST) ** tables
    expected = min(top, math.ceil(top * share))
    at = lambda n: F.max(F.when(F.col("place") == n, F.col("score")))
    scale = found.withColumn("place", place).groupBy("query_id").agg(at(top).alias("floor"), at(expected).alias("kth"))
    asks = asks.join(scale, asks["vec_id"] == scale["query_id"], "left").select("vec_id", "v", "floor", "kth")
    asked = cut(_probe(asks, hashes, True), "nearest-probes")
    found = found.unionByName(_met(members, asked, rows, top))
    forget(asked, members)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", place).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(vectors: DataFrame) -> DataFrame:
    """op4: queries are the rows whose vec_id is divisible by 20."""
    return nearest(vectors.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
