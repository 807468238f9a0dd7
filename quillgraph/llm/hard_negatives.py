"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Candidates are sorted by label and by their place on a Hilbert curve through
the whole components, and written as Parquet in blocks of at most
``BLOCK_ROWS`` rows of one label. A zone map holds each block's least and
greatest value of every component. By interval arithmetic it bounds the inner
product of an anchor with any row of the block from both sides, and so tells
which blocks the anchor's window of scores must read: only these are.

Anchors are the stated query set. They come in chunks of at most
``CHUNK_ANCHORS``, the only thing broadcast, and each chunk makes four passes.
Two find its positives, two the negatives in each positive's window. Of both,
the first pass reads an anchor's ``PROBES`` blocks of the greatest bounds and a
fixed share (1 / ``SHARE``) of all blocks. What it finds raises the floor of
each window to a score that enough rows are known to reach; the second pass
reads all blocks whose bounds meet the window above that floor, and its result
is whole. A task hands on at most ``top`` rows of a window. Zone maps and
blocks stay in the shared folder; the driver holds one chunk.

Where vectors spread evenly over many components, boxes are wide and bounds
leave nearly every block to be read; the passes then are a blocked search of
all rows.

Defined cases: rows take no part if their vec_id, label or vector is null, if a
component is null or not finite, or if the vector has another length than most
(of two equally common lengths the greater). Of rows that repeat a vec_id the
one of the smallest (label, vector) counts. Windows of negative positive scores
are empty. Other columns do not enter. An empty table gives an empty result. A
component beyond ``common.MOST_WHOLE`` once it is an integer is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, finite, forget, matrix, partitions, whole

BLOCK_ROWS, CHUNK_ANCHORS = 1024, 32_768
#: Blocks that each anchor reads for a floor, and one over the share of all blocks read beside them.
PROBES, SHARE = 8, 32
#: Bits of a component on the curve; rows of a written partition; needed blocks (8 bytes each) that are broadcast; products held at once.
BITS, PART_ROWS, BROADCAST_BLOCKS, HELD = 4, 200_000, 1_000_000, 2_000_000
LEAST, MOST = -(1 << 62), 1 << 62


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of cells [rows, dims] of ``bits`` bits each, as bytes that sort in curve order."""
    x = cells.astype(np.uint32).copy()
    dims = x.shape[1]
    # Undo, from the finest level up, the turns that the curve makes in each cell.
    for level in range(bits - 1, 0, -1):
        below = np.uint32((1 << level) - 1)
        for d in range(dims):
            upper = (x[:, d] >> np.uint32(level)) & 1 == 1
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, d]) & below).astype(np.uint32)
            x[:, 0] ^= np.where(upper, below, swap)
            x[:, d] ^= swap
    # What is left is a Gray code over the components.
    np.bitwise_xor.accumulate(x, axis=1, out=x)
    turn = np.zeros(len(x), np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> np.uint32(level)) & 1 == 1, (1 << level) - 1, 0).astype(np.uint32)
    x ^= turn[:, None]
    planes = [(x >> np.uint32(level)) & 1 for level in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)]


def reach(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product [rows of v, boxes] of vectors with any point of boxes low..high."""
    up, down = np.maximum(v, 0), np.minimum(v, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


@dataclass
class Asked:
    """A chunk of anchors with their windows [anchors, windows] of scores, and what windows are named by."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    floor: np.ndarray
    ceiling: np.ndarray
    names: np.ndarray
    same: bool
    top: int
    probe: np.ndarray | None = None

    def meets(self, label: int) -> np.ndarray:
        """Anchors that look for rows of this label."""
        return np.flatnonzero((self.labels == label) == self.same)

    def wanted(self, some: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, all_: bool = False) -> np.ndarray:
        """Whether each of some anchors must read one box."""
        least, greatest = (x[:, 0] for x in reach(self.v[some], low[None], high[None]))
        hit = ((greatest[:, None] >= floor[some]) & (least[:, None] <= self.ceiling[some])).any(axis=1)
        return hit if self.probe is None or all_ else hit & (greatest >= self.probe[some])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v array of longs): one row for each vec_id that takes part."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite(F.col("embedding")), F.lit(False))
    rows = vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), whole(F.col("embedding")).alias("v"))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.filter((F.size("v") == (size["size"] if size else 0)) & (F.size("v") > 0))
    if rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def _ranges(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many rows there are, and each component's least and greatest value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v = matrix(batch["v"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(v.shape[1]), pa.int32()), pa.array(v.min(axis=0)), pa.array(v.max(axis=0)), pa.array(np.full(v.shape[1], len(v)))], ["place", "low", "high", "rows"])

    parts = rows.select("v").mapInArrow(work, "place int, low long, high long, rows long").groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"))
    found = parts.orderBy("place").collect()  # a row for each component
    return found[0]["rows"] if found else 0, np.array([r["low"] for r in found], np.int64), np.array([r["high"] for r in found], np.int64)


def in_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """(block, label, vec_id, v), written in the order of label and curve; None for an empty table."""
    count, low, high = _ranges(rows)
    if not count:
        return None

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cells = (matrix(batch["v"]) - low) * (1 << BITS) // (high - low + 1)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("vec_id", "label", "v")), pa.array(hilbert_keys(cells, BITS), pa.binary())], ["vec_id", "label", "v", "key"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, label, held = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            blocks = np.empty(len(batch), np.int64)
            labels = batch["label"].to_numpy()
            starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]) if len(labels) else []
            for a, b in zip(starts, np.append(starts[1:], len(labels)), strict=True):
                if labels[a] != label:
                    block, label, held = block + 1, labels[a], 0
                places = held + np.arange(b - a)
                blocks[a:b] = block + places // block_rows
                held, block = int(places[-1] + 1) % block_rows, int(blocks[b - 1]) + ((int(places[-1]) + 1) % block_rows == 0)
            yield pa.RecordBatch.from_arrays([pa.array(blocks), *(batch[c] for c in ("label", "vec_id", "v"))], ["block", "label", "vec_id", "v"])

    parts = max(partitions(rows.sparkSession), -(-count // PART_ROWS))
    order = ["label", "key", "vec_id"]
    ordered = rows.mapInArrow(keyed, "vec_id long, label int, v array<long>, key binary").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(ordered.mapInArrow(dealt, "block long, label int, vec_id long, v array<long>"), "hilbert-blocks")


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, block, label) of the runs of one block."""
    blocks, labels = batch["block"].to_numpy(), batch["label"].to_numpy()
    starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.empty(0, np.int64)
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(blocks)).tolist(), strict=True):
        yield a, b, int(blocks[a]), int(labels[a])


def zone_maps(blocks: DataFrame) -> DataFrame:
    """(block, label, low, high); a block that lies in several batches has a row for each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, runs = matrix(batch["v"]) if len(batch) else None, list(_portions(batch))
            if runs:
                sides = [pa.array([f(v[a:b]).tolist() for a, b, *_ in runs], pa.list_(pa.int64())) for f in (lambda x: x.min(axis=0), lambda x: x.max(axis=0))]
                yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in runs], pa.int64()), pa.array([r[3] for r in runs], pa.int32()), *sides], ["block", "label", "low", "high"])

    return cut(blocks.mapInArrow(work, "block long, label int, low array<long>, high array<long>"), "zone-maps")


def _shared(block: np.ndarray) -> np.ndarray:
    """Whether a block is of the share that every anchor reads for its floor."""
    with np.errstate(over="ignore"):
        return (block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(SHARE) == 0


def _thresholds(zones: DataFrame, asked: Asked) -> np.ndarray:
    """Each anchor's bound that its ``PROBES`` best blocks reach."""
    sent = zones.sparkSession.sparkContext.broadcast(asked)  # at most CHUNK_ANCHORS anchors

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        best = np.full((len(own.ids), PROBES), LEAST)
        for batch in batches:
            low, high, labels = matrix(batch["low"]), matrix(batch["high"]), batch["label"].to_numpy()
            for label in np.unique(labels):
                some, zone = own.meets(label), np.flatnonzero(labels == label)
                step = max(1, HELD // max(1, len(zone)))
                for at in range(0, len(some), step):
                    part = some[at : at + step]
                    both = np.concatenate([best[part], reach(own.v[part], low[zone], high[zone])[1]], axis=1)
                    best[part] = np.partition(both, both.shape[1] - PROBES, axis=1)[:, -PROBES:]
        anchor, place = np.nonzero(best > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(best[anchor, place])], ["anchor", "bound"])

    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("bound")))
    found = zones.select("label", "low", "high").mapInArrow(work, "anchor int, bound long").withColumn("place", place).filter(F.col("place") <= PROBES)
    out = np.full(len(asked.ids), LEAST)
    for r in found.groupBy("anchor").agg(F.min("bound").alias("bound")).collect():  # a row for each anchor of the chunk
        out[r["anchor"]] = r["bound"]
    sent.destroy()
    return out


def _needed(blocks: DataFrame, zones: DataFrame, sent) -> DataFrame:
    """The rows of the blocks that some anchor must read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if not len(batch):
                continue
            low, high, labels, block = matrix(batch["low"]), matrix(batch["high"]), batch["label"].to_numpy(), batch["block"].to_numpy()
            need = _shared(block) if own.probe is not None else np.zeros(len(batch), bool)
            for k in np.flatnonzero(~need):
                need[k] = own.wanted(own.meets(labels[k]), low[k], high[k], own.floor).any()
            yield pa.RecordBatch.from_arrays([batch["block"].filter(pa.array(need))], ["block"])

    needed = cut(zones.mapInArrow(work, "block long").distinct(), "needed-blocks")
    facts = needed.agg(F.count("block").alias("n"), F.min("block").alias("low"), F.max("block").alias("high")).first()
    chosen = F.broadcast(needed) if facts["n"] <= BROADCAST_BLOCKS else needed
    return blocks.filter(F.col("block").between(facts["low"], facts["high"])).join(chosen, "block", "left_semi")


class Best:
    """The ``top`` best rows of each window: greatest score, then smallest id."""

    def __init__(self, windows: int, top: int):
        self.score, self.id = np.full((windows, top), LEAST), np.full((windows, top), MOST)

    def offer(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        top = self.score.shape[1]
        touched = np.unique(window)
        window = np.concatenate([window, np.repeat(touched, top)])
        score, ids = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        kept = place < top
        self.score[window[kept], place[kept]], self.id[window[kept], place[kept]] = score[kept], ids[kept]


def _search(rows: DataFrame, sent) -> DataFrame:
    """(window, name, vec_id, score): each task's best rows of every window; ``window`` counts anchors x windows of an anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        wide = own.floor.shape[1]
        best = Best(own.floor.size, own.top)
        floor = own.floor.copy()
        for batch in batches:
            v, ids = matrix(batch["v"]) if len(batch) else None, batch["vec_id"].to_numpy()
            for a, b, block, label in _portions(batch):
                low, high = v[a:b].min(axis=0), v[a:b].max(axis=0)
                some = own.meets(label)
                some = some[own.wanted(some, low, high, floor, bool(own.probe is not None and _shared(np.array([block]))[0]))]
                # Products are exact in doubles while they stay below 2 ** 53.
                small = len(some) and np.abs(own.v[some]).max() * max(abs(int(low.min())), abs(int(high.max()))) * v.shape[1] < 1 << 53
                step = max(1, HELD // (b - a))
                for at in range(0, len(some), step):
                    part = some[at : at + step]
                    product = v[a:b].astype(float) @ own.v[part].T.astype(float) if small else v[a:b] @ own.v[part].T
                    if own.same:
                        r, k = np.nonzero(ids[a:b, None] == own.ids[part])
                        product[r, k] = LEAST
                    for w in range(wide):
                        least = np.maximum(floor[part, w], LEAST + 1)
                        hit = (product >= least) & (product <= own.ceiling[part, w])
                        if hit.sum() > 4 * own.top * len(part) and len(hit) > own.top:
                            reached = np.partition(np.where(hit, product, LEAST), len(hit) - own.top, axis=0)[-own.top]
                            hit &= product >= reached
                        r, k = np.nonzero(hit)
                        if len(r):
                            window = part[k] * wide + w
                            best.offer(window, product[r, k].astype(np.int64), ids[a + r])
                            floor[part, w] = np.maximum(floor[part, w], best.score[part * wide + w, -1])
        window, place = np.nonzero(best.score > LEAST)
        columns = [pa.array(window.astype(np.int64)), pa.array(own.names.ravel()[window]), pa.array(best.id[window, place]), pa.array(best.score[window, place])]
        yield pa.RecordBatch.from_arrays(columns, ["window", "name", "vec_id", "score"])

    return rows.mapInArrow(work, "window long, name long, vec_id long, score long")


def _found(blocks: DataFrame, zones: DataFrame, asked: Asked) -> DataFrame:
    """(window, name, place, vec_id, score): the best rows of every window."""
    context = blocks.sparkSession.sparkContext
    best_first = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    asked.probe = _thresholds(zones, asked)
    sent = context.broadcast(asked)
    ranked = lambda df: df.withColumn("place", F.row_number().over(best_first)).filter(F.col("place") <= asked.top)
    for r in ranked(_search(_needed(blocks, zones, sent), sent)).filter(F.col("place") == asked.top).select("window", "score").collect():  # a row for each window of the chunk
        asked.floor.ravel()[r["window"]] = max(asked.floor.ravel()[r["window"]], r["score"])
    sent.destroy()
    asked.probe = None
    sent = context.broadcast(asked)
    return ranked(_search(_needed(blocks, zones, sent), sent))


def _chunks(anchors: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of at most ``size`` anchors, in the order of the blocks; the driver holds one chunk."""
    held: list = []
    for r in anchors.select("vec_id", "label", "v").toLocalIterator():
        held.append((r["vec_id"], r["label"], np.array(r["v"], np.int64)))
        if len(held) == size:
            yield tuple(map(np.array, zip(*held, strict=True)))
            held = []
    if held:
        yield tuple(map(np.array, zip(*held, strict=True)))


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, chunk: int = CHUNK_ANCHORS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives are an anchor's best rows of its label; negatives the best rows of
    other labels that score from ``low`` to ``high`` percent of the positive.
    ``is_anchor``: a Column over vec_id.
    """
    out = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = in_blocks(usable(vectors), block_rows)
    if blocks is None:
        return out
    zones = zone_maps(blocks)
    for ids, labels, v in _chunks(blocks.filter(is_anchor), chunk):
        every = (len(ids), 1)
        positive = _found(blocks, zones, Asked(ids, labels, v, np.full(every, LEAST), np.full(every, MOST), ids, True, positives))
        names, score = np.full((len(ids), positives), -1), np.full((len(ids), positives), -1)
        for r in positive.collect():  # the positives of one chunk
            names[r["window"], r["place"] - 1], score[r["window"], r["place"] - 1] = r["vec_id"], r["score"]
        floor, ceiling = -(-low * score // 100), high * score // 100
        floor[score < 0], ceiling[score < 0] = MOST, LEAST
        found = _found(blocks, zones, Asked(ids, labels, v, floor, ceiling, names, False, negatives))
        # One long names a window's positive; its anchor and score follow from the window.
        told = vectors.sparkSession.sparkContext.broadcast((ids, score))

        def shown(batches: Iterator[pa.RecordBatch], told=told, wide=positives) -> Iterator[pa.RecordBatch]:
            anchors, scores = told.value
            for b in batches:
                window = b["window"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[window // wide]), b["name"], b["place"], b["vec_id"], pa.array(scores.ravel()[window]), b["score"]],
                    ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
                )

        out = out.unionByName(cut(found.mapInArrow(shown, out.schema), "hard-negatives"))
    forget(blocks, zones)
    return out


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """op11: anchors are the rows whose vec_id is divisible by 50; where it is divisible by 7, the label becomes (label + 1) % 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


HARD_NEGATIVES_SQL = """WITH ok AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
  scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM ok a, ok r WHERE a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
  positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER best)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3"""
