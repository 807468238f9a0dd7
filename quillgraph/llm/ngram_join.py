"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles of ``words`` words. If two sets of
sizes a and b have Jaccard similarity num/den or more, their symmetric
difference is at most d = (a + b)(den - num) / (den + num). Sizes fall into
bands; a document enters its own band, and the next one if a partner can be
there. In a band, shingles are XOR-hashed into a sketch of B blocks: each block
has the XOR of its shingles' 64-bit codes as its word, and eight parity bits.
The Hamming distance of the parity bits never exceeds the symmetric difference,
and d differing shingles leave all but d blocks alike (pigeonhole). So in any
order of the words that is the same for all documents, two linked documents
share one of their first d + 1. The order goes by how many classes hold a word,
rarest first, and blocks without a shingle last: a document's most frequent
words beyond d + 1 drop out, and words of one class alone need no partner.

Copies of one set are one class. Of the documents that share a word, each is
first compared exactly to the one that shares most words with others. Where a
word's group then still spans components, a group of a few is compared pair by
pair, a larger one by Hamming distance in blocks of bounded size. Near pairs of
different components are verified exactly: all of them in one round, or, where
a block has very many, the nearest first, round by round, until none is left
that would join two components. No link between different components is lost, and no
group is expanded into all pairs.

Defined cases: a text without words, or null, has the empty set and no links.
Each row is a document of its own, so rows that repeat a doc_id are linked only
by their texts. A null doc_id is never the smallest unless it is alone. An
empty table gives an empty table. Shingles, sets and words are told apart by
64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, forget, fresh, no_resident
from quillgraph.llm.components import components

#: Documents of a word's group that one task compares with as many others.
BLOCK_ROWS = 1024
#: Groups of at most so many classes are compared pair by pair; rows of larger ones in one call.
FEW, PACK_ROWS = 6, 4000
#: Near pairs of a block that are all tested, for each of its rows; 64-bit words that one comparison holds.
ALL_PER_ROW, HELD_WORDS = 4, 4_000_000
#: Words of a text that are hashed at once.
WORDS_AT_ONCE = 100_000
#: Chosen documents (24 bytes each), or open words (16), that are broadcast to find their rows; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; link at num/den; bands end at ``ratio`` times their start."""

    words: int = 5
    num: int = 80
    den: int = 100
    ratio: float = 1.6

    def ends(self, top: int = 1 << 40) -> list[int]:
        out, low = [], 1
        ratio = max(self.ratio, self.den / self.num)
        while low <= top:
            out.append(max(low, int(low * ratio)))
            low = out[-1] + 1
        return out

    def need(self, n: int, end: int) -> int:
        """Words of a sketch of a band up to ``end`` of which a set of size n shares one with each partner."""
        return self.apart(n, min(end, n * self.den // self.num)) + 1

    def apart(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A-Z to lower case, other white space to a space.
_PLAIN = bytes(0x20 if 0x09 <= c <= 0x0D else c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of the whole text: the sum of mixed (byte, place) pairs, mixed with the length."""
    data = np.frombuffer((text or "").encode().translate(_PLAIN), np.uint8)
    gap = np.r_[True, data == 0x20]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), WORDS_AT_ONCE):
        first = starts[k : k + WORDS_AT_ONCE]
        end = starts[k + WORDS_AT_ONCE] if k + WORDS_AT_ONCE < len(starts) else len(data)
        part, at = data[first[0] : end], first - first[0]
        place = np.arange(len(part)) - np.repeat(at, np.diff(at, append=len(part)))
        mixed = _mix((part + (place << 8) + 1).astype(np.uint64))
        inside = part != 0x20
        mixed[~inside] = 0
        out[k : k + WORDS_AT_ONCE] = _mix(np.add.reduceat(mixed, at) + np.add.reduceat(inside, at, dtype=np.uint64))
    return out


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the whole text."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def sketch(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``size`` blocks of sorted hashes: the XOR of each block's hashes, and eight parity bits for each block."""
    slot = ((hashes >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)  # rises with the hash
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    words = np.zeros(size, np.uint64)
    words[slot[first]] = np.bitwise_xor.reduceat(_mix(hashes), first)
    odd = np.bincount(slot * 8 + (hashes & np.uint64(7)).astype(np.int64), minlength=-(-size // 8) * 64) & 1
    return words, np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_sketches(hashes: np.ndarray, rule: Rule, ends: list[int]) -> list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]:
    """The document's bands, its own first, each with the number of words it needs and its sketch."""
    n = len(hashes)
    if not n:
        return []
    home = bisect_left(ends, n)
    bands = [home] + ([home + 1] if n * rule.den >= rule.num * (ends[home] + 1) else [])
    return [(k, rule.need(n, ends[k]), sketch(hashes, rule.apart(ends[k], ends[k]) + 1)) for k in bands]


def _offsets(parts: list) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """A list of longs for each array."""
    return pa.ListArray.from_arrays(_offsets(parts), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def _sketched(docs: DataFrame, rule: Rule) -> DataFrame:
    """A row for each document; of a task's copies of one set only the first has sketches."""
    ends = rule.ends()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_resident()
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                n, labels, found = [], [], []
                for text in part["text"].to_pylist():
                    h = shingles(text, rule.words)
                    with np.errstate(over="ignore"):
                        label = int((_mix(_mix(h + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(h))) if len(h) else np.uint64(0)).view(np.int64))
                    n.append(len(h))
                    labels.append(label)
                    found.append([] if label in seen else band_sketches(h, rule, ends))
                    seen.add(label)
                flat = [x for own in found for x in own]
                sketches = pa.StructArray.from_arrays(
                    [pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1)] + [_lists([x[2][k].view(np.int64) for x in flat]) for k in (0, 1)], ["band", "need", "words", "bits"]
                )
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_hash"], pa.array(n, pa.int64()), pa.array(labels, pa.int64()), pa.ListArray.from_arrays(_offsets(found), sketches)],
                    ["doc_id", "text_hash", "n", "cls", "sketches"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, text_hash long, n long, cls long, sketches array<struct<band int, need int, words array<long>, bits array<long>>>")


def _words(sketched: DataFrame) -> DataFrame:
    """(word, cls): one row for each telling word of a sketch. The word's last byte is its band; its sign bit marks an empty block."""
    each = sketched.select("cls", F.explode("sketches").alias("s"))
    each = each.select("cls", F.col("s.band").alias("band"), F.col("s.words").alias("words"), (_held("s.words") < F.col("s.need")).alias("sparse"))
    each = each.select("cls", "band", "sparse", F.posexplode("words").alias("place", "code")).filter("code <> 0 or sparse")
    word = F.shiftleft(F.xxhash64("place", "code", "band"), 8).bitwiseAND((1 << 63) - 1).bitwiseOR(F.col("band").cast("long"))
    return each.select(F.when(F.col("code") == 0, word.bitwiseOR(-(1 << 63))).otherwise(word).alias("word"), "cls")


def _held(words):
    """How many blocks of a sketch hold a shingle."""
    return F.size(F.filter(words, lambda w: w != 0))


def _needed(shared: DataFrame, light: DataFrame) -> DataFrame:
    """(word, cls): the shared words of a class but for its most frequent ones beyond what it needs."""
    bands = light.select("cls", F.explode("bands").alias("b")).select("cls", F.col("b.band").alias("band"), F.col("b.spare").alias("spare"))
    rows = shared.withColumn("band", F.col("word").bitwiseAND(255).cast("int")).join(bands, ["cls", "band"])
    frequent = Window.partitionBy("cls", "band").orderBy(F.col("word") >= 0, F.desc("holders"), "word")
    return rows.withColumn("place", F.row_number().over(frequent)).filter("place > spare").select("word", "cls")


def _near(pairs: DataFrame, light: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, near) for pairs of classes: whether sizes and Hamming distance leave a link possible. ``light``: (cls, n, bits by band)."""
    left = light.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = light.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    band = F.array_max(F.array_intersect(F.map_keys("ba"), F.map_keys("bb")))
    far = F.aggregate(F.zip_with(F.col("ba")[F.col("band")], F.col("bb")[F.col("band")], lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    fits = F.least("na", "nb") * rule.den >= F.greatest("na", "nb") * rule.num
    bound = (F.col("na") + F.col("nb")) * (rule.den - rule.num)
    rows = pairs.join(left, "a").join(right, "b").withColumn("band", band)
    return rows.select("a", "b", F.coalesce(fits & (far * (rule.den + rule.num) <= bound), F.lit(False)).alias("near"))


def _verified(near: DataFrame, docs: DataFrame, label: DataFrame, sets: list[DataFrame], rule: Rule) -> DataFrame:
    """(a, b, near, linked), written, for pairs marked near or not; the exact sets of ``sets`` and those added to it decide on the near ones."""
    close = near.filter("near").select("a", "b")
    out = near.filter("not near").withColumn("linked", F.lit(False))
    needed = close.select(F.col("a").alias("cls")).unionByName(close.select(F.col("b").alias("cls"))).distinct()
    if sets:
        needed = needed.join(reduce(DataFrame.unionByName, sets).select("cls"), "cls", "left_anti")
    needed = label.select("cls", "doc_id", "text_hash").join(needed, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    needed = cut(needed.select("cls", "row.doc_id", "row.text_hash"), "needed")
    count = needed.count()
    if count:
        chosen = F.broadcast(needed) if count <= BROADCAST_ROWS else needed
        sets.append(cut(_sets(docs, chosen, rule), "shingle-sets"))
    if sets:
        every = reduce(DataFrame.unionByName, sets)
        left = every.select(F.col("cls").alias("a"), F.col("hashes").alias("ha"))
        right = every.select(F.col("cls").alias("b"), F.col("hashes").alias("hb"))
        both = F.size(F.array_intersect("ha", "hb"))
        union = F.size("ha") + F.size("hb") - both
        decided = close.join(left, "a").join(right, "b").select("a", "b", F.lit(True).alias("near"), (both * rule.den >= union * rule.num).alias("linked"))
        out = decided.unionByName(out)
    out = cut(out, "verified")
    forget(needed)
    return out


def _sets(docs: DataFrame, chosen: DataFrame, rule: Rule) -> DataFrame:
    """(cls, hashes) for chosen (cls, doc_id, text_hash)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = _lists([shingles(t, rule.words).view(np.int64) for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["cls"], found], ["cls", "hashes"])

    own = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    rows = own.join(chosen, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))).select("cls", "text")
    return rows.mapInArrow(work, "cls long, hashes array<long>").dropDuplicates(["cls"])


def _nearest(block: dict[str, np.ndarray], failed: set[tuple[int, int]], rule: Rule, reach: int) -> tuple[list[tuple[int, int]], bool]:
    """Untested near pairs of different components in one block of a word's group, and whether these are all.

    If there are more than ALL_PER_ROW for each row, a spanning forest of the
    nearest, and each class's ``reach`` nearest. ``failed``: pairs tested and
    not linked, whether near in all bands or not; with them left out, every
    round that is not the last tests a pair more.
    """
    left, right = ({k: v[block["side"] != other] for k, v in block.items()} for other in (1, 0))
    if not len(left["cls"]) or not len(right["cls"]):
        return [], True
    lw, rw = np.stack(left["bits"]).view(np.uint64), np.stack(right["bits"]).view(np.uint64)
    found = []
    step = max(1, HELD_WORDS // rw.size)
    for at in range(0, len(lw), step):
        n, m = left["n"][at : at + step, None], right["n"][None, :]
        fits = (left["component"][at : at + step, None] != right["component"][None, :]) & (np.minimum(n, m) * rule.den >= np.maximum(n, m) * rule.num)
        i, k = np.nonzero(fits)
        i += at
        far = np.bitwise_count(lw[i] ^ rw[k]).sum(axis=1, dtype=np.int64)
        ok = far * (rule.den + rule.num) <= (left["n"][i] + right["n"][k]) * (rule.den - rule.num)
        found.append(np.stack([far[ok], i[ok], k[ok]]))
    far, i, k = np.concatenate(found, axis=1)
    a, b = left["cls"][i], right["cls"][k]
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low, far))
    pairs = dict.fromkeys(zip(low[order].tolist(), high[order].tolist(), strict=True))
    pairs = [p for p in pairs if p not in failed]
    if len(pairs) <= ALL_PER_ROW * len(block["cls"]):
        return pairs, True
    part = dict(zip(block["cls"].tolist(), block["component"].tolist(), strict=True))
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out, used = [], Counter()
    for p in pairs:
        x, y = top(part[p[0]]), top(part[p[1]])
        if x != y or min(used[p[0]], used[p[1]]) < reach - 1:
            root[x] = y
            used.update(p)
            out.append(p)
    return out, len(out) == len(pairs)


def _few(placed: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs of different components in groups of at most FEW classes."""
    groups = placed.join(open_.filter(F.col("size") <= FEW).select("word"), "word").groupBy("word").agg(F.collect_list(F.struct("cls", "component")).alias("m"))
    above = lambda x: F.filter("m", lambda y: (y["cls"] > x["cls"]) & (y["component"] != x["component"]))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(above(x), lambda y: F.struct(x["cls"].alias("a"), y["cls"].alias("b")))))
    return groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _many(placed: DataFrame, open_: DataFrame, light: DataFrame, tested: list[DataFrame], rule: Rule, reach: int) -> DataFrame:
    """(a, b, word), written: near untested pairs of different components in larger groups, compared in blocks; ``word`` names the groups that have more of them.

    ``tested``: the pairs of earlier rounds over these groups. A group's largest component has no pairs within itself to find: its blocks
    only meet those of the rest, so that work grows with group times rest.
    """
    members = placed.join(open_.filter(F.col("size") > FEW).select("word"), "word")
    parts = members.groupBy("word", "component").agg(F.count("cls").alias("size"))
    parts = parts.groupBy("word").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("size"))
    in_blocks = lambda size: F.ceil(size / BLOCK_ROWS).cast("int")
    parts = parts.select("word", F.col("main.component").alias("main"), in_blocks(F.col("size") - F.col("main.size")).alias("rest_blocks"), in_blocks(F.col("main.size")).alias("main_blocks"))
    members = rows = cut(members.join(parts, "word"), "open-groups")
    count = rows.count()
    if not count:
        forget(rows)
        return cut(placed.sparkSession.createDataFrame([], "a long, b long, word long"), "near-pairs")
    band = F.col("word").bitwiseAND(255).cast("int")
    in_main = F.col("component") == F.col("main")
    deal = lambda blocks: F.pmod(F.xxhash64("cls"), F.col(blocks)).cast("int")
    # Blocks of the rest come first, those of the largest component after them.
    own = F.when(in_main, F.col("rest_blocks") + deal("main_blocks")).otherwise(deal("rest_blocks"))
    last = F.when(in_main, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks")) - 1
    dealt = rows.select("word", "cls", "component", last.alias("last"), own.alias("own"))
    rows = dealt.join(light, "cls").select("word", "cls", "component", "n", "last", "own", F.col("bits")[band].alias("bits"))
    # Block pairs (low, high); side 0: left, 1: right, 2: both (a block with itself).
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    rows = rows.withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
    rows = rows.select("word", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "side", "cls", "component", "n", "bits")
    if tested:
        # A pair that was tested here and not linked goes as a row to the block pair of each group that holds both: side 3.
        at = lambda c: dealt.select("word", F.col("cls").alias(c), F.col("own").alias(f"own_{c}"))
        failed = reduce(DataFrame.unionByName, tested).filter("not linked").select("a", "b").join(at("a"), "a").join(at("b"), ["word", "b"])
        none = lambda kind: F.lit(None).cast(kind)
        ends = [F.least("own_a", "own_b").alias("low"), F.greatest("own_a", "own_b").alias("high")]
        rows = rows.unionByName(failed.select("word", *ends, F.lit(3).alias("side"), F.col("a").alias("cls"), F.col("b").alias("component"), none("long").alias("n"), none("array<long>").alias("bits")))
    # Small groups share a call; a call holds PACK_ROWS rows or so, or one block pair.
    packs = max(1, count // PACK_ROWS)

    def work(pack: pd.DataFrame) -> pd.DataFrame:
        pack = pack.sort_values(["word", "low", "high"], ignore_index=True)
        lost = pack["side"] == 3
        failed = {tuple(sorted(p)) for p in zip(pack["cls"][lost].tolist(), pack["component"][lost].tolist(), strict=True)}
        pack = pack[~lost].reset_index(drop=True)
        pack["n"] = pack["n"].astype("int64")
        columns = {c: pack[c].to_numpy() for c in ("word", "cls", "component", "n", "side", "bits")}
        key = pack[["word", "low", "high"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]).tolist()
        out: set[tuple] = set()
        for first, end in zip(starts, [*starts[1:], len(pack)], strict=True):
            pairs, all_ = _nearest({c: v[first:end] for c, v in columns.items()}, failed, rule, reach)
            out.update((a, b, None) for a, b in pairs)
            if not all_:
                out.add((None, None, int(columns["word"][first])))
        return pd.DataFrame({c: pd.array([row[k] for row in out], dtype="Int64") for k, c in enumerate(("a", "b", "word"))})

    found = cut(rows.groupBy(F.pmod(F.xxhash64("word", "low", "high"), F.lit(packs)).alias("pack")).applyInPandas(work, "a long, b long, word long"), "near-pairs")
    forget(members)
    return found


def shared_words(words: DataFrame) -> DataFrame:
    """(word, cls, holders): the rows (word, cls) whose word more than one class holds. Sums and joins, so that a word of very many rows can be split."""
    several = words.groupBy("word").agg(F.count("cls").alias("all")).filter("all > 1").select("word")
    # Copies in different tasks may bring a class's word more than once.
    rows = words.join(several, "word", "left_semi").distinct()
    return rows.join(rows.groupBy("word").agg(F.count("cls").alias("holders")).filter("holders > 1"), "word")


@dataclass
class Linked:
    """Pairs tested so far, their exact sets and the components (node, component) that they make; all written."""

    tested: list[DataFrame] = field(default_factory=list)
    parts: DataFrame | None = None
    sets: list[DataFrame] = field(default_factory=list)

    def add(self, more: DataFrame) -> None:
        """Pairs just tested; those linked join components, so that only these are worked on again."""
        self.tested.append(more)
        links = more.filter("linked").select("a", "b")
        if self.parts is None:
            self.parts = components(links)
            return
        if links.isEmpty():
            return
        ends = self.placed(links.withColumnRenamed("a", "cls")).select(F.col("component").alias("a"), F.col("b").alias("cls"))
        moved = components(self.placed(ends).select("a", F.col("component").alias("b")))
        to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
        held = self.parts.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        before, self.parts = self.parts, cut(held.unionByName(moved.join(self.parts, "node", "left_anti")), "components")
        forget(before, moved)

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of their column ``cls``."""
        if self.parts is None:
            return rows.withColumn("component", F.col("cls"))
        return rows.join(self.parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))

    def pairs(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tested)

    def untested(self, pairs: DataFrame) -> DataFrame:
        if not self.tested:
            return pairs
        return pairs.join(self.pairs().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")

    def forget(self) -> None:
        """Delete all but the components."""
        forget(*self.tested, *self.sets)


def connect(shared: DataFrame, light: DataFrame, label: DataFrame, docs: DataFrame, rule: Rule, so_far: Linked) -> None:
    """Bring into ``so_far`` all links between classes that share a word of ``shared`` (word, cls), which is written and deleted."""
    if so_far.parts is not None and shared.isEmpty():
        forget(shared)
        return
    # The class that shares most words with others leads each group.
    sizes = shared.groupBy("word").agg(F.count("cls").alias("size"))
    degree = shared.join(sizes, "word").groupBy("cls").agg(F.sum("size").alias("degree"))
    leads = shared.join(degree, "cls").groupBy("word").agg(F.max(F.struct("degree", (-F.col("cls")).alias("cls"))).alias("lead"))
    first = shared.join(leads, "word").groupBy("cls").agg(F.max("lead").alias("lead")).select("cls", (-F.col("lead.cls")).alias("b")).filter("cls <> b")
    if so_far.parts is not None:
        first = so_far.placed(first).select(F.col("cls").alias("a"), F.col("b").alias("cls"), F.col("component").alias("own"))
        first = so_far.placed(first).filter("own <> component").select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()
    else:
        first = first.select(F.col("cls").alias("a"), "b")
    near = cut(_near(so_far.untested(first), light, rule), "near")
    so_far.add(_verified(near, docs, label, so_far.sets, rule))
    forget(near)

    left, reach, since = shared, 1, len(so_far.tested)
    while True:
        placed = cut(so_far.placed(left), "placed")
        open_ = placed.groupBy("word").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("cls").alias("size"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("members"))
        # Of words that the same classes share, one will do.
        open_ = written = cut(open_.filter("low < high").groupBy("size", "members", "low", "high").agg(F.min("word").alias("word")).select("word", "size"), "open-words")
        count = open_.count()
        if not count:
            forget(placed, written, left)
            break
        open_ = F.broadcast(open_) if count <= BROADCAST_ROWS else open_
        many = _many(placed, open_, light, so_far.tested[since:], rule, reach)
        pairs = so_far.untested(_few(placed, open_).unionByName(many.filter("a is not null").select("a", "b")).distinct())
        near = cut(_near(pairs, light, rule), "near")
        so_far.add(_verified(near, docs, label, so_far.sets, rule))
        # Only groups with near pairs that are still untested come again.
        again = many.filter("word is not null").select("word").distinct()
        done, before, reach = again.isEmpty(), left, reach * 8
        if not done:
            left = cut(left.join(again, "word", "left_semi"), "left-words")
        forget(placed, written, many, near, before)
        if done:
            break


def _labelled(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_hash, n (size of the set), component (one of its classes) for each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    sketched = cut(_sketched(docs, rule), "sketches")
    label = cut(sketched.select("doc_id", "text_hash", "n", "cls"), "labels")
    frequent = cut(shared_words(_words(sketched)), "shared-words")
    # Without enough words of blocks with a shingle, those of the others count too.
    sent = lambda s: F.when(_held(s["words"]) < s["need"], F.size(s["words"])).otherwise(_held(s["words"]))
    spare = F.transform("sketches", lambda s: F.struct(s["band"].alias("band"), (sent(s) - s["need"]).alias("spare")))
    light = sketched.filter(F.size("sketches") > 0).select("cls", "n", spare.alias("bands"), F.map_from_arrays("sketches.band", "sketches.bits").alias("bits"))
    light = cut(light.join(frequent.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "light-sketches")
    shared = cut(_needed(frequent, light), "rare-words")
    forget(sketched, frequent)
    linked = Linked()
    connect(shared, light, label, docs, rule, linked)
    forget(light)
    linked.forget()
    return label.join(linked.parts.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "text_hash", "n", F.coalesce("component", "cls").alias("component"))


def jaccard_components(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for each row of ``docs``."""
    return named_components(_labelled(docs, rule))


def named_components(label: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the component's smallest doc_id) from rows labelled with a component."""
    smallest = label.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    # A component may hold a third of all rows: adaptive execution splits the larger side.
    out = label.join(smallest.hint("merge"), "component", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_components(docs: DataFrame) -> DataFrame:
    """op6: three-word shingles, links at 90 of 100."""
    return jaccard_components(docs, Rule(words=3, num=90, den=100)).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, rule: Rule | None = None, labelled=_labelled) -> DataFrame:
    """One row of ``docs`` for each group, and every row without words; five words and 0.8 unless ``rule`` says otherwise.

    The row with the smallest doc_id stays (a null one only if there is no
    other), of those the one with the smallest hash of its text, of equal texts
    the first by the row's JSON form.
    """
    label = cut(labelled(docs, rule or Rule()), "groups")
    chosen = label.filter("n > 0").groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash")).alias("row")).select("row.doc_id", "row.text_hash")
    rows = label.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_hash").eqNullSafe(F.col("hash"))
    kept = rows.join(chosen.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), same, "left_semi").unionByName(rows.filter("n = 0"))
    kept_id, kept_hash = fresh("kept_id", docs), fresh("kept_hash", docs)
    kept = cut(kept.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash), (F.col("rows") > 1).alias("several"), "n"), "kept-rows")
    those = lambda which: docs.join(kept.filter(which).drop("several", "n"), docs["doc_id"].eqNullSafe(F.col(kept_id)) & (F.xxhash64(docs["text"]) == F.col(kept_hash)), "left_semi")
    out, repeated = those("not several or n = 0"), "several and n > 0"
    if kept.filter(repeated).isEmpty():
        return out
    place = fresh("place", docs)
    first = Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*[docs[c] for c in docs.columns])))
    return out.unionByName(those(repeated).withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(place))
