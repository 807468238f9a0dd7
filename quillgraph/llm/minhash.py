"""Near-duplicate classes by MinHash with tensored banding.

A band of a table would take ``2 * per_key`` minhashes of its own; here a
document computes two small collections of ``groups`` keys, each of ``per_key``
minhashes, and a table's key is a pair of one key from either: ``groups`` **2
tables from 2 * groups * per_key minhashes (256 tables of four from 64 instead
of 1,024). Two documents of similarity s meet in some table unless all keys of
one collection differ: at s = 0.8 with 16 groups of two, one link in six
million.

Most documents share nothing, so keys are paired late: only a key that several
classes hold can be part of a table key that several hold. The tables (i, i)
come first and find nearly all links. Then only keys whose holders are still in
different components are paired in all other ways. Documents that meet in a
table are candidates; the search of ngram_join.py for links within a group
(leader first, then what still spans components, by parity sketches whose
distance bounds the sets' from below) chooses which pairs to verify, and all of
these are verified on the full sets. No group is expanded into all pairs.

Defined cases: a null text, or one without words, has the empty set and no
links; one with fewer words than a shingle has its whole sequence as its set.
Whole texts are hashed, however long. Each row is a document of its own, so
rows that repeat a doc_id are linked only by their texts. A null doc_id is
never the smallest unless it is alone. Other columns do not enter. An empty
table gives an empty table. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, forget, no_resident
from quillgraph.llm.ngram_join import Linked, Rule, _lists, _mix, _offsets, connect, keep_one, named_components, shared_words, shingles, sketch

#: Rows of an Arrow batch that are worked on at once, and shingles that are hashed by all functions at once.
ROWS_AT_ONCE, SHINGLES_AT_ONCE = 500, 4096
#: Bands of sizes for this method: few, as a document near a border has keys in two.
WIDE = Rule(words=4, num=80, den=100, ratio=2.5)


@dataclass(frozen=True)
class Tensor:
    """Two collections of ``groups`` keys of ``per_key`` minhashes; their pairs are the tables."""

    groups: int = 16
    per_key: int = 2
    seed: int = 12

    def missed(self, similarity: float) -> float:
        """Chance that a pair of this similarity meets in no table."""
        one = (1 - similarity**self.per_key) ** self.groups
        return 2 * one - one * one


@lru_cache(4)
def _functions(tensor: Tensor) -> tuple[np.ndarray, np.ndarray]:
    chance = np.random.default_rng(tensor.seed)
    count = 2 * tensor.groups * tensor.per_key
    return chance.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), chance.integers(0, 1 << 63, count, dtype=np.uint64)


def minhashes(hashes: np.ndarray, tensor: Tensor) -> np.ndarray:
    """The least value of each function over a set of at least one hash."""
    times, flip = _functions(tensor)
    out = np.full(len(times), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        some = hashes[at : at + SHINGLES_AT_ONCE]
        np.minimum(out, ((some[None, :] ^ flip[:, None]) * times[:, None]).min(axis=1), out=out)
    return out


def collections(hashes: np.ndarray, tensor: Tensor) -> np.ndarray:
    """Keys [2, groups] of both collections; a key tells its collection and place."""
    parts = minhashes(hashes, tensor).reshape(2 * tensor.groups, tensor.per_key)
    out = np.arange(2 * tensor.groups, dtype=np.uint64) + np.uint64(1)
    for column in parts.T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.reshape(2, tensor.groups)


def _signed(docs: DataFrame, rule: Rule, tensor: Tensor) -> DataFrame:
    """A row for each document: its set's size and class, and of a task's first copy of a set the keys and, for each size band, parity bits."""
    ends = rule.ends()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_resident()
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                n, labels, keys, bands = [], [], [], []
                for text in part["text"].to_pylist():
                    h = shingles(text, rule.words)
                    with np.errstate(over="ignore"):
                        label = int((_mix(_mix(h + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(h))) if len(h) else np.uint64(0)).view(np.int64))
                        new = len(h) and label not in seen
                        keys.append(collections(h, tensor).ravel().view(np.int64) if new else np.empty(0, np.int64))
                    n.append(len(h))
                    labels.append(label)
                    own = []
                    if new:
                        home = bisect_left(ends, len(h))
                        for k in [home] + ([home + 1] if len(h) * rule.den >= rule.num * (ends[home] + 1) else []):
                            own.append((k, sketch(h, rule.apart(ends[k], ends[k]) + 1)[1]))
                    bands.append(own)
                    seen.add(label)
                flat = [x for own in bands for x in own]
                made = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.int32()), _lists([b for _, b in flat])], ["band", "bits"])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_hash"], pa.array(n, pa.int64()), pa.array(labels, pa.int64()), _lists(keys), pa.ListArray.from_arrays(_offsets(bands), made)],
                    ["doc_id", "text_hash", "n", "cls", "keys", "bands"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(work, f"doc_id {kind}, text_hash long, n long, cls long, keys array<long>, bands array<struct<band int, bits array<long>>>")


def _table_keys(held: DataFrame, tensor: Tensor, same: bool) -> DataFrame:
    """(word, cls): each class's pairs of held keys (cls, band, place, key), of one place if ``same``, else of two. The word's last byte is the band."""
    pair = F.struct((F.col("place") % tensor.groups).alias("i"), "key")
    sides = held.groupBy("cls", "band").agg(*[F.collect_list(F.when((F.col("place") >= tensor.groups) == side, pair)).alias(c) for c, side in (("first", False), ("second", True))])  # ``groups`` keys at most
    sides = sides.select("cls", "band", F.explode("first").alias("a"), "second").select("cls", "band", "a", F.explode("second").alias("b"))
    fits = F.col("a.i") == F.col("b.i") if same else F.col("a.i") != F.col("b.i")
    word = F.shiftleft(F.xxhash64("a.key", "b.key"), 8).bitwiseAND((1 << 63) - 1).bitwiseOR(F.col("band").cast("long"))
    return sides.filter(fits).select(word.alias("word"), "cls")


def _spanning(words: DataFrame, linked: Linked) -> DataFrame:
    """The rows (word, cls) of the words whose holders are in different components."""
    placed = linked.placed(words)
    spans = placed.groupBy("word").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("word")
    return words.join(spans, "word", "left_semi")


def labelled(docs: DataFrame, rule: Rule = WIDE, tensor: Tensor = Tensor()) -> DataFrame:
    """doc_id, text_hash, n (size of the set), component (one of its classes) for each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    signed = cut(_signed(docs, rule, tensor), "signatures")
    label = cut(signed.select("doc_id", "text_hash", "n", "cls"), "labels")
    each = signed.select("cls", "bands.band", F.posexplode("keys").alias("place", "key")).select("cls", "place", "key", F.explode("band").alias("band"))
    word = F.xxhash64("key", "band").alias("word")
    # One class in two tasks counts twice here: its keys meet no other class and go when table keys are counted.
    several = each.select(word).groupBy("word").agg(F.count("word").alias("all")).filter("all > 1").select("word")
    held = cut(each.select(word, "cls", "band", "place", "key").join(several, "word", "left_semi").distinct(), "shared-keys")
    light = signed.filter(F.size("bands") > 0).select("cls", "n", F.map_from_arrays("bands.band", "bands.bits").alias("bits"))
    light = cut(light.join(held.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "light-sketches")
    forget(signed)
    linked = Linked()
    connect(cut(shared_words(_table_keys(held, tensor, True)).select("word", "cls"), "table-keys"), light, label, docs, rule, linked)
    # Keys whose holders are all linked by now have nothing left to find.
    open_ = linked.placed(held).groupBy("word").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("word")
    apart = cut(held.join(open_, "word", "left_semi"), "open-keys")
    forget(held)
    connect(cut(_spanning(shared_words(_table_keys(apart, tensor, False)).select("word", "cls"), linked), "table-keys"), light, label, docs, rule, linked)
    forget(apart, light)
    linked.forget()
    return label.join(linked.parts.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "text_hash", "n", F.coalesce("component", "cls").alias("component"))


def near_duplicates(docs: DataFrame, rule: Rule = WIDE, tensor: Tensor = Tensor()) -> DataFrame:
    """op12: doc_id, n_shingles, component_id, kept for each row of ``docs``; four words and 0.8 unless ``rule`` says otherwise."""
    found = named_components(labelled(docs, rule, tensor))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, rule: Rule | None = None, tensor: Tensor = Tensor()) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates, chosen as in ``ngram_join.keep_one``, and every row without words; five words and 0.8 unless ``rule`` says otherwise."""
    return keep_one(docs, rule or Rule(ratio=WIDE.ratio), lambda d, r: labelled(d, r, tensor))


def classes_sql(words: int, num: int, den: int, kept: bool) -> str:
    """DuckDB SQL for the classes of documents linked at num/den: all pairs that share a shingle, then reachability."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shingle = f"CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words} + 2), lambda k: array_to_string(w[k : k + {words - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  sets AS MATERIALIZED (SELECT doc_id, list_distinct({shingle}) AS s FROM split),
  classes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(doc_id)) AS c, min(doc_id) AS low, any_value(s) AS s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
  each AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS x FROM classes),
  links AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM each a JOIN each b ON a.x = b.x AND a.c < b.c AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
    GROUP BY a.c, b.c, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
  both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reached AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a),
  smallest AS (SELECT r.a AS c, min(k.low) AS low FROM reached r JOIN classes k ON k.c = r.b GROUP BY r.a)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(m.low, sets.doc_id) AS component_id{', coalesce(m.low, sets.doc_id) = sets.doc_id AS kept' if kept else ''}
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND classes.s = list_sort(sets.s) LEFT JOIN smallest m ON m.c = classes.c"""


NEAR_DUPLICATES_SQL = classes_sql(4, 80, 100, True)
NGRAM_SQL = classes_sql(3, 90, 100, False)
