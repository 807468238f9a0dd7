"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in tasks. The trees are fitted on a
bounded sample of labelled rows (``sample_rows``, the first by a hash of
doc_id) and flattened into arrays: every tree is a complete binary tree, so a
batch of documents walks all trees at once with numpy indexing.

Defined cases: a null text counts as empty and gets the score of an empty
text. Each row is scored by itself, so repeated rows and null ids pass through.
Labels that are null, other than 0 or 1, or that contradict one another for a
doc_id are not learnt from; of rows that repeat a labelled doc_id the smallest
text is. With no usable labels every score is 0.5. Labels, lang, source and
doc_id are never inputs of a score. Other columns pass through unchanged;
columns named like a result column give way to it. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import only, with_found

SAMPLE_ROWS = 20_000
FEATURES = (
    "chars", "words", "word_length", "longest_word", "short_words", "distinct_words", "top_word", "distinct_pairs", "lines", "line_length", "distinct_lines",
    "upper", "lower", "digits", "blanks", "beyond_ascii", "stops_commas", "exclamations", "bars", "marks", "quotes_brackets", "breaks", "shouting_words", "marked_words",
)


def statistics(text: str | None) -> tuple[float, ...]:
    """The numbers that FEATURES names, for one whole text."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    seen, size = np.bincount(data, minlength=256), max(len(data), 1)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    of = lambda signs: float(seen[list(signs)].sum()) / size
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    return (
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.sum()) / n, float(lengths.max(initial=0)), float((lengths <= 3).sum()) / n,
        len(set(words)) / n, Counter(words).most_common(1)[0][1] / n if words else 0.0, len(set(zip(words, words[1:]))) / n,
        np.log1p(len(lines)), np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines),
        float(seen[65:91].sum()) / size, float(seen[97:123].sum()) / size, float(seen[48:58].sum()) / size, of(b" \t"), float(seen[128:].sum()) / size,
        of(b".,;:?"), of(b"!"), of(b"|"), of(b"#$%&*@^~_=+<>/\\"), of(b"\"'()[]{}"), of(b"\n"),
        sum(map(str.isupper, words)) / n, sum(not w[-1].isalnum() for w in words) / n,
    )


@dataclass
class Trees:
    """Complete trees of one depth: node k of tree t asks column[t, k] > limit[t, k]."""

    base: float
    column: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.leaf):
            return out
        trees, depth = np.arange(len(self.leaf)), int(np.log2(self.leaf.shape[1]))
        for at in range(0, len(x), 2000):
            part = x[at : at + 2000]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(trees)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[rows, self.column[trees, node]] > self.limit[trees, node])
            out[at : at + 2000] += self.leaf[trees, node - (2**depth - 1)].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boost log-loss with second-order histogram splits."""
    nodes = 2**depth - 1
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return Trees(float(np.log((mean + 0.01) / (1.01 - mean))), np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = y.mean()
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), base)
    columns, limits, leaves = np.zeros((rounds, nodes), int), np.full((rounds, nodes), np.inf), np.zeros((rounds, nodes + 1))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best, column, cut_at = np.zeros(width), np.zeros(width, int), np.full(width, bins)
            for j in range(x.shape[1]):
                key = local * bins + binned[:, j]
                sums = [np.bincount(key, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (ga, ha, na) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(nl < least) | (na - nl < least)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-9
                best, column, cut_at = np.where(better, top, best), np.where(better, j, column), np.where(better, at, cut_at)
            for k in range(width):
                if best[k] > 0:
                    columns[t, first + k], limits[t, first + k] = column[k], edges[column[k]][cut_at[k]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), column[local]] > cut_at[local])
        leaf = node - nodes
        value = -rate * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + ridge)
        leaves[t] = value
        margin += value[leaf]
    return Trees(base, columns, limits, leaves)


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``sample_rows`` labelled rows that are not held out."""
    usable = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("top"))
        .filter("y = top").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # The broadcast side has at most sample_rows rows of two numbers.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("y").cast("int").alias("y"), F.min("text").alias("text"))
    found = with_found(rows, ["y"], lambda: lambda texts: _matrix(texts).T, {f: "double" for f in FEATURES}).toPandas()
    found = found.sort_values([*FEATURES, "y"], kind="stable")
    return fit(found[list(FEATURES)].to_numpy(), found["y"].to_numpy().astype(float))


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; its other columns pass through."""

    def find(texts):
        score = trees.score(_matrix(texts))
        return score, (score >= 0.5).astype(np.int32)

    return with_found(docs, [c for c in docs.columns if c.lower() not in ("score", "predicted")], lambda: find, {"score": "double", "predicted": "int"})


def keep_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more."""
    return only(docs, lambda: lambda texts: trees.score(_matrix(texts)) >= 0.5)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op2: doc_id, held_out, score, predicted for each row of ``docs``."""
    trees = learn(docs, labels)
    out = score_quality(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
