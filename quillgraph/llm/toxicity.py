"""Toxicity by a classifier chain.

Categories are predicted in a fixed order. Each has a linear (logistic) model
over the words and word beginnings present in a text and over the probabilities
of the categories before it. In training those earlier probabilities are out of
fold, so a model never sees how well the model before it remembers its own
rows. Folds go by the text, so that its copies are in one fold.

The labels name only ``toxic``. Finer categories are learnt from them: the
strings that mark toxic rows most are grouped by the rows in which they occur
together, and a category is the toxic rows that hold a string of its group. So
the chain learns kinds of toxic text before it decides on the whole.

Defined cases: a null text counts as empty. Each row is scored by itself, so
repeated rows and null ids pass through. Labels that are null, other than 0 or
1, or contradictory for a doc_id are not learnt from; of rows that repeat a
labelled doc_id the smallest text is; with no usable labels, nothing is
flagged. Other columns do not enter. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import with_found

#: The most labelled rows to learn from, and the most strings with weights.
SAMPLE_ROWS, VOCABULARY = 12_000, 1024
#: Standard errors by which a string's share of toxic rows must differ from the whole's to get a weight.
APART = 4.0
#: A string whose rows are toxic in so large a share marks a kind; so many of the strongest; so many kinds.
MARKS, STRONGEST, KINDS = 0.8, 200, 3
FOLDS = 3
#: Lengths of the word beginnings that count as strings.
BEGINNINGS = (3, 5)
CHAIN = (*[f"kind{k + 1}" for k in range(KINDS)], "toxic")
_GAP = regex.compile(r"[^\p{L}\p{N}]+")


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words, and the beginnings of longer ones, marked by a dash."""
    words = set(_GAP.sub(" ", (text or "").lower()).split())
    return words.union(*[{w[:k] + "-" for w in words if len(w) > k} for k in BEGINNINGS])


class Linear:
    """Logistic regression on sparse binary columns and a few dense ones."""

    def __init__(self, ridge: float = 2e-3, steps: int = 250, rate: float = 0.3):
        self.ridge, self.steps, self.rate = ridge, steps, rate

    def fit(self, rows: np.ndarray, cols: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray) -> Linear:
        n, k = len(y), width + dense.shape[1] + 1
        x = np.hstack([dense, np.ones((n, 1))])
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
        w, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
        for step in range(1, self.steps + 1):
            z = np.bincount(rows, w[cols], n) + x @ w[width:]
            e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            g = np.concatenate([np.bincount(cols, e[rows], width), e @ x]) + self.ridge * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / np.sqrt(step)
        self.w, self.width = w, width
        return self

    def probability(self, rows, cols, n: int, dense: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, self.w[cols], n) + dense @ self.w[self.width : -1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """A fitted chain: word numbers, a Linear for each category, and the limit for a flag."""

    def __init__(self, words: list[str], models: list[Linear], limit: float):
        self.number, self.models, self.limit = {w: k for k, w in enumerate(words)}, models, limit
        self.known = frozenset(words)

    def probabilities(self, texts) -> np.ndarray:
        rows, cols = [], []
        for r, text in enumerate(texts):
            found = self.known & words_of(text)
            rows += [r] * len(found)
            cols += map(self.number.__getitem__, found)
        rows, cols, n = np.array(rows, np.int64), np.array(cols, np.int64), len(texts)
        out = np.zeros((n, len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = model.probability(rows, cols, n, out[:, :k])
        return out


def fit_chain(words: list[str], rows: np.ndarray, cols: np.ndarray, targets: np.ndarray, fold: np.ndarray) -> Chain:
    """``targets`` has a column for each category, in chain order; ``fold`` a number for each row."""
    n, width = len(targets), len(words)
    inside, models = np.zeros((n, 0)), []
    for k in range(targets.shape[1]):
        y, out_of_fold = targets[:, k].astype(float), np.zeros(n)
        for f in np.unique(fold):
            learn, rest = fold != f, fold == f
            renumber = np.cumsum(learn) - 1
            keep = learn[rows]
            model = Linear().fit(renumber[rows[keep]], cols[keep], width, inside[learn], y[learn])
            out_of_fold[rest] = model.probability(rows, cols, n, inside)[rest]
        models.append(Linear().fit(rows, cols, width, inside, y))
        inside = np.column_stack([inside, out_of_fold])
    last, y = inside[:, -1], targets[:, -1] > 0
    limits = np.linspace(0.1, 0.9, 33)
    f1 = [2 * (y & (last >= t)).sum() / max(y.sum() + (last >= t).sum(), 1) for t in limits]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
    return Chain(words, models, float(limits[best[len(best) // 2]]))


def kinds_of(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, kinds: int = KINDS) -> np.ndarray:
    """[rows, kinds]: which toxic rows hold a string of each group; the groups are k-means of the strings' rows."""
    held = np.bincount(cols, minlength=width)
    bad = np.bincount(cols, y[rows], width)
    marks = np.flatnonzero((bad >= MARKS * held) & (held >= 2))
    marks = marks[np.argsort(-bad[marks], kind="stable")][:STRONGEST]
    out = np.zeros((len(y), kinds), bool)
    if not len(marks):
        return out
    number = np.full(width, -1)
    number[marks] = np.arange(len(marks))
    inside = (number[cols] >= 0) & (y[rows] > 0)
    x = np.zeros((len(marks), len(y)))
    x[number[cols[inside]], rows[inside]] = 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[:1]
    while len(centre) < min(kinds, len(marks)):  # each next centre is the string least like those before
        centre = np.vstack([centre, x[(x @ centre.T).max(axis=1).argmin()]])
    for _ in range(20):
        group = (x @ centre.T).argmax(axis=1)
        sums = np.stack([x[group == k].sum(axis=0) for k in range(len(centre))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 0, sums / np.maximum(size, 1e-12), centre)
    out[rows[inside], group[number[cols[inside]]]] = True
    return out


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain | None:
    """Fit a chain on at most ``sample_rows`` labelled documents; None without both classes."""
    usable = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("top"))
        .filter("y = top").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # The broadcast side has at most sample_rows rows of two numbers.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("y").cast("int").alias("y"), F.min("text").alias("text"))
    rows = rows.withColumn("fold", F.crc32(F.col("text").cast("binary")) % FOLDS)
    sample = with_found(rows, ["doc_id", "y", "fold"], lambda: lambda texts: [["\n".join(sorted(words_of(t))) for t in texts]], {"words": "string"})
    sample = sample.select("doc_id", "y", "fold", F.split("words", "\n").alias("words")).persist()
    count = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("y").alias("n"), F.sum("y").alias("bad"))
    totals = sample.agg(F.count("y").alias("n"), F.sum("y").alias("bad")).first()
    if not totals["n"] or not totals["bad"] or totals["bad"] == totals["n"]:
        sample.unpersist()
        return None
    share = totals["bad"] / totals["n"]
    apart = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    words = [r["word"] for r in count.filter((apart >= APART) & (F.col("word") != "")).orderBy(apart.desc(), "word").limit(VOCABULARY).collect()]
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    found = sample.select("doc_id", "y", "fold", F.array_intersect("words", known).alias("words")).orderBy("doc_id").collect()
    sample.unpersist()
    number = {w: k for k, w in enumerate(words)}
    row = np.repeat(np.arange(len(found)), [len(r["words"]) for r in found])
    col = np.array([number[w] for r in found for w in r["words"]], np.int64)
    y, fold = np.array([r["y"] for r in found]), np.array([r["fold"] for r in found])
    targets = np.column_stack([kinds_of(row, col, y, len(words)), y > 0])
    return fit_chain(words, row, col, targets, fold)


def score_toxicity(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, a probability for each category, and ``toxic`` for each row of ``docs``."""

    def find(texts):
        p = chain.probabilities(texts) if chain else np.zeros((len(texts), len(CHAIN)))
        return [*p.T, p[:, -1] >= chain.limit if chain else np.zeros(len(texts), bool)]

    return with_found(docs, ["doc_id"], lambda: find, {**{f"p_{c}": "double" for c in CHAIN}, "toxic": "boolean"})


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op1: the documents flagged as toxic, with the chain's probabilities."""
    return score_toxicity(docs, learn(docs, labels)).filter("toxic")
