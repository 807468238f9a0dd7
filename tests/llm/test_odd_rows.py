"""Every operator and stage on odd rows: large ids beside null ones, repeated rows, clashing columns, long and empty texts, empty tables."""

import datetime as dt
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import byte_bpe, common, decontaminate, licenses, line_dedup, nearest, ngram_join, quality, secrets, token_counts, toxicity

BIG = 9007199254740993
LEAK = "a benchmark item that is long enough to be found in any text whatever its case"
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
CLASH = ("gone", "gone_id", "gone_hash", "kept_id", "kept_hash", "leak_id", "score", "predicted", "n_lines", "place", "item")


@pytest.fixture(scope="module")
def docs(spark):
    chance = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    long = " ".join(chance.choice(words) for _ in range(60_000))
    texts = ["Released under the MIT License.", "", None, long, f"x {LEAK.upper()} y", "one two three four five six seven", 'password = "Zk83jfLq0aPz9"']
    rows = [(i, t, dt.datetime(1500, 1, 1), [1, None], *[k] * len(CLASH)) for i, t in [(BIG, texts[0]), (None, texts[1]), *[(BIG + 1, t) for t in texts[2:]], (7, texts[5]), (7, texts[5]), (None, texts[5])] for k in [5]]
    return spark.createDataFrame(rows, "doc_id long, text string, at timestamp, list array<long>, " + ", ".join(f"{c} long" for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG, 1, 0), (BIG + 1, 0, 1), (7, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, LEAK), (2, None), (3, ""), (3, LEAK)], "item_id long, text string")


def _whole(docs, labels, benchmark):
    return {
        "op1": toxicity.score_toxicity(docs, toxicity.learn(docs, labels)),
        "op2": quality.quality_scores(docs, labels),
        "op3": token_counts.count_tokens(docs, WORDS),
        "op5": line_dedup.line_dedup_digest(docs),
        "op6": ngram_join.ngram_components(docs),
        "op8": secrets.scan_secrets(docs),
        "op9": byte_bpe.round_trip_digest(docs, RANKS, P.PATTERN),
        "encode": byte_bpe.encode(docs, RANKS, P.PATTERN),
        "dedup_lines": line_dedup.dedup_lines(docs),
        "score_quality": quality.score_quality(docs, quality.learn(docs, labels)),
    }


def test_every_row_keeps_its_id(docs, labels, benchmark):
    want = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    for name, df in _whole(docs, labels, benchmark).items():
        assert sorted(str(r.doc_id) for r in df.select("doc_id").collect()) == want, name
    leaks = decontaminate.find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in leaks} == {(BIG + 1, 1, 0), (BIG + 1, 3, 0)}
    assert {(r.doc_id, r.template) for r in licenses.scan_licenses(docs).collect()} == {(BIG, "MIT-notice")}


def test_other_columns_stay_as_they_are(docs, labels):
    for df in (byte_bpe.encode(docs, RANKS, P.PATTERN), line_dedup.dedup_lines(docs), quality.score_quality(docs, quality.learn(docs, labels))):
        assert df.count() == docs.count() and df.select("doc_id", "at", "list", "place").exceptAll(docs.select("doc_id", "at", "list", "place")).count() == 0


def test_empty_tables(docs, labels, benchmark):
    for name, df in _whole(docs.limit(0), labels, benchmark).items():
        assert df.count() == 0, name
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, benchmark.limit(0)).count() == docs.count()
    assert licenses.scan_licenses(docs.limit(0)).count() == ngram_join.keep_one(docs.limit(0)).count() == 0


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert rows.count((7, "one two three four five six seven")) == 1 and sum("two three" in (t or "") for _, t in rows) == 1
    assert {t for _, t in rows} == {r.text for r in docs.collect()}


def test_benchmark_in_blocks(spark, docs, benchmark):
    more = benchmark.unionByName(spark.createDataFrame([(9, "quite another item of the benchmark that stands nowhere")], benchmark.schema))
    one, many = (sorted(map(tuple, decontaminate.find_leaks(docs, more, block_chars=n).collect())) for n in (10**6, 10))
    assert one == many and len(one) == 2
    assert decontaminate.without_leaks(docs, more, block_chars=10).count() == docs.count() - 1


def test_pipeline_against_plain_python(spark, tmp_path):
    """The whole chain on a small corpus, each stage in plain Python (of the classifier, its own scores)."""
    chance = random.Random(9)
    words = [f"word{k}" for k in range(500)]
    said = lambda n: " ".join(chance.choice(words) for _ in range(n))
    shared = "this very line stands in many of the documents"
    rows = []
    for k in range(60):
        good = k % 3 > 0
        text = said(80) + "\n" + shared if good else "$$$ !!! ### " * 40 + str(k)
        rows.append((k, text, "en", "web", len(text)))
        if good and k % 5 == 0:
            rows.append((1000 + k, text.replace("word1", "word2", 1), "en", "web", len(text)))
    rows.append((500, said(60) + " " + LEAK, "en", "web", 5))
    rows += [(None, said(70), "en", "web", 5), (BIG, said(70), "en", "web", 5)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"file://{folder}").collect()

    docs, labels = common.read(spark, f"file://{folder}", "documents"), common.read(spark, f"file://{folder}", "labels")
    trees = quality.learn(docs, labels)
    kept = [r for r in rows if trees.score(np.array([quality.statistics(r[1])]))[0] >= 0.5]
    assert {r[0] for r in kept} >= {r[0] for r in rows if r[0] is not None and r[0] < 60 and r[0] % 3}
    holders = [r[0] for r in kept if shared in r[1]]
    lines = {}
    for r in kept:
        for key in {x.strip().lower() for x in r[1].split("\n") if len(x.strip()) >= 20}:
            lines.setdefault(key, []).append(-1 if r[0] is None else r[0])
    gone = {k: max(v) for k, v in lines.items() if len(set(v)) >= 3}
    assert set(gone) >= {shared} and len(holders) > 3
    kept = [(r[0], "\n".join(x for x in r[1].split("\n") if gone.get(x.strip().lower(), r[0]) == r[0]), *r[2:]) for r in kept]

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(r[1]) for r in kept]
    group = list(range(len(kept)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for r, g in zip(kept, group):
        if g not in first or (r[0] is None, r[0] or 0) < (first[g][0] is None, first[g][0] or 0):
            first[g] = r
    kept = [r for r in first.values() if LEAK not in r[1]]
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in found) == sorted((str(r[0]), r[1], len(r[1])) for r in kept)
    codec = byte_bpe.ByteBpe(open(RANKS, "rb").read(), P.PATTERN)
    assert all(codec.decode_bytes(r.ids).decode() == r.text and r.n_tokens == len(r.ids) for r in found)


def test_trees_against_a_plain_walk_and_held_out_labels(spark):
    chance = np.random.default_rng(5)
    x = chance.normal(size=(400, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x[:300], y[:300], rounds=30)

    def plain(row):
        total = trees.base
        for t in range(len(trees.leaf)):
            node = 0
            while node < trees.column.shape[1]:
                node = 2 * node + 1 + int(row[trees.column[t, node]] > trees.limit[t, node])
            total += trees.leaf[t, node - trees.column.shape[1]]
        return total

    assert np.allclose(trees.margin(x), [plain(r) for r in x]) and ((trees.score(x[300:]) >= 0.5) == y[300:]).mean() > 0.9
    rows = [(k, ("good text of words " if k % 2 else "### $$$ !!! ") * (5 + k % 7)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    made = lambda flip: spark.createDataFrame([(k, (k % 2) ^ (flip and k in held)) for k, _ in rows], "doc_id long, quality int")
    one, other = (sorted(map(tuple, quality.quality_scores(docs, made(f)).collect())) for f in (False, True))
    assert one == other and {r[0] for r in one if r[1]} == held
    assert np.mean([r[3] == r[0] % 2 for r in one if r[1]]) > 0.9


def test_toxicity_learns_its_words_and_folds_by_text(spark):
    chance = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(400):
        bad = k % 4 == 0
        text = [chance.choice(words) for _ in range(30)] + ([chance.choice(("zurk", "blarg", "vexa", "quombing", "quombed"))] * 2 if bad else [])
        chance.shuffle(text)
        rows.append((k, " ".join(text), int(bad)))
    learnt, rest = rows[:300], rows[300:]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    chain = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in learnt], "doc_id long, toxic int"))
    found = {r.doc_id for r in toxicity.score_toxicity(docs, chain).filter("toxic").collect()}
    bad = {r[0] for r in rest if r[2]}
    assert len(found & bad) >= 0.9 * len(bad) and len(found & {r[0] for r in rest if not r[2]}) <= 3
    p = [chain.probabilities([t])[0] for t in ("w1 quombish w2", None, "")]
    assert p[0][-1] > 0.5 > p[1][-1] and np.allclose(p[1], p[2])


def test_secrets_without_bounds():
    literals = lambda t: [t[a:b] for a, k, b in secrets.scan(t)[4] if k == 3]
    many = " + ".join(f'"Ab{k:02d}xYz"' for k in range(80))
    assert len(literals(f"x = {many}\npassword = x")) == 80
    assert literals("password_" + "a" * 5000 + ' = "Zk83jfLq0aPz9"') == ["Zk83jfLq0aPz9"]
    assert literals('secret = ("Zk83jfLq"\n   "0aPz9xx")  # c') == literals('secret = "Zk83jfLq" + # c\n  "0aPz9xx"') == ["Zk83jfLq", "0aPz9xx"]
    assert literals("key:\n  private_key: |\n    Zk83jfLq0aPz9\n    Qk83jfLq0aPz9\n  other: 1") == ["Zk83jfLq0aPz9", "Qk83jfLq0aPz9"]
    assert literals('cfg["password"] = """Zk83jfLq0aPz9"""') == literals('password: str = "Zk83jfLq0aPz9"') == ["Zk83jfLq0aPz9"]
    assert literals('password = "changeme"') == literals('password = "') == literals('note = "Zk83jfLq0aPz9"') == []


def test_nearest_with_ties_copies_and_far_queries(spark):
    chance = np.random.default_rng(8)
    near = chance.normal(size=(40, 16))[chance.integers(0, 40, 3000)] + 0.1 * chance.normal(size=(3000, 16))
    v = np.vstack([near, 3 * chance.normal(size=(1000, 16)), np.tile(near[:1], (50, 1))])
    rows = [(BIG + k if k % 20 else k, x.tolist()) for k, x in enumerate(v)]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < BIG, top=10).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    recall = []
    for k in np.flatnonzero(ids < BIG):
        score = np.zeros(len(v))
        for d in range(v.shape[1]):
            score += v[k, d] * v[:, d]
        score[k] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:10]].tolist())
        got = sorted(found[int(ids[k])])
        assert [g[0] for g in got] == list(range(1, 11)) and got == sorted(got, key=lambda g: (-g[2], g[1]))
        assert all(s == score[ids == i][0] for _, i, s in got)
        recall.append(len(best & {g[1] for g in got}) / 10)
    assert np.mean(recall) >= 0.9
