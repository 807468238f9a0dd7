"""Extraction by a dictionary and article analysis against plain Python."""

import random
import re

import duckdb

from quillgraph.functions import cues as C
from quillgraph.functions.text import EVENT_PATTERNS
from quillgraph.operators import extraction as E
from quillgraph.plans import ORACLES, QUERIES

SCHEMA = "symbol string, tier string, company string, industry string, aliases array<string>"
ENTRIES = [
    ("HPG", "curated", "Hòa Phát", "Thép", ["hòa phát"]), ("VNM", "curated", "Vinamilk", "Đồ uống", ["vinamilk", "sữa việt nam"]), ("HCM", "curated", "Chứng khoán HCM", "Chứng khoán", []),
    ("TIN", "expanded", "Tin Co", "Công nghệ", []), ("HAI", "expanded", None, "", ["x"]), ("A1", "expanded", "A Một", "Khác", ["ab"]),
]


def _plain_symbols(text):
    found = set()
    for symbol, tier, _, _, aliases in ENTRIES:
        for m in re.finditer(rf"\b{re.escape(symbol)}\b", text, re.IGNORECASE):
            near = text[max(0, m.start() - C.BEFORE) : m.start()].lower()
            if any(f in near for f in C.FALSE_FRIENDS.get(symbol, ())) and not any(c in near for c in C.STOCK_CONTEXT):
                continue
            if tier == "expanded" and not any(c in text[max(0, m.start() - C.REACH) : m.end() + C.REACH].lower() for c in C.STOCK_CONTEXT):
                continue
            found.add(symbol)
        if any(a in text.lower() for a in aliases):
            found.add(symbol)
    return sorted(found)


def _texts(count=250):
    chance = random.Random(6)
    bits = ["HPG", "hpg", "xHPG", "VNM", "TP. HCM", "tp.hcm", "HCM", "chứng khoán TP.HCM", "tin", "TIN", "cổ phiếu ", "hai", "HAI", "mã ", "Hòa Phát", "SỮA VIỆT NAM", "vinamilks", "a1", "ab", "x", ".", ",", "\n", " ", " ", "từ " * 9, "dài " * 12, "HPG_", "VNM-HPG"]
    return ["", *("".join(chance.choice(bits) + chance.choice(["", " ", " "]) for _ in range(chance.randrange(1, 14))) for _ in range(count))]


def test_symbols(spark):
    texts = _texts()
    docs = spark.createDataFrame([*enumerate(texts), (9999, None)], "id long, text string")
    dictionary = E.with_friends(spark.createDataFrame(ENTRIES, SCHEMA))
    got: dict = {}
    for r in E.symbols_of(docs, "id", "text", dictionary).collect():
        got.setdefault(r["id"], []).append(r["symbol"])
    for k, text in enumerate(texts):
        assert sorted(got.get(k, [])) == _plain_symbols(text), text
    assert 9999 not in got and len(got) > 100


def test_thousands_of_aliases_make_no_longer_plan(spark):
    docs = spark.createDataFrame([(1, "the name nr 1234x of many, nr 77 too")], "id long, text string")
    plans = []
    for n in (10, 3000):
        entries = spark.createDataFrame([(f"S{k}", "curated", "", "", [f"nr {k}", f"other {k}"]) for k in range(n)], SCHEMA)
        found = E.symbols_of(docs, "id", "text", E.with_friends(entries))
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        rows = sorted(r["symbol"] for r in found.collect())
    assert plans[0] == plans[1] and rows == sorted(["S1", "S12", "S123", "S1234", "S7", "S77"])


def test_pieces_that_no_key_shares_are_left_out(spark, monkeypatch):
    """Of a text only pieces leave that an alias begins with; a dictionary too large for that finds the same symbols."""
    dictionary = E.with_friends(spark.createDataFrame(ENTRIES, SCHEMA))
    texts = [*_texts(120), "no alias begins like this, nor thiz: 𝔘𝔫𝔦 code"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    keys = E._keys(dictionary)
    left, all_ = (docs.select("id", E.F.explode(E._pieces(E.F.lower("text"), k)).alias("key")) for k in (keys, None))
    assert left.count() < all_.count() / 3
    assert sorted(map(tuple, left.join(keys, "key").select("id", "key").collect())) == sorted(map(tuple, all_.join(keys, "key").select("id", "key").collect()))
    few = sorted(map(tuple, E.symbols_of(docs, "id", "text", dictionary).collect()))
    monkeypatch.setattr(E, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, E.symbols_of(docs, "id", "text", dictionary).collect())) == few and len(few) > 50


def _plain_analysis(title, content):
    text = f"{title} {content or ''}"
    low, entries = text.lower(), {e[0]: e for e in ENTRIES}
    stocks = _plain_symbols(text)
    companies = [entries[s][2] for s in stocks if entries[s][2]]
    industries = []
    for s in stocks:
        if entries[s][3] and entries[s][3] not in industries:
            industries.append(entries[s][3])
    evidence = {n: [w for w in words if w in low] for n, words in C.INDUSTRIES.items()}
    industries += [n for n, h in evidence.items() if h and n not in industries]
    events = {n: h for n, words in EVENT_PATTERNS.items() if (h := [w for w in words if w in low])}
    good, bad = [w for w in C.POSITIVE if w in low], [w for w in C.NEGATIVE if w in low]
    moves = [(m[1], float(m[2].replace(",", "."))) for m in re.finditer(r"(tăng|giảm)[^%\n]{0,20}?(\d{1,3}(?:[.,]\d+)?)\s*%", low)]
    n, label, score = len(good) + len(bad), "Neutral", 50.0
    if n and (ratio := len(good) / n) is not None and not 0.4 < ratio < 0.6:
        label = "Positive" if ratio >= 0.6 else "Negative"
        own = [p for way, p in moves if (way == "tăng") == (label == "Positive")]
        boost = min(sum(own) / len(own), 40) / 40 * 20 if own else 0
        score = round(max(5.0, min(50 + (ratio - 0.5) * 100 * min(n, 5) / 5 + (boost if label == "Positive" else -boost), 95.0)), 2)
    quote = lambda words, most: ", ".join(f"'{w}'" for w in words[:most])
    reasons = [C.SAYS["moves"].format(q=", ".join(f"{w} {p:g}%" for w, p in moves[:5]))] if moves else []
    reasons += [C.SAYS[side].format(n=len(words), q=quote(words, 5)) for side, words in (("positive", good), ("negative", bad)) if words]
    reasons += [] if n else [C.SAYS["neither"]]
    reasons += [C.SAYS["event"].format(name=C.EVENT_LABELS[k], q=quote(h, 3)) for k, h in events.items()]
    reasons += [C.SAYS["companies"].format(q=", ".join(companies[:5]))] if companies else []
    reasons += [C.SAYS["industry_cue"].format(name=i, q=quote(evidence[i], 3)) if evidence.get(i) else C.SAYS["industry_symbol"].format(name=i) for i in industries]
    return stocks, companies, industries, list(events), label, score, [*reasons, C.SAYS[label]]


def test_analysis_and_decision(spark):
    chance = random.Random(11)
    bits = [*C.POSITIVE[:12], *C.NEGATIVE[:8], "lợi nhuận tăng 33%", "giảm mạnh 15,50 %", "tăng 7.0%", "HPG", "cổ phiếu TIN", "Vinamilk", "ngân hàng", "giá thép", "sáp nhập", "bổ nhiệm", "trúng thầu", "thường", "một từ", "\n"]
    rows = [(k, " ".join(chance.choice(bits) for _ in range(chance.randrange(0, 4))), " ".join(chance.choice(bits) for _ in range(chance.randrange(0, 12))) if k % 9 else None) for k in range(120)]
    rows += [(500, "", None), (501, "CP HPG tăng " + "x" * 10 + " 12,345678%", "Lãi kỷ lục")]
    result = "result struct<status: string, trend: string, confidence: double, decision: string>"
    given = [None, ("SCORED", "INCREASING", 0.7, "SIGNAL"), ("SCORED", "DECREASING", 0.3, "ABSTAIN"), ("REFUSED", "INCREASING", 0.9, None)]
    articles = spark.createDataFrame([(*r, given[r[0] % 4]) for r in rows], f"id long, title string, content string, {result}")
    analysed = E.analysed(articles, "id", E.with_friends(spark.createDataFrame(ENTRIES, SCHEMA)))
    found = {r["id"]: r for r in E.decided(analysed).collect()}
    assert len(found) == len(rows)
    for k, title, content in rows:
        r = found[k]
        assert (r["stocks"], r["companies"], r["industries"], r["events"], r["sentiment"], r["impact_score"], r["reasons"]) == _plain_analysis(title, content), (title, content)
        stored = (r["predicted_trend"], r["prediction_confidence"], r["prediction_decision"], r["needs_manual_label"], r["fallback_trend"] is not None)
        assert stored == [(None, None, "ERROR", True, True), ("INCREASING", 0.7, "SIGNAL", False, False), ("DECREASING", 0.3, "ABSTAIN", True, False), (None, None, "REFUSED", True, True)][k % 4]
    assert {r["sentiment"] for r in found.values()} == {"Positive", "Negative", "Neutral"}


def test_article_analysis_on_moves_is_as_its_sql(spark, tmp_path):
    """Percentages behind a word that ends in up or down move no score: the SQL has none."""
    texts = ["mention soup +1 (136) 555-7479%%% the", "the ough down 12 % and the", "elle up 3,5% ough", "nothing up 9%", None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("supplier", "nation", "region", "orders", "lineitem", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(ORACLES["article_analysis"])
    found = QUERIES["article_analysis"](spark, str(tmp_path)).select(*want.columns)
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert shown(found.collect()) == shown(want.fetchall())
