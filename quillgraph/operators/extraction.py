"""Symbols, companies, industries and reasons of articles, by a dictionary of any size.

A text gives its distinct words, and of its three-sign pieces and signs those
that some alias begins with, once each; a join with the keys of the dictionary
(a symbol's key is its whole word, an alias's its first three signs, or its
first where it is shorter) leaves the few entries that can occur. Only these are
looked for in the text. So the plan is the same for ten entries and for
thousands, and no entry has a pattern of its own. Keys are numbers: words by
their hash, pieces by their code points; two keys that fall together cost a
look into the text and change no result.

``dictionary``: (symbol, tier, company, industry, aliases, friends), the last
two arrays of text. A symbol stands as a whole word, in any case. Symbols of the
tier "expanded" count only with a word of stock talk within 40 signs; one whose
``friends`` stand in the 24 signs before it does not count there, unless stock
talk stands there too. Aliases count wherever the lower-cased text holds them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.functions.cues import BEFORE, FALSE_FRIENDS, REACH, SAYS, Cues

#: Keys of a dictionary that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_EDGE = r"[\p{L}\p{N}_]"


def with_friends(dictionary: DataFrame, friends: Mapping[str, Sequence[str]] = FALSE_FRIENDS) -> DataFrame:
    """``dictionary`` with the column ``friends``."""
    if not friends:
        return dictionary.withColumn("friends", F.array().cast("array<string>"))
    names = F.create_map(*[x for s, words in friends.items() for x in (F.lit(s), F.array(*map(F.lit, words)))])
    return dictionary.withColumn("friends", F.coalesce(names[F.col("symbol")], F.array().cast("array<string>")))


def _keys(dictionary: DataFrame) -> DataFrame:
    """(key, entry): what can be found by a key."""
    entry = lambda alias: F.struct("symbol", "tier", "friends", alias.alias("alias"))
    symbols = dictionary.select(F.xxhash64(F.lower("symbol")).alias("key"), entry(F.lit(None).cast("string")).alias("entry"))
    named = dictionary.select("symbol", "tier", "friends", F.explode("aliases").alias("_alias")).withColumn("_alias", F.lower("_alias")).filter("_alias <> ''")
    sign = lambda k: F.shiftleft(F.ascii(F.substring("_alias", k, 1)).cast("long"), 63 - 21 * k)
    key = F.when(F.length("_alias") < 3, sign(1)).otherwise(sign(1).bitwiseOR(sign(2)).bitwiseOR(sign(3)))
    return symbols.unionByName(named.select(key.alias("key"), entry(F.col("_alias")).alias("entry"))).distinct()


def _starts(wanted: np.ndarray | None):
    """A function from a text to the codes of its distinct signs and three-sign pieces; with ``wanted``, of those that may be among these, by a table of hashed places."""
    bits = max(16, (16 * len(wanted)).bit_length()) if wanted is not None else 0
    places = lambda codes: (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    if bits:
        table[places(wanted)] = True

    def find(text: str) -> np.ndarray:
        signs = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        first = signs << 42
        codes = np.concatenate([first, first[:-2] | (signs[1:-1] << 21) | signs[2:]])
        return np.unique(codes[table[places(codes)]] if bits else codes)

    return find


def _pieces(low: Column, keys: DataFrame | None) -> Column:
    """The distinct keys that a lower-cased text can meet. With ``keys``, pieces that no key shares are left out at once."""
    find = _starts(keys.select("key").distinct().toArrow()["key"].to_numpy() if keys is not None else None)

    def starts(texts: pa.Array) -> pa.Array:
        return pa.array([find(t.as_py()) for t in texts], pa.list_(pa.int64()))

    words = F.array_distinct(F.regexp_extract_all(low, F.lit(f"{_EDGE}+"), F.lit(0)))
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.arrow_udf(starts, "array<bigint>")(low))


def _word(symbol: Column) -> Column:
    """The pattern of a symbol as a whole word, in any case."""
    return F.concat(F.lit(rf"(?i)(?<!{_EDGE})\Q"), symbol, F.lit(rf"\E(?!{_EDGE})"))


def windows(text: Column, symbol: Column, reach: int = REACH, before: int = BEFORE) -> Column:
    """For each place of the symbol as a whole word, in any case: the lower-cased text about it, and what stands just before."""
    split = F.split(text, _word(symbol), -1)
    joined = lambda some, sign: F.call_function("array_join", some, sign)

    def window(parts: Column, k: Column) -> Column:
        first = F.greatest(k - reach, F.lit(1))
        left = F.right(joined(F.slice(parts, first, k - first + 1), symbol), F.lit(reach))
        right = F.left(joined(F.slice(parts, k + 1, F.lit(reach + 1)), symbol), F.lit(reach))
        return F.struct(F.lower(F.concat(left, symbol, right)).alias("about"), F.lower(F.right(left, F.lit(before))).alias("before"))

    none = F.array().cast("array<struct<about: string, before: string>>")
    return X.bound(split, lambda parts: F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: window(parts, k))).otherwise(none))


def symbols_of(docs: DataFrame, key: str, text: str, dictionary: DataFrame, context: Sequence[str] = Cues.context) -> DataFrame:
    """(key, symbol): each symbol of each row of ``docs``, once."""
    keys = _keys(dictionary)
    few = keys.count() <= BROADCAST_KEYS
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_low", F.lower("_text"))
    pieces = _pieces(F.col("_low"), keys.filter("entry.alias is not null") if few else None)
    met = rows.select("_id", "_text", "_low", F.explode(pieces).alias("key")).join(F.broadcast(keys) if few else keys, "key").select("_id", "_text", "_low", "entry.*")
    has = lambda where, words: F.exists(words, lambda w: F.contains(where, w))
    talk = F.array(*map(F.lit, context))
    friend = lambda w: has(w["before"], F.col("friends")) & ~has(w["before"], talk)
    # Where nothing about a symbol matters, its first place tells.
    free = F.coalesce((F.col("tier") != "expanded") & (F.size("friends") == 0), F.lit(False))
    stands = F.when(free, F.rlike("_text", _word(F.col("symbol")))).otherwise(F.exists(windows(F.col("_text"), F.col("symbol")), lambda w: ~friend(w) & ((F.col("tier") != "expanded") | has(w["about"], talk))))
    found = met.filter(F.when(F.col("alias").isNotNull(), F.contains("_low", F.col("alias"))).otherwise(stands))
    return found.select(F.col("_id").alias(key), "symbol").distinct()


def entities_of(docs: DataFrame, key: str, text: str, dictionary: DataFrame, context: Sequence[str] = Cues.context) -> DataFrame:
    """``docs`` with ``entries``: its symbols in order, each with company and industry."""
    facts = dictionary.select("symbol", "company", "industry").dropDuplicates(["symbol"])
    own = symbols_of(docs, key, text, dictionary, context).join(facts, "symbol")
    own = own.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("symbol", "company", "industry"))).alias("entries"))
    none = F.array().cast("array<struct<symbol: string, company: string, industry: string>>")
    return docs.join(own.withColumnRenamed(key, "_key"), docs[key].eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("entries", F.coalesce("entries", none))


def _hits(low: Column, words: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if words else F.array().cast("array<string>")


def _quoted(words: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")


def _say(sentence: str, **parts: Column) -> Column:
    """A sentence of SAYS with its parts put in."""
    out, rest = [], SAYS[sentence]
    while "{" in rest:
        head, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        out += [F.lit(head), parts[slot]]
    return F.concat(*out, F.lit(rest))


def _percent(number: Column) -> Column:
    """A decimal text as a number in brief: no needless zeros, six digits."""
    value = number.cast("double")
    brief = F.when(value >= 100, F.round(value, 3)).when(value >= 10, F.round(value, 4)).otherwise(F.round(value, 5))
    return F.regexp_replace(brief.cast("string"), r"\.0$", "")


def analysed(articles: DataFrame, key: str, dictionary: DataFrame, cues: Cues | None = None, high: float = 0.6, low: float = 0.4, *, moves: bool = True) -> DataFrame:
    """``articles`` (key, title, content) with stocks, companies, industries, events, sentiment, impact_score and reasons.

    ``high`` and ``low`` are the shares of good cues from which, and up to which,
    a mood counts as good or bad. The text is lower-cased once. Without ``moves``
    percentages count for nothing.
    """
    cues = cues or Cues()
    whole = articles.withColumn("_text", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))))
    rows = entities_of(whole, key, "_text", dictionary, cues.context).withColumn("_low", F.lower("_text"))
    text = F.col("_low")
    move = rf"({cues.up}|{cues.down})[^%\n]{{0,20}}?(\d{{1,3}}(?:[.,]\d+)?)\s*%"
    told = F.arrays_zip(F.regexp_extract_all(text, F.lit(move), F.lit(1)).alias("way"), F.transform(F.regexp_extract_all(text, F.lit(move), F.lit(2)), lambda x: F.replace(x, F.lit(","), F.lit("."))).alias("number"))
    if not moves:
        told = F.array().cast("array<struct<way: string, number: string>>")
    families = [F.struct(F.lit(n).alias("name"), F.lit(cues.labels.get(n, n.replace("_", " ").title())).alias("label"), _hits(text, w).alias("hits")) for n, w in cues.events.items()]
    trades = [F.struct(F.lit(n).alias("name"), _hits(text, w).alias("hits")) for n, w in cues.industries.items()]
    some = lambda found, kind: F.filter(F.array(*found), lambda x: F.size(x["hits"]) > 0) if found else F.array().cast(kind)
    rows = rows.withColumns({
        "_good": _hits(text, cues.positive), "_bad": _hits(text, cues.negative), "_moves": told,
        "_events": some(families, "array<struct<name: string, label: string, hits: array<string>>>"), "_trades": some(trades, "array<struct<name: string, hits: array<string>>>"),
    })
    there = lambda field: F.filter(F.transform("entries", lambda e: e[field]), lambda x: x.isNotNull() & (x != ""))
    moved = lambda way: F.transform(F.filter("_moves", lambda m: m["way"] == way), lambda m: m["number"].cast("double"))
    mood = X.sentiment(F.size("_good"), F.size("_bad"), moved(cues.up), moved(cues.down), high, low)
    rows = rows.withColumns({
        "stocks": F.transform("entries", lambda e: e["symbol"]), "companies": there("company"),
        "industries": F.array_distinct(F.concat(there("industry"), F.transform("_trades", lambda t: t["name"]))), "events": F.transform("_events", lambda e: e["name"]), "_mood": mood,
    })
    rows = rows.withColumns({"sentiment": F.col("_mood.label"), "impact_score": F.col("_mood.score"), "reasons": _reasons(rows)})
    return rows.drop("_text", "_low", "entries", *[c for c in rows.columns if c in ("_good", "_bad", "_moves", "_events", "_trades", "_mood")])


def _reasons(rows: DataFrame) -> Column:
    good, bad, moves = F.col("_good"), F.col("_bad"), F.col("_moves")
    quotes = F.array_join(F.transform(F.slice(moves, 1, 5), lambda m: F.concat(m["way"], F.lit(" "), _percent(m["number"]), F.lit("%"))), ", ")
    cued = lambda side, words: F.when(F.size(words) > 0, _say(side, n=F.size(words).cast("string"), q=_quoted(words, 5)))
    first = F.array(
        F.when(F.size(moves) > 0, _say("moves", q=quotes)), cued("positive", good), cued("negative", bad), F.when((F.size(good) == 0) & (F.size(bad) == 0), _say("neither")),
    )
    events = F.transform("_events", lambda e: _say("event", name=e["label"], q=_quoted(e["hits"], 3)))
    companies = F.array(F.when(F.size("companies") > 0, _say("companies", q=F.array_join(F.slice("companies", 1, 5), ", "))))

    def industry(name: Column) -> Column:
        cue = F.get(F.filter("_trades", lambda t: t["name"] == name), F.lit(0))
        return F.when(cue.isNotNull(), _say("industry_cue", name=name, q=_quoted(cue["hits"], 3))).otherwise(_say("industry_symbol", name=name))

    last = F.array(F.coalesce(*[F.when(F.col("_mood.label") == m, F.lit(SAYS[m])) for m in ("Positive", "Negative", "Neutral")]))
    return F.array_compact(F.concat(first, events, companies, F.transform("industries", industry), last))


def decided(rows: DataFrame, review_below: float = 0.45, cues: Cues | None = None) -> DataFrame:
    """``analysed`` rows, with a model's ``result`` struct(status, trend, confidence, decision) or null, as they are stored.

    Only a result with status SCORED gives a trend. Any other keeps its refusal,
    or ERROR where there is none, and gets what the rules say beside it, as a
    fallback that is no prediction. Rows without a confidence or with one below
    ``review_below`` go to review.
    """
    weights = F.create_map(*[F.lit(x) for kv in (cues or Cues()).weights.items() for x in kv])
    weight = F.aggregate("events", F.lit(0), lambda s, e: s + F.coalesce(weights[e], F.lit(0)))
    zero = F.lit(0)
    rule = X.trend(F.col("sentiment"), weight, F.col("impact_score").cast("decimal(18,2)"), F.lit(0.5).cast("decimal(2,1)"), zero, zero)
    scored = F.coalesce(F.col("result.status") == "SCORED", F.lit(False))
    rows = rows.withColumn("_rule", rule).withColumns({
        "predicted_trend": F.when(scored, F.col("result.trend")), "prediction_confidence": F.when(scored, F.col("result.confidence")),
        "prediction_decision": F.coalesce("result.decision", "result.status", F.lit("ERROR")), "fallback_trend": F.when(~scored, F.col("_rule.trend")), "is_analyzed": F.lit(True), "graph_built": F.lit(True),
    })
    sure = F.col("prediction_confidence") >= review_below
    return rows.withColumn("needs_manual_label", ~F.coalesce(sure, F.lit(False))).drop("_rule", "result")
