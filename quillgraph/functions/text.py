"""Text functions as columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cues of event families.
EVENT_PATTERNS = {
    "profit_growth": ["lợi nhuận tăng", "lãi tăng", "doanh thu tăng", "lợi nhuận cao", "lãi kỷ lục", "lãi ròng tăng", "lợi nhuận ròng tăng", "vượt kế hoạch lợi nhuận", "lãi vượt"],
    "profit_decline": ["lợi nhuận giảm", "lãi giảm", "doanh thu giảm", "thua lỗ", "lỗ", "hạ dự báo lợi nhuận", "hạ dự báo", "giảm dự báo lợi nhuận", "cắt giảm dự báo"],
    "dividend": ["cổ tức", "chia cổ tức", "trả cổ tức"],
    "merger": ["sáp nhập", "mua lại", "thâu tóm", "liên doanh", "hợp nhất"],
    "new_contract": ["hợp đồng mới", "ký kết hợp đồng", "trúng thầu", "thắng thầu", "ký hợp đồng"],
    "penalty": ["xử phạt", "vi phạm", "bị phạt", "cảnh báo vi phạm", "điều tra"],
    "leadership_change": ["bổ nhiệm", "miễn nhiệm", "thay đổi lãnh đạo", "tổng giám đốc mới", "từ chức"],
    "share_issuance": ["phát hành cổ phiếu", "tăng vốn", "phát hành thêm", "tăng vốn điều lệ"],
    "expansion": ["mở rộng", "đầu tư mới", "ra mắt sản phẩm", "mở thêm", "khởi công"],
}
#: Weight of each event family in the heuristic trend.
EVENT_IMPACT = {"profit_growth": 2, "new_contract": 2, "expansion": 1, "dividend": 1, "merger": 1, "share_issuance": 0, "leadership_change": -1, "penalty": -2, "profit_decline": -2}


#: Elements that are no text of a page.
BOILERPLATE = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript")


def clean(col: Column) -> Column:
    """White space (also no-break) as single blanks, trimmed; null as ''."""
    return F.coalesce(F.trim(F.regexp_replace(col, r"[\s ]+", " ")), F.lit(""))


def stable_id(prefix: str, size: int, *parts: Column) -> Column:
    """prefix and the first ``size`` hex digits of SHA-256 over parts joined by |; a null part keeps its place."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[clean(p.cast("string")) for p in parts]), 256), 1, size))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often ``use`` names it, lambdas over lists included."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """Keywords contained in the lower-cased text, each once, in list order."""
    return bound(F.lower(text), lambda low: F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, k)))


def events(text: Column, patterns: Mapping[str, Sequence[str]] = EVENT_PATTERNS) -> Column:
    """Families with a hit, in order."""
    own = lambda low, keys: F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(low, k))
    return bound(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(own(low, keys), F.lit(name)) for name, keys in patterns.items()])))


def sentiment(positive: Column, negative: Column, up_moves: Column, down_moves: Column, high: float = 0.6, low: float = 0.4) -> Column:
    """struct(label, score) from numbers of cues and arrays of percentages moved up and down."""
    n = positive + negative
    ratio, strength = positive / n, F.least(n, F.lit(5)) / 5
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(a))
    boost = lambda a: F.when(F.size(a) > 0, F.least(mean(a), F.lit(40.0)) / 40 * 20).otherwise(0.0)
    kept = lambda x: F.round(F.least(F.greatest(x, F.lit(5.0)), F.lit(95.0)), 2)
    answer = lambda label, score: F.struct(F.lit(label).alias("label"), score.alias("score"))
    swing = (ratio - 0.5) * 100 * strength
    return (
        F.when(n == 0, answer("Neutral", F.lit(50.0)))
        .when(ratio >= high, answer("Positive", kept(50 + swing + boost(up_moves))))
        .when(ratio <= low, answer("Negative", kept(50 + swing - boost(down_moves))))
        .otherwise(answer("Neutral", F.lit(50.0)))
    )


def trend(label: Column, event_weight: Column, impact: Column, ratio: Column, positive: Column, negative: Column) -> Column:
    """struct(trend, score, confidence): weighted sum with limits at 15, exact where the inputs are decimals. The weights are fixed values."""
    dec = lambda x: F.lit(Decimal(x))
    sign = F.when(label == "Positive", 1).when(label == "Negative", -1).otherwise(0)
    score = 30 * sign + 15 * event_weight + dec("0.4") * (impact - 50) + (20 * ratio - 10) + 3 * F.least(positive, F.lit(5)) - 3 * F.least(negative, F.lit(5))
    sure = F.when(F.abs(score) > 15, F.least(dec("0.55") + F.abs(score) / 100, dec("0.95"))).otherwise(dec("0.5") + (15 - F.abs(score)) / 100)
    return F.struct(F.when(score > 15, "INCREASING").when(score < -15, "DECREASING").otherwise("UNCHANGED").alias("trend"), F.round(score, 4).alias("score"), F.round(sure, 3).alias("confidence"))


def word_bounded(text: Column, symbol: str) -> Column:
    """Whether the symbol stands in the text, any case, not inside a longer word."""
    return F.rlike(text, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){symbol}(?![\p{{L}}\p{{N}}_])"))


def symbol_mentions(text: Column, markers: Sequence[str] = (), reach: int = 40) -> Column:
    """Distinct upper-case words of two to five letters, in order; with ``markers``, only those with one of these within ``reach`` signs on either side, any case.

    One pass over the words finds all symbols; a join with the dictionary tells which exist.
    """
    word = r"(?<![\p{L}\p{N}_])[A-Z]{2,5}(?![\p{L}\p{N}_])"
    if markers:
        near = "(?i:" + "|".join(rf"\Q{m}\E" for m in markers) + ")"
        # Only at the first sign of such a word does the pattern look around.
        word = rf"(?=[A-Z]{{2}})(?={word})(?:(?<={near}.{{0,{reach}}}){word}|{word}(?=.{{0,{reach}}}{near}))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s){word}"), F.lit(0)))


def percent_moves(text: Column, words: Sequence[str]) -> Column:
    """Percentages, as decimal text, that follow one of ``words`` within 20 signs."""
    number = F.regexp_extract_all(text, F.lit(r"(?iu)(?:" + "|".join(words) + r")[^%\n]{0,20}?(\d{1,3}(?:[.,]\d+)?)\s*%"), F.lit(1))
    return F.transform(number, lambda x: F.replace(x, F.lit(","), F.lit(".")))


def html_title(html: Column) -> Column:
    return F.nullif(clean(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_text(html: Column) -> Column:
    """Text without boilerplate elements, comments and tags."""
    bare = F.regexp_replace(html, rf"(?is)<({'|'.join(BOILERPLATE)})\b.*?</\1>|<!--.*?-->", " ")
    return clean(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), r"^www\.", "")


def without_leading_lines(content: Column, title: Column, date_line: str = r"^\s*\d{1,2}[/-]\d{1,2}[/-]\d{4}.*$") -> Column:
    """Drop leading lines that are blank, the title or a date line, up to the first other line."""
    lines = F.split(content, "\n")
    plain = lambda x: (F.trim(x) == "") | (F.trim(x) == F.trim(title)) | F.rlike(x, F.lit(date_line))
    first = F.array_position(F.transform(lines, lambda x: ~plain(x)), F.lit(True))
    return F.when(first == 0, F.lit("")).otherwise(F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "\n"))


def wilson(k: Column, n: Column, z: float = 1.9599639845) -> Column:
    """struct(low, high); null for n of 0."""
    p, d = k / F.nullif(n, F.lit(0)), 1 + z * z / F.nullif(n, F.lit(0))
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(F.greatest((mid - half) / d, F.lit(0.0)).alias("low"), ((mid + half) / d).alias("high"))


def short_label(title: Column, fallback: Column, size: int = 42) -> Column:
    """White space as single blanks, cut to ``size`` signs with an ellipsis; ``fallback`` for an absent or empty title."""
    whole = F.trim(F.regexp_replace(title, r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(whole, 1, size - 1)), F.lit("…"))
    return F.when(title.isNull() | (title == ""), fallback).when(F.length(whole) <= size, whole).otherwise(cut)


def as_number(value: Column, default: float = 0.0) -> Column:
    """The text as a number; ``default`` where it is none, absent or NaN."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def as_flag(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "yes"), F.lit(False))


def preview(content: Column, limit: int = 500) -> Column:
    """struct(paragraphs, truncated): trimmed paragraphs that are not blank, until ``limit`` signs are used.

    The one that passes the limit is cut, at its last blank if that lies past
    40 signs, and ends in an ellipsis. The limit is the feature.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("paragraphs"), F.lit(0).alias("used"), F.lit(False).alias("truncated"))

    def step(s: Column, p: Column) -> Column:
        left = F.lit(limit) - s["used"]
        head = F.substr(p, F.lit(1), left)
        blank = F.length(head) - F.instr(F.reverse(head), " ")
        kept = F.when((F.instr(head, " ") > 0) & (blank > 40), F.substr(head, F.lit(1), blank)).otherwise(head)
        cut = F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit("…"))
        state = lambda a, u, t: F.struct(a.alias("paragraphs"), u.alias("used"), t.alias("truncated"))
        fits = F.length(p) <= left
        return (
            F.when(s["truncated"] | (left <= 0), state(s["paragraphs"], s["used"], F.lit(True)))
            .when(fits, state(F.array_append(s["paragraphs"], p), s["used"] + F.length(p), F.lit(False)))
            .otherwise(state(F.array_append(s["paragraphs"], cut), F.lit(limit), F.lit(True)))
        )

    return F.aggregate(parts, empty, step, lambda s: F.struct(s["paragraphs"].alias("paragraphs"), s["truncated"].alias("truncated")))


def market_open(instant: Column, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """Whether the exchange trades: a weekday, from 9:00 to 11:30 or from 13:00 to 14:45 in ``zone``. The hours are fixed values."""
    here = F.from_utc_timestamp(instant, zone)
    minute = F.hour(here) * 60 + F.minute(here)
    return (F.weekday(here) < 5) & (minute.between(540, 690) | minute.between(780, 885))


def evidence_points(tier: Column, directness: Column, reason: Column, symbol: Column, url: Column, event: Column, confidence: Column) -> Column:
    """0 to 100 from what supports a row. The points are fixed values."""
    there = lambda c: clean(c) != ""
    points = [(clean(tier) == "HIGH_PRECISION", 25), (clean(directness).startswith("TITLE_"), 20), (there(reason), 15), (there(symbol), 10), (there(url), 10), (clean(event) != "OTHER", 10), (clean(confidence) == "HIGH", 10)]
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))


def review_priority(event: Column, rare: Sequence[str]) -> Column:
    return F.when(event.isin(*rare), "CRITICAL").when(event != "OTHER", "HIGH").otherwise("MEDIUM")


def quote(price: Column, reference: Column) -> Column:
    """struct(price, change, percent): a price of 0 means the reference; without a reference nothing changes."""
    ref, own = as_number(reference), as_number(price)
    now = F.when(own == 0, ref).otherwise(own)
    change = F.when(ref != 0, F.round(now - ref, 2)).otherwise(0.0)
    return F.struct(now.alias("price"), change.alias("change"), F.when(ref != 0, F.round(change / ref * 100, 2)).otherwise(0.0).alias("percent"))


def primary(results: Column) -> Column:
    """The first element whose focus is PRIMARY, else the first, else null."""
    return F.coalesce(F.get(F.filter(results, lambda r: r["focus"] == "PRIMARY"), F.lit(0)), F.get(results, F.lit(0)))


def with_symbols(content: Column, symbols: Column) -> Column:
    """The text, and behind it the sorted distinct symbols."""
    names = F.array_join(F.array_sort(F.array_distinct(symbols)), ", ")
    return F.when(names == "", F.coalesce(content, F.lit(""))).otherwise(F.concat(F.coalesce(content, F.lit("")), F.lit("\n\n"), names))
