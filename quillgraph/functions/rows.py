"""Functions of one row: names, addresses, JSON, flags, reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms at the start of company names, and their short forms; the first that fits counts.
COMPANY_FORMS = (
    ("Ngân hàng Thương mại Cổ phần ", "NH "), ("Ngân hàng TMCP ", "NH "), ("Ngân hàng ", "NH "), ("Tổng Công ty Cổ phần ", "TCT "),
    ("Tổng Công ty ", "TCT "), ("Công ty Cổ phần Tập đoàn ", "CTCP TĐ "), ("Công ty Cổ phần ", "CTCP "), ("Tập đoàn ", "TĐ "),
)


def short_company(name: Column, symbol: Column, size: int = 28) -> Column:
    """The brand between the outer brackets, unless it is the symbol or does not fit; else the name with its legal form cut short."""
    brand = F.trim(F.regexp_extract(name, r"(?s)\((.*)\)", 1))
    fits = (F.length(brand) > 1) & (F.length(brand) <= size) & (F.upper(brand) != F.upper(F.coalesce(symbol, F.lit(""))))
    short = F.coalesce(*[F.when(F.startswith(name, F.lit(form)), F.concat(F.lit(abbrev), F.substring(name, len(form) + 1, 10_000))) for form, abbrev in COMPANY_FORMS], name)
    return F.when(fits, brand).when(F.length(short) <= size, short).otherwise(F.concat(F.rtrim(F.substring(short, 1, size - 1)), F.lit("…")))


def label_of(name: Column) -> Column:
    """profit_growth as Profit Growth."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def symbol_of(raw: Column) -> Column:
    return F.upper(F.trim(raw))


def names_symbol(title: Column, symbol: Column) -> Column:
    """Whether the upper-cased title holds the symbol with no Latin letter or digit beside it."""
    return F.regexp_like(F.upper(title), F.concat(F.lit(r"(?<![A-Z0-9])\Q"), F.upper(symbol), F.lit(r"\E(?![A-Z0-9])")))


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys; a null is ''."""
    return F.to_json(F.struct(*[F.coalesce(fields[k].cast("string"), F.lit("")).alias(k) for k in sorted(fields)]))


def attribute(json: Column, key: str, strict: bool = False) -> Column:
    """A key of a JSON object; null where the text is none, or an error if ``strict``."""
    parsed = F.from_json(json, "map<string,string>")
    if strict:
        parsed = F.when(F.try_parse_json(json).isNull() & json.isNotNull(), F.raise_error(F.concat(F.lit("no JSON: "), json)).cast("map<string,string>")).otherwise(parsed)
    return F.try_element_at(parsed, F.lit(key))


def first_nonempty(value: Column, *order: Column) -> Column:
    """Aggregate: the first value by ``order`` that is not blank, else ''."""
    kept = F.nullif(F.trim(value), F.lit(""))
    return F.coalesce(F.min_by(kept, F.when(kept.isNotNull(), F.struct(*order))), F.lit(""))


def reviewer_truth(correct: Column, auto: Column, corrected: Column) -> Column:
    return F.when(symbol_of(correct) == "YES", auto).otherwise(corrected)


def review_fault(correct: Column, corrected: Column, labels: Sequence[str]) -> Column:
    """What is wrong with one answer of a review, or null."""
    said = symbol_of(F.coalesce(correct, F.lit("")))
    given = symbol_of(F.coalesce(corrected, F.lit("")))
    return F.when(~said.isin("YES", "NO"), "correctness must be YES or NO").when((said == "NO") & ~given.isin(*labels), "corrected label missing or unknown")


def lean(up: Column, down: Column) -> Column:
    """struct(up, share): the likelier direction, and its share of the two."""
    return F.struct((up >= down).alias("up"), F.when(up + down > 0, F.greatest(up, down) / (up + down)).otherwise(0.5).alias("share"))


def coin_flip(rate: Column) -> Column:
    """Within three hundredths of one half."""
    return F.abs(rate - 0.5) < 0.03


def url_fault(url: Column) -> Column:
    """Why an address is refused, or null. Names are not resolved; addresses in digits are judged as they stand."""
    parts = lambda k: F.regexp_extract(F.trim(url), r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", k)
    host = F.lower(parts(2))
    # Blocks of addresses that are no public ones.
    inner = r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^(22[4-9]|2[3-5][0-9])\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
    number = F.regexp_like(host, F.lit(r"^[0-9]+(\.[0-9]+){3}$"))
    six = F.regexp_like(host, F.lit(r"^\[(::1?|f[cdef][0-9a-f]*:.*|fe80:.*|::ffff:.*)\]$"))
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "empty")
        .when(~F.lower(parts(1)).isin("http", "https"), "scheme")
        .when(host == "", "host")
        .when((host == "localhost") | (number & F.regexp_like(host, F.lit(inner))) | six, "inner address")
    )


def finite(*prices: str) -> Column:
    """Every one of the columns holds a finite number."""
    ok = F.lit(True)
    for p in prices:
        ok = ok & F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return ok


def year_columns(names: Sequence[str]) -> list[str]:
    """Columns that are named by a year, newest first."""
    return sorted((n for n in names if len(n) == 4 and n.isascii() and n.isdigit()), reverse=True)


def leaking_columns(names: Sequence[str], tokens: Sequence[str], prefixes: Sequence[str] = ()) -> list[str]:
    """Columns whose name holds one of the tokens or starts with one of the prefixes."""
    return [n for n in names if any(t in n.lower() for t in tokens) or n.lower().startswith(tuple(prefixes))]
