"""Secret scans: fixed patterns, then assignments read from source and configuration syntax.

The lexer finds assignment signs, reads the name before and the literals after
each: quoted in one, two or three marks, bare, or the indented lines of a
block. A name that is called is no literal. An element's attribute ``value``
belongs to the name in its ``key``, ``name`` or ``id`` before it. Literals may be joined by signs or stand side by side, over line ends and
comments. It keeps what a plain name was last set to, so that ``x = "..."``
followed by ``password = x`` points at the literal of ``x``. A literal scores by
how sensitive its target's name is and by its own length and mix of signs. Spans
are in code points, ends exclusive. Names, literals and chains of names have no
bound but the text's.

Defined cases: a null text is empty and has no spans. Each row is scanned by
itself, so repeated rows and null ids pass through. Whole texts are read,
however long or deeply nested. Other columns do not enter. An empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame

from quillgraph.llm.common import with_found

#: The base patterns, with the least length of what must be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "literal")
#: How sensitive the parts of a target's name are.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "private": 0.6, "auth": 0.6, "bearer": 0.8, "key": 0.5, "access": 0.3, "signature": 0.5, "salt": 0.5, "api": 0.4, "client": 0.2, "dsn": 0.6,
}
#: Literals that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "password", "secret", "example", "placeholder", "undefined", "null", "none", "true", "false", "redacted"}
LIMIT = 1.0
_SIGN = re.compile(r"[:=]+>?")
_SIGNS = ("=", ":", ":=", "=>", "==>")
_PREFIX = re.compile(r"[ \t]*(\(\s*)?(?:[rRbBuUfF]{1,2}(?=[\"'])|@(?=\"))?")
_QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\[\s\S])*){q}") for q in "\"'`"}
_WORD = re.compile(r"([A-Za-z_$][\w$.]*)(?![\w+/=-])")
_BARE = re.compile(r"[A-Za-z0-9+/_=.~-]+")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[ \t]*\n")
_TYPE = re.compile(r"[ \t]*[A-Za-z_][\w.\[\], |]*")
_BREAK = r"(?:[ \t]*(?:(?:#|//)[^\n]*)?\\?\n)*[ \t]*"
_JOIN = re.compile(rf"{_BREAK}(?:[+&]{_BREAK}(?=[\"'`A-Za-z_$])|\.\.?{_BREAK}(?=[\"'`]))")
_BESIDE, _BESIDE_OPEN = re.compile(r"[ \t]*(?:\\\n[ \t]*)*(?=[\"'])"), re.compile(rf"{_BREAK}(?=[\"'])")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost non-overlapping for each kind."""
    low = text.lower()
    out = []
    if any(w in low for w in ("pass", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    return max((NAME_WEIGHTS.get(p, 0.0) for p in [*parts, *joined]), default=0.0)


class Value:
    """A literal, or values joined: its parts are (start, end) of literals and other values, its signs are counted."""

    def __init__(self, parts: list, signs: Counter, short: str):
        self.parts, self.signs, self.short = parts, signs, short

    @classmethod
    def literal(cls, text: str, start: int, end: int) -> Value:
        return cls([(start, end)], Counter(text[start:end]), text[start : min(end, start + 16)])

    @classmethod
    def joined(cls, values: list[Value]) -> Value:
        if len(values) == 1:
            return values[0]
        return cls(values, sum((v.signs for v in values), Counter()), "".join(v.short for v in values)[:16])

    def score(self) -> float:
        """From 0 to 1: length and entropy of the signs; 0 for placeholders and plain words."""
        n = self.signs.total()
        if n < 8 or (n <= 16 and self.short.lower() in PLACEHOLDERS) or len(self.signs) < 4 or " " in self.signs:
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.signs.values())
        kinds = sum(any(map(f, self.signs)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        return min(1.0, entropy / 4.0) * min(1.0, n / 12) * (0.5 if kinds < 2 else 1.0)

    def spans(self, done: set[Value]) -> list[tuple[int, int]]:
        """Spans of all literals of which it is joined; ``done`` holds the values already gone through."""
        out, todo = [], [self]
        while todo:
            value = todo.pop()
            if value not in done:
                done.add(value)
                for part in value.parts:
                    (todo if isinstance(part, Value) else out).append(part)
        return out


class Lines:
    """The lines of a text that are not blank, as values; those of a run of lines are joined from shared halves, each made once.

    So nested blocks cost a logarithm of the lines each and not their text again.
    """

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.depth, self.made = text, [], [], [], {}
        at = 0
        for own in text.split("\n"):
            if short := own.strip():
                first = len(own) - len(own.lstrip())
                self.starts.append(at + first)
                self.ends.append(at + first + len(short))
                self.depth.append(first)
            at += len(own) + 1
        # The first later line that is indented no further than each.
        self.until, open_ = [len(self.depth)] * len(self.depth), []
        for k, depth in enumerate(self.depth):
            while open_ and self.depth[open_[-1]] >= depth:
                self.until[open_.pop()] = k
            open_.append(k)

    def run(self, low: int, high: int) -> Value:
        """The value of a node of the tree of halves."""
        if (low, high) not in self.made:
            mid = (low + high) // 2
            self.made[low, high] = Value.literal(self.text, self.starts[low], self.ends[low]) if high - low == 1 else Value.joined([self.run(low, mid), self.run(mid, high)])
        return self.made[low, high]

    def below(self, sign: int) -> Value | None:
        """The lines of the block that the line of the sign opens."""
        own = bisect_right(self.starts, sign) - 1
        if own < 0 or self.until[own] == own + 1:
            return None
        first, end, parts, todo = own + 1, self.until[own], [], [(0, len(self.starts))]
        while todo:
            low, high = todo.pop()
            if first <= low and high <= end:
                parts.append(self.run(low, high))
            elif low < end and first < high:
                mid = (low + high) // 2
                todo += [(mid, high), (low, mid)]
        return Value.joined(parts)


class Lexer:
    def __init__(self, text: str):
        self.text = text
        self.held: dict[str, Value] = {}
        self.unclosed: set[str] = set()  # marks that do not come again
        self.lines: Lines | None = None  # read once, when the first block comes

    def name_before(self, at: int, least: int) -> str:
        """The name that ends before ``at`` and the marks and brackets around it; its text is read once, back to ``least``."""
        text = self.text
        if at > least and text[at - 1] in "+?":
            at -= 1
        while at > least and text[at - 1] in " \t":
            at -= 1
        while at > least and text[at - 1] in "\"'])":
            at -= 1
        first = at
        while first > least and (text[first - 1].isalnum() or text[first - 1] in "_$.-"):
            first -= 1
        while first < at and not (text[first].isalpha() or text[first] in "_$"):
            first += 1
        return text[first:at]

    def one(self, at: int) -> tuple[Value, int, bool] | None:
        """The literal or name at ``at``: its value, its end, whether it is quoted."""
        text = self.text
        mark = text[at : at + 1]
        if mark and mark in "\"'`":
            if mark != "`" and text.startswith(mark * 3, at) and mark * 3 not in self.unclosed:
                end = text.find(mark * 3, at + 3)
                if end >= 0:
                    return Value.literal(text, at + 3, end), end + 3, True
                self.unclosed.add(mark * 3)
            if mark in self.unclosed:
                return None
            if text.find(mark, at + 1) < 0:
                self.unclosed.add(mark)
                return None
            found = _QUOTED[mark].match(text, at)
            return (Value.literal(text, *found.span(1)), found.end(), True) if found else None
        if found := _WORD.match(text, at):
            if text.startswith("(", found.end()):  # a call, whose result is not here
                return None
            return self.held.get(found[1]) or Value.literal(text, *found.span(1)), found.end(), False
        if found := _BARE.match(text, at):
            return Value.literal(text, *found.span()), found.end(), False
        return None

    def block(self, sign: int) -> Value | None:
        """The lines below that are indented further than the line of the sign."""
        if self.lines is None:
            self.lines = Lines(self.text)
        return self.lines.below(sign)

    def value(self, sign: int, at: int) -> Value | None:
        """What stands after a sign."""
        if _BLOCK.match(self.text, at):
            return self.block(sign)
        before = _PREFIX.match(self.text, at)
        parts, at = [], before.end()
        while found := self.one(at):
            value, at, quoted = found
            parts.append(value)
            more = _JOIN.match(self.text, at) or (quoted and (_BESIDE_OPEN if before[1] else _BESIDE).match(self.text, at))
            if not more:
                break
            at = more.end()
        return Value.joined(parts) if parts else None

    def spans(self) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        done: set[Value] = set()
        typed, typed_end, last, named, named_end = "", 0, 0, "", 0
        for sign in _SIGN.finditer(self.text):
            name = self.name_before(sign.start(), last)
            # name: type = value
            if sign[0] == "=" and typed and _TYPE.fullmatch(self.text, typed_end, sign.start()):
                name = typed
            last, typed = sign.end(), ""
            if not name or sign[0] not in _SIGNS:
                continue
            if sign[0] == ":":
                typed, typed_end = name, sign.end()
            value = self.value(sign.start(), sign.end())
            if value is None:
                continue
            if sign[0] == "=" and name in ("key", "name", "id") and len(value.parts) == 1 and isinstance(value.parts[0], tuple):
                named, named_end = self.text[slice(*value.parts[0])], value.parts[0][1]
            elif sign[0] == "=" and name == "value" and named and ">" not in self.text[named_end : min(sign.start(), named_end + 200)] and sign.start() - named_end < 200:
                name, named = named, ""
            self.held[name] = value
            weight = name_score(name)
            if weight and 2 * weight * value.score() >= LIMIT:
                found.update((a, b) for a, b in value.spans(done) if b > a)
        return found


def literal_spans(text: str) -> set[tuple[int, int]]:
    """Spans of literals assigned, directly or through other names, to sensitive names."""
    return Lexer(text).spans()


def scan(text: str | None) -> tuple[int, int, int, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Counts of the base kinds, base spans, all spans."""
    text = text or ""
    base = base_spans(text)
    counts = Counter(k for _, k, _ in base)
    more = [(a, 3, b) for a, b in literal_spans(text)]
    return counts[0], counts[1], counts[2], base, sorted([*base, *more])


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """op8: doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``."""

    def find(texts):
        rows = []
        for text in texts:
            *counts, base, spans = scan(text)
            rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
        return tuple(zip(*rows)) or ((), (), (), (), ())

    return with_found(docs, ["doc_id"], lambda: find, {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"})
