"""Sizes, counts, display width and display-safe text (driver-side helpers)."""

from __future__ import annotations

import unicodedata
from fractions import Fraction

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

_SCALED = regex.compile(r"(?=\.?[0-9])(?P<whole>[0-9]*)(?P<point>\.(?P<part>[0-9]*))?\s*(?P<unit>[A-Za-z]*)")
_BINARY = {"": 1, "b": 1} | {unit + end: 1 << 10 * k for k, unit in enumerate("kmgt", 1) for end in ("", "b", "ib")}
_DECIMAL = {"": 1} | {unit: 1000**k for k, unit in enumerate("kmgt", 1)}


def _scaled(text: str, units: dict[str, int], what: str) -> int:
    found = _SCALED.fullmatch(text.strip())
    factor = units.get(found["unit"].lower()) if found else None
    if factor is None:
        raise ValueError(f"{text!r} is no {what}")
    if found["point"] and factor == 1:
        raise ValueError(f"{text!r}: a fraction needs a unit")
    value = int(Fraction(f"{found['whole'] or 0}.{found['part'] or 0}") * factor)
    if value >= 1 << 64:
        raise ValueError(f"{text!r} is beyond 64 bits")
    return value


def parse_size(text: str) -> int:
    """``512``, ``64K``, ``1.5GiB``: binary units, rounded down to bytes. ValueError for zero and anything else."""
    value = _scaled(text, _BINARY, "size")
    if not value:
        raise ValueError("a size is more than zero")
    return value


def parse_count(text: str) -> int:
    """``250``, ``10k``, ``2.5M``: decimal units, rounded down."""
    return _scaled(text, _DECIMAL, "count")


def format_size(n: int) -> str:
    """``512 B``, ``4.2 KB``: 1 KB is 1,024 B; to the nearest tenth."""
    if n < 1024:
        return f"{n} B"
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        tenths = (20 * n + (1 << 10 * power)) >> (10 * power + 1)
        if tenths < 10_240 or unit == "PB":
            break
    return f"{tenths // 10}.{tenths % 10} {unit}"


def format_count(n: int) -> str:
    return f"{n:,}"


def format_count_compact(n: int) -> str:
    """``999``, ``1.2k``, ``412M``: rounded down, a tenth only below a hundred of the unit."""
    for scale, unit in ((10**12, "T"), (10**9, "G"), (10**6, "M"), (10**3, "k")):
        if n >= scale:
            whole, tenth = divmod(10 * n // scale, 10)
            return f"{whole}.{tenth}{unit}" if tenth and whole < 100 else f"{whole}{unit}"
    return str(n)


def format_rate(bytes_: float, seconds: float = 1.0) -> str:
    """Bytes a second; nothing known is nothing a second."""
    rate = bytes_ / seconds if seconds > 0 else 0.0
    return f"{format_size(int(rate) if 0 < rate < float('inf') else 0)}/s"


def format_eta(seconds: float | None) -> str:
    """``~23 s left``, ``~4 min left``, ``~1 h 12 min left``; a dash where nothing is known."""
    if seconds is None:
        return "—"
    s = max(1, int(seconds + 0.5))
    if s < 60:
        return f"~{s} s left"
    hours, minutes = divmod((s + 30) // 60, 60)
    return "~" + " ".join([f"{hours} h"] * (hours > 0) + [f"{minutes} min"] * (minutes > 0)) + " left"


def _cell_width(c: str) -> int:
    if unicodedata.category(c) in ("Mn", "Me", "Cc", "Cf") or "\u1160" <= c <= "\u11ff":
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def grapheme_width(g: str) -> int:
    """Terminal cells of one grapheme cluster: joined, flagged or emoji-styled symbols are two."""
    if len(g) == 1:
        return _cell_width(g)
    if "\ufe0f" in g or "\u200d" in g and _cell_width(g[0]) == 2 or all("\U0001f1e6" <= c <= "\U0001f1ff" for c in g):
        return 2
    return sum(0 if "\U0001f3fb" <= c <= "\U0001f3ff" and k else _cell_width(c) for k, c in enumerate(g))


def graphemes(s: str) -> list[str]:
    return regex.findall(r"\X", s)


def width(s: str) -> int:
    return len(s) if s.isascii() and s.isprintable() else sum(map(grapheme_width, graphemes(s)))


def prefix_within(s: str, cells: int) -> str:
    """The longest prefix of whole graphemes of at most this many cells."""
    used = end = 0
    for g in graphemes(s):
        used += grapheme_width(g)
        if used > cells:
            break
        end += len(g)
    return s[:end]


def truncate_end(s: str, cells: int) -> str:
    return s if width(s) <= cells else prefix_within(s, cells - 1) + "…" if cells > 0 else ""


def truncate_middle(s: str, cells: int) -> str:
    """Both ends, the first with the odd cell."""
    if width(s) <= cells:
        return s
    if cells <= 0:
        return ""
    head = prefix_within(s, cells // 2)
    room, tail = cells - 1 - width(head), []
    for g in reversed(graphemes(s[len(head) :])):
        room -= grapheme_width(g)
        if room < 0:
            break
        tail.append(g)
    return head + "…" + "".join(reversed(tail))


def fit(s: str, cells: int, right: bool = False) -> str:
    """Cut or padded to exactly this many cells; a wide character that would be split is a blank before the ellipsis."""
    missing = cells - width(s)
    if missing >= 0:
        return " " * missing + s if right else s + " " * missing
    if cells <= 0:
        return ""
    head = prefix_within(s, cells - 1)
    return head + " " * (cells - 1 - width(head)) + "…"


_BIDI = frozenset("\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069")


def display_segments(s: str) -> list[tuple[str, bool]]:
    """(text, escaped) runs: control and direction characters come as visible escapes. An empty text is one empty run."""
    out: list[list] = []
    for c in s:
        named = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c)
        special = named or (f"\\x{ord(c):02x}" if ord(c) < 0x20 or 0x7F <= ord(c) < 0xA0 else f"\\u{{{ord(c):x}}}" if c in _BIDI else None)
        piece, escaped = special or c, special is not None
        if out and out[-1][1] == escaped:
            out[-1][0] += piece
        else:
            out.append([piece, escaped])
    return [(a, b) for a, b in out] or [("", False)]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@F.pandas_udf(IntegerType())
def display_width(s: pd.Series) -> pd.Series:
    """Cells of each text; null for null."""
    return s.map(width, na_action="ignore").astype("Int32")
