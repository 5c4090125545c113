"""How a delimited file is written, and finding it out from its first bytes."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

from quillon.functions import values
from quillon.sources.records import Record, records

#: In the order that settles ties.
DELIMITERS = (",", "\t", "|", ";", ":", " ")
SAMPLE, EXTENSION, HEADER_ROWS = 64 << 10, 1 << 20, 1000
BOMS = (("utf-8-bom", b"\xef\xbb\xbf"), ("utf-16le", b"\xff\xfe"), ("utf-16be", b"\xfe\xff"))
CODECS = {"utf-8": "utf-8", "utf-8-bom": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "windows-1252": "cp1252"}
ALIASES = {"latin1": "windows-1252", "utf8": "utf-8", "cp1252": "windows-1252", "utf-16-le": "utf-16le", "utf-16-be": "utf-16be"}


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str | None = '"'
    escape: str = "doubled"  # or backslash
    line_ending: str = "lf"  # crlf, mixed
    header: bool = True
    encoding: str = "utf-8"
    comment: str | None = None


UNSET = object()


@dataclass(frozen=True)
class Overrides:
    """Forced parts of a dialect; ``quote=None`` turns quoting off, ``UNSET`` leaves it to be found."""

    delimiter: str | None = None
    quote: object = UNSET
    escape: str | None = None
    header: bool | None = None
    encoding: str | None = None
    comment: str | None = None

    def forced(self) -> dict:
        return {k: v for k, v in vars(self).items() if (v is not UNSET if k == "quote" else v is not None)}


@dataclass(frozen=True)
class SniffReport:
    detected: Dialect
    dialect: Dialect
    quoted_newlines: bool
    sample_len: int
    sample_truncated: bool


def detect_encoding(sample: bytes) -> str:
    """By the byte-order mark, else UTF-8 where the sample is (its end may be cut), else Windows-1252."""
    for name, mark in BOMS:
        if sample.startswith(mark):
            return name
    try:
        sample.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.reason != "unexpected end of data":
            return "windows-1252"
    return "utf-8"


def _window(body: bytes, size: int, wide: str | None) -> tuple[bytes, bool]:
    """The sample, made longer to the end of a line, and whether that end wasn't found."""
    if len(body) <= size:
        return body, False
    most = min(size + EXTENSION, len(body))
    if wide:
        mark, at = ("\n".encode(CODECS[wide])), max((size & ~1) - 2, 0)
        while (at := body.find(mark, at, most)) >= 0:
            if at % 2 == 0:
                return body[: at + 2], False
            at += 1
        return body[: most & ~1], most < len(body)
    at = body.find(b"\n", size - 1, most)
    return (body[: at + 1], False) if at >= 0 else (body[:most], most < len(body))


def consistency(counts: list[int]) -> float:
    """Share of the records that have the commonest count; none for a commonest count of none."""
    if not counts:
        return 0.0
    mode, n = max(Counter(counts).items(), key=lambda x: (x[1], x[0]))
    return 0.0 if not mode else n / len(counts) if len(counts) > 1 else 1.0


def delimiter_scores(text: str, quote: str | None, comment: str | None, whole: bool) -> dict[str, float]:
    """Every quote toggles, wherever it stands; blank and comment lines don't count."""
    counts: dict[str, list[int]] = {d: [] for d in DELIMITERS}
    q = re.escape(quote) if quote else None
    bare = re.sub(f"{q}[^{q}]*(?:{q}|\\Z)", "\0", text) if q else text  # quoted stretches hide what they hold
    open_end = bool(quote) and text.count(quote) % 2 == 1
    lines = bare.split("\n")
    last = lines.pop()
    if whole and last and not open_end:
        lines.append(last)
    for line in lines:
        if line.rstrip("\r") and not (comment and line.startswith(comment)):
            for d in DELIMITERS:
                counts[d].append(line.count(d))
    return {d: consistency(c) for d, c in counts.items()}


def best_delimiter(scores: dict[str, float]) -> str:
    best = max(DELIMITERS, key=lambda d: (scores[d], -DELIMITERS.index(d)))
    return best if scores[best] > 0 else ","


def quote_counts(text: str, delimiter: str) -> tuple[int, int]:
    """How often a double and a single quote stands at a field's beginning or end."""
    d = re.escape(delimiter)
    count = lambda q: len(re.findall(f"(?:\\A|(?<=[{d}\n])){q}", text)) + len(re.findall(f"{q}(?=[{d}\n\r]|\\Z)", text))
    return count('"'), count("'")


def detect_escape(text: str, quote: str, delimiter: str) -> str:
    """Backslash if quotes inside fields are written so and never doubled."""
    q, edge = re.escape(quote), f"[{re.escape(delimiter)}\n\r]"
    backslash = re.search(rf"\\{q}(?!{edge}|\Z)", text)
    fields = (delimiter, "\n")
    doubled = False
    for m in re.finditer(f"(?={q}{q})", text):
        a, b = m.start(), m.start() + 2
        empty = (a == 0 or text[a - 1] in fields) and (b >= len(text) or text[b] in (*fields, "\r"))  # a whole field
        doubled |= not empty
    return "backslash" if backslash and not doubled else "doubled"


def _typed(s: str) -> bool:
    bare = s.replace("_", "").replace(",", "")
    if re.fullmatch(r"[+-]?[0-9.eE+-]*[0-9][0-9.eE+-]*", bare):
        try:
            float(bare)
            return True
        except ValueError:
            pass
    if re.match(r"[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4}", s, re.A):
        return True
    return s.lower() in ("true", "false", "yes", "no") or values.parse_f64(s) is not None or values.parse_datetime(s) is not None


def detect_header(rows: list[list[str]]) -> bool:
    """A name over typed values; or names throughout, one of which is no value of its column."""
    if not rows:
        return False
    first, rest = rows[0], rows[1:]
    for c, name in enumerate(first):
        name = name.strip()
        others = [v for r in rest if c < len(r) and (v := r[c].strip())]
        if name and others and not _typed(name) and 10 * sum(map(_typed, others)) >= 9 * len(others):
            return True
    named = all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_ .\-]{0,63}", v) for v in first) and len(set(first)) == len(first)
    return named and any(not any(c < len(r) and r[c] == v for r in rest) for c, v in enumerate(first))


def _detect(data: bytes, size: int, forced: Overrides) -> tuple[Dialect, bool, int, bool]:
    encoding = forced.encoding or next((n for n, mark in BOMS if data.startswith(mark)), None)
    mark = next((m for n, m in BOMS if n == (encoding or "").replace("utf-8", "utf-8-bom").replace("-bom-bom", "-bom") and data.startswith(m)), b"")
    wide = encoding if encoding in ("utf-16le", "utf-16be") else None
    body = data[len(mark) :]
    sample, truncated = _window(body, max(size, 1), wide)
    whole = len(sample) == len(body)
    encoding = encoding or detect_encoding(sample)
    text = sample.decode(CODECS[encoding], "replace") if wide else sample.decode("latin-1")  # one character a byte
    decode = (lambda v: v) if wide else (lambda v: v.encode("latin-1").decode(CODECS[encoding], "replace"))
    fixed = forced.forced()
    quote = fixed.get("quote", '"')
    delimiter = fixed.get("delimiter") or best_delimiter(delimiter_scores(text, quote, forced.comment, whole))
    if "quote" not in fixed:
        double, single = quote_counts(text, delimiter)
        quote = "'" if single > double else '"' if double else None
        if quote == "'" and "delimiter" not in fixed:
            delimiter = best_delimiter(delimiter_scores(text, "'", forced.comment, whole))
    escape = fixed.get("escape") or (detect_escape(text, quote, delimiter) if quote else "doubled")
    dialect = Dialect(delimiter, quote, escape, "lf", False, encoding, forced.comment)
    rows, ends, newlines = [], Counter(), False
    for r in records(text, dialect):
        if not whole and not r.ending:
            truncated = True
            break
        newlines |= r.quoted_newline
        if r.ending:
            ends[r.ending] += 1
        if len(rows) < HEADER_ROWS:
            rows.append([decode(v) for v in r.fields])
    ending = "lf" if not ends["\r\n"] else "crlf" if not ends["\n"] else "mixed"
    header = detect_header(rows) if forced.header is None else forced.header
    return replace(dialect, line_ending=ending, header=header), newlines, len(mark) + len(sample), truncated


def sniff(data: bytes, size: int = SAMPLE, overrides: Overrides = Overrides()) -> SniffReport:
    """The dialect of a file that begins with ``data``: as found, and under the overrides."""
    found, newlines, length, truncated = _detect(data, size, Overrides())
    dialect = found
    if overrides.forced():
        dialect, newlines, length, truncated = _detect(data, size, overrides)
    return SniffReport(found, dialect, newlines, length, truncated)


__all__ = ["Dialect", "Overrides", "Record", "SniffReport", "detect_encoding", "sniff"]
