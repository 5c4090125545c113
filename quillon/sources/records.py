"""The record rules, in plain Python: for samples on the driver, and as the yardstick of the distributed reader.

A record ends at a line feed outside quotes (with its carriage return, if one stands before it); a lone carriage
return is data. Blank lines and lines that begin with the comment character are no records. A quote opens only at a
field's start; in it, doubled quotes (or a backslash) escape; what follows the closing quote up to the delimiter
belongs to the field. A quote that is open at the end of the file ends there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache


@dataclass
class Record:
    fields: list[str]
    ending: str  # "\n", "\r\n", or "" at the end of the file
    quoted_newline: bool = False
    unterminated: bool = False


@lru_cache
def field_pattern(delimiter: str, quote: str | None, escape: str) -> re.Pattern:
    """One field from its start: (quoted body, closing quote, rest) or (bare)."""
    d = re.escape(delimiter)
    bare = f"([^{d}\n]*)"
    if quote is None:
        return re.compile(f"(?!)()()()|{bare}")
    q = re.escape(quote)
    body = rf"[^{q}\\]*+(?:\\[\s\S][^{q}\\]*+)*+\\?" if escape == "backslash" else f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    return re.compile(f"{q}({body})({q}?)([^{d}\n]*)|{bare}")


def unescape(body: str, quote: str, escape: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", body) if escape == "backslash" else body.replace(quote * 2, quote)


def records(text: str, dialect) -> Iterator[Record]:
    pattern, at, n = field_pattern(dialect.delimiter, dialect.quote, dialect.escape), 0, len(text)
    while at < n:
        if text[at] == "\n" or text.startswith("\r\n", at):
            at += 1 if text[at] == "\n" else 2
            continue
        if dialect.comment and text[at] == dialect.comment:
            end = text.find("\n", at)
            at = n if end < 0 else end + 1
            continue
        out = Record([], "")
        while True:
            m = pattern.match(text, at)
            at = m.end()
            quoted = m[1] is not None
            out.unterminated = quoted and not m[2]
            tail = m[3] if quoted else m[4]
            stop = at >= n or text[at] == "\n"
            if stop and at < n and tail.endswith("\r"):
                tail, out.ending = tail[:-1], "\r\n"
            elif stop and at < n:
                out.ending = "\n"
            out.quoted_newline |= quoted and ("\n" in m[1] or "\r" in m[1])
            out.fields.append(unescape(m[1], dialect.quote, dialect.escape) + tail if quoted else tail)
            at += 1
            if stop:
                break
        yield out


def open_after(line: str, inside: bool, dialect) -> bool:
    """Whether a quote is open after a physical line, given whether one was open before it."""
    q, d = dialect.quote, dialect.delimiter
    if q is None or q not in line:  # most lines: nothing opens, nothing closes
        return inside and q is not None
    pattern = field_pattern(d, q, dialect.escape)
    at = 0
    if inside:
        m = pattern.match(q + line)
        if not m[2]:
            return True
        at = m.end()  # less the added quote, past the delimiter
    while at <= len(line):
        m = pattern.match(line, at)
        if m[1] is not None and not m[2]:
            return True
        at = m.end() + 1
    return False
