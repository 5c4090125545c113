"""Cell search: literal or by expression, forwards and backwards through a view's order, with wrap-around."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import regexes
from quillon.operators.views import View
from quillon.plans.names import NameError_, match_column
from quillon.sources.source import ROW, ColumnMeta


@dataclass(frozen=True)
class Search:
    text: str
    regex: bool = False
    column: ColumnMeta | None = None


def parse_search(text: str, source) -> Search:
    """``text``, ``re:expr``, ``col: text``, ``col: re:expr``; a prefix that names no one column is text."""
    if text.startswith("re:"):
        regexes.check(text[3:])
        return Search(text[3:], True)
    name, colon, rest = text.partition(":")
    if colon and name.strip():
        try:
            c = source.columns[match_column(name, source.names)]
        except NameError_:
            return Search(text)
        rest = rest.removeprefix(" ")
        if rest.startswith("re:"):
            regexes.check(rest[3:])
            return Search(rest[3:], True, c)
        return Search(rest, False, c)
    return Search(text)


def find_in_cell(value: str, s: Search) -> list[tuple[int, int]]:
    """All ranges in a cell (code points), none over another."""
    import regex

    if not s.text:
        return []
    found = regex.finditer(s.text, value) if s.regex else re.finditer(re.escape(s.text), value)
    return [m.span() for m in found if m.end() > m.start()]


def _first(t: Column, s: Search) -> tuple[Column, Column]:
    """Where a cell's first match starts (from 1, 0 for none), and the match."""
    if s.regex:
        java = F.lit(regexes.to_java(s.text))
        return F.regexp_instr(t, java), F.regexp_substr(t, java)
    return F.instr(t, F.lit(s.text)), F.lit(s.text)


def columns_of(view: View, s: Search) -> list[ColumnMeta]:
    """The searched column, even if it's hidden, or all visible ones."""
    return [s.column] if s.column else view.source.visible()


def _found(view: View, s: Search) -> Column:
    """An array of a row's matching cells: slot, column, start and end of the first match in bytes."""
    found = []
    for slot, c in enumerate(columns_of(view, s)):
        t = view.source.text(c)
        at, what = _first(t, s)
        start = F.octet_length(F.substring(t, F.lit(1), at - 1))
        found.append(F.when(at > 0, F.struct(F.lit(slot).alias("slot"), F.lit(c.query).alias("column"), start.alias("start"), (start + F.octet_length(what)).alias("end"))))
    return F.array_compact(F.array(*found))


def hits(view: View, s: Search) -> DataFrame:
    """(_row_id, slot, column, start, end): each matching cell with the byte range of its first match. Null spellings
    are text like any other; missing cells have none."""
    return view.df.select(ROW, F.explode(_found(view, s)).alias("h")).select(ROW, "h.slot", "h.column", "h.start", "h.end")


@dataclass(frozen=True)
class Hit:
    pos: int
    row_id: int
    slot: int
    column: str
    start: int
    end: int
    wrapped: bool = False


def next_match(view: View, s: Search, pos: int, slot: int, backwards: bool = False) -> Hit | None:
    """The next cell after (pos, slot): later cells of the row, later rows, then from the other end; the cell itself
    comes last. Each task hands on the first match of its rows by the view's order; nothing is sorted or numbered."""
    row_id = view.row_at(pos) if pos >= 0 else None
    key = None if row_id is None else view.key_of(row_id)
    if key is None:  # beyond either end
        past = F.lit((pos < 0) == backwards)
    else:
        same, ahead = F.col(ROW) == row_id, view.before(key)
        inside = F.col("h.slot") < slot if backwards else F.col("h.slot") > slot
        past = ~((same & inside) | (ahead if backwards else ~ahead & ~same))
    cells = view.df.withColumn("h", F.explode(_found(view, s)))
    if backwards:
        order = [k.asc_nulls_first() if d else k.desc_nulls_first() for k, d in view.order] + [F.col(ROW).desc(), F.col("h.slot").desc()]
    else:
        order = [*view.ordering(), F.col("h.slot").asc()]
    r = cells.orderBy(past.asc(), *order).select(ROW, "h.slot", "h.column", "h.start", "h.end", past.alias("w")).first()
    return Hit(view.position_of(r[0]), *r) if r else None
