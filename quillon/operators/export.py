"""Delimited output: a view's rows in order, quoted by need, in one file that appears whole or not at all."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.views import View
from quillon.sources.dsv import literal_regex
from quillon.sources.source import ColumnMeta


class ExportError(OSError):
    pass


def quoted(value: str, delimiter: str = ",", every: bool = False) -> str:
    edge = delimiter == " " and value != value.strip(" ")
    return '"' + value.replace('"', '""') + '"' if every or edge or any(c in value for c in (delimiter, '"', "\r", "\n")) else value


def format_record(values: list[str | None], delimiter: str = ",", every: bool = False) -> str:
    """One line without its end. A single empty field is written in quotes: a blank line would be no record."""
    if len(values) == 1 and not values[0]:
        return '""'
    return delimiter.join(quoted(v or "", delimiter, every) for v in values)


def _field(t: Column, delimiter: str, every: bool) -> Column:
    t = F.coalesce(t, F.lit(""))
    wrapped = F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))
    if every:
        return wrapped
    needs = t.rlike(f'[{literal_regex(delimiter)}"\r\n]')
    if delimiter == " ":
        needs = needs | t.startswith(" ") | t.endswith(" ")
    return F.when(needs, wrapped).otherwise(t)


def line(source, columns: list[ColumnMeta], delimiter: str = ",", every: bool = False) -> Column:
    parts = [_field(source.text(c), delimiter, every) for c in columns]
    return F.when(parts[0] == "", '""').otherwise(parts[0]) if len(parts) == 1 else F.concat_ws(delimiter, *parts)


def lines(view: View, which: str = "visible", delimiter: str = ",", every: bool = False) -> DataFrame:
    """(line): the view's records, in its order."""
    chosen = view.source.visible() if which == "visible" else view.source.all_columns()
    return view.rows().select(line(view.source, chosen, delimiter, every).alias("line"))


def check_target(path: str, source_path: str | None) -> None:
    """ExportError for the source itself by any name, for folders, and for places that can't be written."""
    if source_path and os.path.exists(path) and os.path.exists(source_path) and os.path.samefile(path, source_path):
        raise ExportError(f"{path} is the file being read")
    if os.path.isdir(path):
        raise ExportError(f"{path} is a folder")
    folder = os.path.dirname(os.path.abspath(path))
    if not os.path.isdir(folder):
        raise ExportError(f"{folder} does not exist")
    if not os.access(folder, os.W_OK) or (os.path.exists(path) and not os.access(path, os.W_OK)):
        raise ExportError(f"{path} can't be written")


def default_target(view: View) -> str:
    stem = Path(view.source.path).stem if view.source.path and view.source.path != "-" else "stdin"
    return f"{stem}.{view.label.replace(' ', '-')}.csv"


def export(view: View, path: str, which: str = "visible", delimiter: str = ",", every: bool = False, header: bool = True) -> int:
    """Write one file; returns its records. The driver holds one partition at a time."""
    check_target(path, view.source.path)
    chosen = view.source.visible() if which == "visible" else view.source.all_columns()
    part, n = f"{path}.partial", 0
    try:
        with open(part, "w", encoding="utf-8", newline="") as f:
            if header:
                f.write(format_record([c.display for c in chosen], delimiter, every) + "\n")
            for row in lines(view, which, delimiter, every).toLocalIterator(prefetchPartitions=True):
                f.write(row[0] + "\n")
                n += 1
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise
    return n


def export_parts(view: View, path: str, which: str = "visible", delimiter: str = ",", every: bool = False) -> None:
    """Write a folder of part files, each a range of the view's order: for results that one machine can't write."""
    lines(view, which, delimiter, every).write.option("lineSep", "\n").text(path)


def copy_cell(view: View, row_id: int, column: str) -> str:
    r = view.source.df.where(F.col("_row_id") == row_id).select(view.source.text(view.source.column(column))).first()
    return (r[0] if r else "") or ""


def copy_row(view: View, row_id: int) -> str:
    """The row as stored: the file's columns and delimiter."""
    chosen = view.source.all_columns()
    r = view.source.df.where(F.col("_row_id") == row_id).select(*(F.col(f"`{c.field}`").cast("string") for c in chosen)).first()
    d = view.source.dialect.delimiter if view.source.dialect else ","
    return format_record(list(r), d) if r else ""
