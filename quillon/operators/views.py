"""Views: a source's rows, filtered, sorted and deduplicated in any order, all lazy.

A view is a DataFrame with row ids and an order: keys, then the row id. Filters and duplicates keep their parent's
order; a sort replaces it, and its ties go by the row id in the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillon.operators.tables import kept
from quillon.plans.compiler import Predicate
from quillon.plans.names import match_column
from quillon.sources.source import ROW, WIDTH, ColumnMeta, Source

POS = "_pos"


class SortError(ValueError):
    def __init__(self, message: str, start: int, end: int):
        super().__init__(message)
        self.message, self.span = message, (start, end)


@dataclass(frozen=True)
class SortKey:
    column: ColumnMeta
    descending: bool = False
    ci: bool = False

    def __str__(self) -> str:
        name = f"`{self.column.query}`" if any(c in self.column.query for c in ",:` ") else self.column.query
        return name + ":desc" * self.descending + ":ci" * self.ci


def split_keys(text: str) -> list[tuple[str, int]]:
    """Comma-separated parts with their places; backticks hide commas and colons."""
    out, start, quoted = [], 0, False
    for i, c in enumerate(text + ","):
        if c == "`":
            quoted = not quoted
        elif c == "," and not quoted or i == len(text):
            out.append((text[start:i], start))
            start = i + 1
    return out


def parse_sort(text: str, source: Source) -> list[SortKey]:
    """``price:desc, name:asc:ci, ts``."""
    out = []
    for part, start in split_keys(text):
        lead = len(part) - len(part.lstrip())
        word, at = part.strip(), start + lead
        end = at + len(word)
        if not word:
            raise SortError("a column is missing", start, start + len(part))
        if word[0] == "`":
            close = word.find("`", 1)
            if close < 0:
                raise SortError("this backtick has no partner", at, end)
            name, flags = word[1:close], word[close + 1 :]
        else:
            name, _, flags = word.partition(":")
            flags = ":" + flags if flags else ""
        words = [f.strip() for f in flags.split(":")[1:]] if flags else []
        descending, ci = False, False
        for k, f in enumerate(words):
            if f in ("asc", "desc") and k == 0:
                descending = f == "desc"
            elif f == "ci" and not ci:
                ci = True
            else:
                raise SortError(f"{f} is no way to sort (asc, desc, ci)", at, end)
        found = [c for c in source.columns if name.strip() in (c.query, c.display)]
        if not found and name[:1] == "$" and name[1:].isdigit() and 0 < int(name[1:]) <= len(source.columns):
            found = [source.columns[int(name[1:]) - 1]]
        if not found:
            raise SortError(f"no column is called {name}", at, end)
        if ci and found[0].label not in ("str", "enum"):
            raise SortError(f"only text sorts by ci, and {name} is {found[0].label}", at, end)
        out.append(SortKey(found[0], descending, ci))
    return out


@dataclass(frozen=True)
class View:
    source: Source
    df: DataFrame
    order: tuple[tuple[Column, bool], ...] = ()  # (key, descending); the row id comes last
    label: str = "all rows"
    parent: View | None = None
    keys: tuple[SortKey, ...] = ()
    predicates: tuple[Predicate, ...] = field(default=())

    @staticmethod
    def all(source: Source) -> View:
        return View(source, source.df)

    @property
    def ordered(self) -> bool:
        return bool(self.order)

    def ordering(self) -> list[Column]:
        """Null, missing and unreadable values last in both directions; ties by the file's row id."""
        return [k.desc_nulls_last() if d else k.asc_nulls_last() for k, d in self.order] + [F.col(ROW).asc()]

    def filter(self, text: str) -> View:
        p = self.source.filter(text)
        return replace(self, df=self.df.where(p.column), label="filtered", parent=self, predicates=(*self.predicates, p))

    def sort(self, text: str) -> View:
        keys = parse_sort(text, self.source)
        order = []
        for k in keys:
            v = self.source.value(k.column)
            order.append((F.lower(v) if k.ci else v, k.descending))
        return replace(self, order=tuple(order), keys=tuple(keys), label="sorted", parent=self)

    def _key(self, text: str | None) -> list[Column]:
        """A missing value equals an empty one; null spellings stay apart; a column named twice counts once. Without
        columns: all fields, and how many there are."""
        named = [n.strip().strip("`") for n, _ in split_keys(text)] if text else []
        if named:
            at = dict.fromkeys(match_column(n, self.source.names) for n in named)
            return [F.coalesce(self.source.text(self.source.columns[i]), F.lit("")) for i in at]
        return [F.coalesce(self.source.text(c), F.lit("")) for c in self.source.columns] + [F.greatest(F.col(WIDTH), F.lit(self.source.header_width))]

    def _keyed(self, text: str | None) -> tuple[DataFrame, list[str]]:
        key = self._key(text)
        return self.df.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(key))), [f"_k{i}" for i in range(len(key))]

    def dupes(self, columns: str | None = None) -> View:
        """Every row whose key occurs more than once. Counts are combined before the shuffle, so a key that most rows
        share costs one row a task; rows come back by a semi-join, whose skew the adaptive plan splits."""
        keyed, names = self._keyed(columns)
        several = keyed.groupBy(names).count().where("count > 1").drop("count")
        return replace(self, df=keyed.join(several, names, "left_semi").select(*self.df.columns), label="duplicates", parent=self)

    def dedupe(self, columns: str | None = None) -> View:
        """The first row of each key in the view's order. Each task keeps one row a key before the shuffle (Spark's limit
        of ranked groups), so a key that most rows share costs one row a task."""
        keyed, names = self._keyed(columns)
        first = F.row_number().over(Window.partitionBy(names).orderBy(*self.ordering()))
        df = keyed.withColumn("_n", first).where("_n = 1").select(*self.df.columns)
        return replace(self, df=df, label="deduplicated", parent=self)

    def dupes_summary(self, columns: str | None = None) -> DataFrame:
        """(groups, rows, removed): keys with several rows, the view's rows, and those that dedupe takes out."""
        keyed, names = self._keyed(columns)
        n = F.col("count")
        return keyed.groupBy(names).count().agg(F.count_if(n > 1).alias("groups"), F.coalesce(F.sum(n), F.lit(0)).alias("rows"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("removed"))

    # reading -----------------------------------------------------------------------------------------------------

    def select(self, which: str = "visible") -> DataFrame:
        """The row id and the columns' texts as edited, under their query names; rows are not in order."""
        chosen = self.source.visible() if which == "visible" else self.source.all_columns()
        return self.df.select(ROW, *(self.source.text(c).alias(c.query) for c in chosen))

    def rows(self) -> DataFrame:
        return self.df.orderBy(*self.ordering())

    def window(self, first: int, count: int) -> DataFrame:
        """Rows first .. first + count of the view, in order."""
        ordered = self.df.orderBy(*self.ordering())
        return (ordered.offset(first) if first else ordered).limit(count)

    def numbered(self, *columns: str | Column) -> DataFrame:
        """(_pos, _row_id, columns): the view's rows numbered from 0. Sorted by ranges, with the wanted columns along, and
        numbered by each range's count, so no task sees all rows and nothing is joined back; the driver gets a number a
        range."""
        ids = self.df.select(ROW, *columns, *(k.alias(f"_o{i}") for i, (k, _) in enumerate(self.order)))
        wanted = [c for c in ids.columns if not c.startswith("_o")]
        by = [F.col(f"_o{i}").desc_nulls_last() if d else F.col(f"_o{i}").asc_nulls_last() for i, (_, d) in enumerate(self.order)]
        ranged = kept(ids.orderBy(*by, ROW).select(*wanted, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
        base, bases = 0, {"_p": [], "_add": []}
        for p, n, first in ranged.groupBy("_p").agg(F.count("*"), F.min("_m")).orderBy("_p").collect():
            bases["_p"].append(p)
            bases["_add"].append(base - first)
            base += n
        known = self.df.sparkSession.createDataFrame(pa.table(bases, pa.schema([("_p", pa.int32()), ("_add", pa.int64())])))  # a row a range
        return ranged.join(F.broadcast(known), "_p").select((F.col("_m") + F.col("_add")).alias(POS), *wanted)

    def positions(self) -> DataFrame:
        """(_pos, _row_id): the view's rows numbered from 0."""
        return self.numbered()

    def matches(self) -> Iterator[Row]:
        """The rows as they are found, in the view's order: a filter's first matches show before the last is known. A
        filter alone is read partition by partition; the driver holds one at a time."""
        ordered = self.df.orderBy(*self.ordering()) if self.order or not self.source.in_file_order else self.df
        return ordered.toLocalIterator(prefetchPartitions=True)

    def key_of(self, row_id: int) -> list | None:
        """A row's sort keys and its id; None if it isn't in the view."""
        found = self.df.where(F.col(ROW) == row_id).select(*(k.alias(f"_o{i}") for i, (k, _) in enumerate(self.order)), ROW).first()
        return None if found is None else list(found)

    def before(self, key: list, ties: bool = True) -> Column:
        """Whether a row stands before the one of this key; without ``ties``, by the sort keys alone."""
        out, tied = F.lit(False), F.lit(True)
        for (k, descending), v in zip(self.order, key, strict=False):
            if v is None:
                ahead, tie = k.isNotNull(), k.isNull()
            else:
                v = F.lit(v).cast(self.df.select(k.alias("k")).schema[0].dataType)
                ahead, tie = F.coalesce(k > v if descending else k < v, F.lit(False)), F.coalesce(k == v, F.lit(False))
            out, tied = out | (tied & ahead), tied & tie
        return out | (tied & (F.col(ROW) < key[-1])) if ties else out

    def position_of(self, row_id: int, ties: bool = True) -> int | None:
        """Where a row stands, None if it isn't in the view: the count of the rows before it. Without ``ties``, where the
        first row of equal sort keys stands."""
        key = self.key_of(row_id)
        return None if key is None else self.df.where(self.before(key, ties)).count()

    def row_at(self, pos: int) -> int | None:
        found = self.window(pos, 1).select(ROW).first()
        return found[0] if found else None

    def fetch(self, row_ids: list[int]) -> list:
        """Rows by id, in the order asked for."""
        found = {r[ROW]: r for r in self.df.where(F.col(ROW).isin(row_ids)).collect()}
        return [found.get(i) for i in row_ids]

    def goto(self, text: str) -> int:
        """``120`` (from 1), ``1_234``, ``50%``: the position."""
        text = text.strip().replace("_", "").replace(",", "")
        n = self.df.count()
        pos = int(float(text[:-1]) / 100 * (n - 1)) if text.endswith("%") else int(text) - 1
        return max(0, min(pos, n - 1))

    def sort_by(self, column: str, descending: bool = False) -> View:
        """A sort by one column."""
        return self.sort(f"`{self.source.column(column).query}`" + ":desc" * descending)

    def sort_cost(self, free_bytes: int) -> dict[str, int | bool]:
        """What a sort of this view takes: 24 bytes a row for keys, 8 for the result; whether that fits three quarters
        of the memory given, or runs spill."""
        n = self.df.count()
        return {"rows": n, "run_bytes": 24 * n, "result_bytes": 8 * n, "in_memory": 24 * n <= 0.75 * free_bytes}

    def indicator(self) -> dict[str, str]:
        """What the header shows by sorted columns."""
        return {k.column.display: ("▼" if k.descending else "▲") + str(i) for i, k in enumerate(self.keys, 1)}


class ViewStack:
    """Views on views; the first shows all rows."""

    def __init__(self, source: Source):
        self.views = [View.all(source)]

    @property
    def active(self) -> View:
        return self.views[-1]

    def push(self, view: View) -> View:
        self.views.append(view)
        return view

    def filter(self, text: str) -> View:
        return self.push(self.active.filter(text))

    def sort(self, text: str) -> View:
        return self.push(self.active.sort(text))

    def dupes(self, columns: str | None = None) -> View:
        return self.push(self.active.dupes(columns))

    def dedupe(self, columns: str | None = None) -> View:
        return self.push(self.active.dedupe(columns))

    def pop(self) -> View:
        if len(self.views) > 1:
            self.views.pop()
        return self.active

    def rebase(self, source: Source) -> None:
        """New edits or types: existing views keep their rows (their plans hold the old expressions) and show the new
        values; what is pushed from now on reads the new ones."""
        self.views = [replace(v, source=source) for v in self.views]


def open_view(spark, path: str, filter: str | None = None, sort: str | None = None, **options) -> ViewStack:
    """Open a file with a first filter, then a first sort."""
    stack = ViewStack(Source.open(spark, path, **options))
    if filter:
        stack.filter(filter)
    if sort:
        stack.sort(sort)
    return stack
