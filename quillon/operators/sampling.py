"""Samples and type inference: the first rows and as many spread over the rest, all columns in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import values
from quillon.operators.tables import kept

HEAD = SPREAD = 10_000
ENUM_MOST = 64


def spread_ids(rows: int, head: int = HEAD, spread: int = SPREAD) -> list[int]:
    """Evenly spaced ids behind the head, none twice."""
    rest = rows - head
    return [] if rest <= 0 else sorted({head + k * rest // spread for k in range(spread)})


def in_sample(row: Column, rows: int, head: int = HEAD, spread: int = SPREAD) -> Column:
    """Whether a row is in the sample, by arithmetic on its id: a list of ids would not scale."""
    rest = rows - head
    if rest <= 0:
        return F.lit(True)
    if rest <= spread:
        return F.lit(True)
    x = row - head  # id head + k * rest div spread for some k: the least k that reaches x lands on it
    k = F.ceil(x * spread / F.lit(float(rest))).cast("long")
    on = F.expr("false")
    for near in (-1, 0, 1):
        on = on | ((F.floor((k + near) * F.lit(rest) / F.lit(spread)) == x) & (k + near >= 0) & (k + near < spread))
    return (row < head) | on


def sample(source, head: int = HEAD, spread: int = SPREAD) -> DataFrame:
    from quillon.sources.source import ROW

    if source.sampled is not None and (head, spread) == (HEAD, SPREAD):
        return source.sampled
    rows = source.scan.rows if source.scan else source.df.count()
    return source.df.where(in_sample(F.col(ROW), rows, head, spread))


@dataclass(frozen=True)
class SampleResult:
    """A source's sample, read once: after an edit or another type, its statistics come from the rows it holds."""

    source: object

    @staticmethod
    def of(source) -> SampleResult:
        return SampleResult(source if source.sampled is not None else replace(source, sampled=kept(sample(source))))

    def stats(self, *columns: str) -> list:
        """Exact statistics of the sampled rows, as the source now edits and reads them."""
        from quillon.operators.profile import profile

        return profile(self.source, list(columns) or None, full=False)

    def set_type(self, name: str, label: str) -> SampleResult:
        return SampleResult(self.source.set_type(name, label))

    def edit(self, name: str, text: str) -> SampleResult:
        return SampleResult(self.source.edit(name, text))


def infer_types(source, fields: list[str] | None = None) -> dict[str, str]:
    """{field: label}: the first type that reads 99 % of a column's sampled values that aren't null; an enum is text of
    2 to 64 distinct values that are at most half of them."""
    chosen = [c for c in source.columns if (fields is None or c.field in fields) and (c.native is None or values.is_string(c.native))]
    if not chosen:
        return {}
    aggs = []
    for c in chosen:
        cell = source.cell(c)
        live = F.when(~cell.is_null, cell.text)
        aggs.append(F.count(live).alias(f"{c.field}|n"))
        aggs += [F.count(values.recognise(live, t)).alias(f"{c.field}|{t}") for t in ("bool", "i64", "f64", "date", "datetime")]
        aggs.append(F.count_distinct(live).alias(f"{c.field}|distinct"))
    found = sample(source).agg(*aggs).first().asDict()
    out = {}
    for c in chosen:
        n, distinct = found[f"{c.field}|n"], found[f"{c.field}|distinct"]
        label = next((t for t in ("bool", "i64", "f64", "date", "datetime") if n and found[f"{c.field}|{t}"] * 100 >= n * 99), None)
        out[c.field] = label or ("enum" if 2 <= distinct <= ENUM_MOST and 2 * distinct <= n else "str")
    return out
