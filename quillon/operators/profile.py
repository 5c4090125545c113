"""Column profiles: exact ones of a sample, or sketched ones of all rows, all statistics of all columns in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import display_width
from quillon.operators.sampling import sample
from quillon.sources.source import ColumnMeta, Source

TOP, KEY_BYTES, PRECISION, KLL = 5, 256, 14, 200


def top_key(t: Column) -> Column:
    """A value as it is counted: cut to 256 bytes, with an ellipsis."""
    cut = F.make_valid_utf8(F.substring(t.cast("binary"), 1, KEY_BYTES).cast("string"))
    return F.when(F.octet_length(t) > KEY_BYTES, F.concat(cut, F.lit("…"))).otherwise(t)


@dataclass
class ColumnStats:
    column: str
    type: str
    label: str
    rows_seen: int
    nulls: int
    distinct: int
    min: object
    max: object
    mean: float | None
    p50: float | None
    p95: float | None
    max_width: int | None
    top5: list[tuple[str, int]]

    @property
    def non_null(self) -> int:
        return self.rows_seen - self.nulls

    @property
    def null_percent(self) -> float:
        return 100 * self.nulls / self.rows_seen if self.rows_seen else 0.0

    @property
    def other(self) -> int:
        return max(0, self.non_null - sum(n for _, n in self.top5))


def _parts(source: Source, c: ColumnMeta) -> tuple[Column, Column, Column]:
    cell = source.cell(c)
    live = F.when(~cell.is_null, cell.text)
    return live, source.value(c), cell.is_null


def counts(source: Source, c: ColumnMeta) -> dict[str, Column]:
    """Aggregates: rows, nulls, and of the readable values least, greatest and mean (of numbers and times)."""
    live, v, null = _parts(source, c)
    out = {"rows_seen": F.count("*"), "nulls": F.count_if(null), "non_null": F.count(live)}
    if c.label in ("i64", "f64", "date", "datetime"):
        out |= {"min": F.min(v), "max": F.max(v)}
    if c.label in ("i64", "f64"):
        out["mean"] = F.sum(v.cast("decimal(38,0)")).cast("double") / F.count(v) if c.label == "i64" else F.avg(v)
    return out


def exact(source: Source, c: ColumnMeta) -> dict[str, Column]:
    live, v, _ = _parts(source, c)
    out = counts(source, c) | {"distinct": F.count_distinct(live)}
    if c.label in ("i64", "f64"):
        both = F.percentile(v.cast("double"), F.array(F.lit(0.5), F.lit(0.95)))
        out |= {"p50": F.get(both, F.lit(0)), "p95": F.get(both, F.lit(1))}
    return out


def sketched(source: Source, c: ColumnMeta) -> dict[str, Column]:
    """Mergeable sketches: HyperLogLog for distinct values, KLL for quantiles."""
    live, v, _ = _parts(source, c)
    out = counts(source, c) | {"distinct": F.hll_sketch_estimate(F.hll_sketch_agg(live, F.lit(PRECISION)))}
    if c.label in ("i64", "f64"):
        sketch = F.kll_sketch_agg_double(v.cast("double"), F.lit(KLL))
        out |= {"p50": F.kll_sketch_get_quantile_double(sketch, F.lit(0.5)), "p95": F.kll_sketch_get_quantile_double(sketch, F.lit(0.95))}
    return out


def top5(source: Source, df: DataFrame, c: ColumnMeta) -> DataFrame:
    """(value, n): the most frequent values, exactly; ties by the value."""
    live, _, _ = _parts(source, c)
    return df.select(top_key(live).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(TOP)


def top_sketch(source: Source, df: DataFrame, c: ColumnMeta, capacity: int = 1024) -> DataFrame:
    """(value, n, max_overcount): the most frequent values by a mergeable sketch of ``capacity`` counters, in one pass and
    fixed memory. A value's true count is at most n and at least n - max_overcount. The sketch keeps up to three quarters
    of its table (a power of two); its counts exceed the true ones by at most 3.5 / table of the rows."""
    live, _, _ = _parts(source, c)
    table = 1 << (-(-4 * capacity // 3) - 1).bit_length()
    key = top_key(live)
    sketch = df.where(key.isNotNull()).select(key.alias("v")).agg(F.expr(f"approx_top_k(v, {TOP}, {capacity})").alias("t"), F.count("*").alias("rows"))
    over = F.ceil(F.col("rows") * 3.5 / table).cast("long")
    return sketch.select(F.explode("t").alias("t"), over.alias("max_overcount")).select(F.col("t.item").alias("value"), F.col("t.count").alias("n"), "max_overcount")


def widest(source: Source, c: ColumnMeta) -> Column:
    live, _, _ = _parts(source, c)
    return F.least(F.max(display_width(live)), F.lit(65535))


def width_p95(source: Source, df: DataFrame, c: ColumnMeta) -> int:
    """The width that 95 % of the values keep within; nulls have none, over 255 counts as 256."""
    live, _, _ = _parts(source, c)
    return df.select(F.least(F.coalesce(display_width(live), F.lit(0)), F.lit(256)).alias("w")).agg(F.expr("percentile_disc(0.95) within group (order by w)")).first()[0] or 0


def top5_of(source: Source, df: DataFrame, columns: list[ColumnMeta]) -> DataFrame:
    """(slot, value, n): the most frequent values of each column, by its slot, in one pass."""
    cells = F.array_compact(F.array(*(F.when(k.isNotNull(), F.struct(F.lit(i).alias("slot"), k.alias("value"))) for i, c in enumerate(columns) for k in [top_key(_parts(source, c)[0])])))
    n = df.select(F.explode(cells).alias("c")).groupBy("c.slot", "c.value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n"), "value"))  # limited to five a task before the shuffle
    return n.withColumn("_place", place).where(F.col("_place") <= TOP).drop("_place")


def profile(source: Source, columns: list[str] | None = None, full: bool = True, sketches: bool = True) -> list[ColumnStats]:
    """Profiles of the named columns (all: None), of all rows or of the sample; never of a view. Two jobs, whatever the
    number of columns: one aggregate of all, one count of all values."""
    chosen = [source.column(n) for n in columns] if columns else list(source.columns)
    df = source.df if full else sample(source)
    aggs, at = [], {}
    for c in chosen:
        for name, a in ((sketched if full and sketches else exact)(source, c) | {"width": widest(source, c)}).items():
            at[c.field, name] = len(aggs)
            aggs.append(a)
    row = df.agg(*(a.alias(f"a{i}") for i, a in enumerate(aggs))).first()
    tops: dict[int, list] = {}
    for slot, value, n in top5_of(source, df, chosen).orderBy("slot", F.desc("n"), "value").collect():
        tops.setdefault(slot, []).append((value, n))
    out = []
    for i, c in enumerate(chosen):
        get = lambda name, c=c: row[at[c.field, name]] if (c.field, name) in at else None
        label = "all rows" if full else f"sample {row[at[c.field, 'rows_seen']]} rows"
        out.append(ColumnStats(c.query, c.label, label, get("rows_seen"), get("nulls"), get("distinct"), get("min"), get("max"), get("mean"), get("p50"), get("p95"), get("width"), tops.get(i, [])))
    return out


def stale(stats: ColumnStats, source: Source) -> bool:
    """Whether a profile was made for another type of its column than the source now reads it by."""
    return source.column(stats.column).label != stats.type
