"""An opened table: a DataFrame with row ids, how its columns are named and read, and the edits on them."""

from __future__ import annotations

import codecs
import os
import stat
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import edits, values
from quillon.operators.tables import kept, shared_folder
from quillon.plans.compiler import Cell, Predicate, compile_filter
from quillon.plans.names import column_names, match_column
from quillon.sources import dialect as dialects
from quillon.sources import dsv
from quillon.sources.dialect import CODECS, SAMPLE, Dialect, Overrides, SniffReport

ROW, WIDTH = "_row_id", "_n_fields"


class SourceError(OSError):
    """kind: NotFound, PermissionDenied, IsDirectory, NotRegular or Io."""

    def __init__(self, kind: str, path: str):
        super().__init__(f"{kind}: {path}")
        self.kind, self.path = kind, path


@dataclass(frozen=True)
class ColumnMeta:
    display: str
    query: str
    field: str  # physical column
    native: str | None = None  # type label of a typed table's column
    inferred: str = "str"
    override: str | None = None
    synthetic: bool = False
    hidden: bool = False

    @property
    def label(self) -> str:
        return self.override or self.inferred


@dataclass(frozen=True)
class Source:
    """Immutable: a change of types, edits or columns gives another Source over the same DataFrame."""

    df: DataFrame
    columns: tuple[ColumnMeta, ...]
    path: str | None = None
    dialect: Dialect | None = None
    report: SniffReport | None = None
    scan: dsv.Scan | None = None
    header_width: int = 0
    nulls: tuple[str, ...] = values.NULLS
    edits: dict[str, tuple[edits.Op, ...]] = field(default_factory=dict)
    overrides: Overrides = Overrides()
    sampled: DataFrame | None = None  # the sample's rows, kept for types and statistics

    # opening -----------------------------------------------------------------------------------------------------

    @staticmethod
    def open(spark: SparkSession, path: str, overrides: Overrides = Overrides(), sample_bytes: int = SAMPLE, nulls: tuple[str, ...] = values.NULLS, strict: bool = True, infer: bool = True) -> Source:
        """A delimited file (``-``: standard input, spooled). ``strict=False`` reads clean files by Spark's own reader."""
        if path == "-":
            path = spool(sys.stdin.buffer, shared_folder(spark))
        local = check_path(path)
        data = head(spark, path, local, sample_bytes + dialects.EXTENSION)
        report = dialects.sniff(data, sample_bytes, overrides)
        d = report.dialect
        read = path
        if d.encoding in ("utf-16le", "utf-16be"):
            read = transcode(spark, path, local, d.encoding)
            d = replace(d, encoding="utf-8")
        if not strict and d.quote in (None, '"') and d.escape == "doubled" and d.encoding == "utf-8":
            return Source._native(spark, read, d, report, nulls)
        rows, scan = dsv.read_records(spark, read, d, multiline=report.quoted_newlines or None)
        first = rows.where("row = 0").select("fields").first()
        names = list(first[0]) if first else []
        width = max(scan.width, len(names))
        metas = [ColumnMeta(a, b, f"f{i}") for i, (a, b) in enumerate(column_names(names if d.header else len(names)))]
        metas += [ColumnMeta(f"_extra{k + 1}", f"_extra{k + 1}", f"f{len(names) + k}", synthetic=True) for k in range(width - len(names))]
        body = rows.where("row > 0").withColumn("row", F.col("row") - 1) if d.header else rows
        df = body.select(F.col("row").alias(ROW), F.size("fields").alias(WIDTH), *(F.get("fields", F.lit(i)).alias(f"f{i}") for i in range(width)))
        out = Source(df, tuple(metas), path, report.dialect, report, replace(scan, rows=max(scan.rows - (d.header and scan.rows > 0), 0)), len(names), nulls, overrides=overrides)
        return out.with_inferred_types() if infer else out

    @staticmethod
    def _native(spark: SparkSession, path: str, d: Dialect, report: SniffReport, nulls: tuple[str, ...]) -> Source:
        raw = spark.read.csv(path, sep=d.delimiter, quote=d.quote or "", escape=d.quote or "", header=d.header, comment=d.comment or None, multiLine=report.quoted_newlines)
        metas = tuple(ColumnMeta(a, b, c) for (a, b), c in zip(column_names(raw.columns), raw.columns, strict=True))
        df = raw.select(F.monotonically_increasing_id().alias(ROW), F.lit(len(metas)).alias(WIDTH), *raw.columns)
        return Source(df, metas, path, report.dialect, report, None, len(metas), nulls)

    @staticmethod
    def from_dataframe(df: DataFrame, row_id: str | Column | None = None, nulls: tuple[str, ...] = values.NULLS) -> Source:
        """A typed table. ``row_id`` names the rows and their order. Without it they take Spark's rising ids: in order,
        unique, not contiguous, and the same in every plan that reads the same partitions. No operator joins a table to
        itself on them, but for ids that outlive a plan (``fetch``) give a column."""
        number = F.monotonically_increasing_id() if row_id is None else F.col(row_id) if isinstance(row_id, str) else row_id
        df = df if ROW not in df.columns else df.withColumnRenamed(ROW, "_number")
        number = F.col("_number") if isinstance(row_id, str) and row_id == ROW else number
        shown = [(c, k) for c, k in df.dtypes if c != "_number"]
        metas = []
        for (a, b), (name, kind) in zip(column_names([c for c, _ in shown]), shown, strict=True):
            label = values.type_of_spark(kind)
            metas.append(ColumnMeta(a, b, name, label, label))
        out = df.select(number.cast("long").alias(ROW), F.lit(len(metas)).alias(WIDTH), *(F.col(f"`{c}`") for c, _ in shown))
        return Source(out, tuple(metas), header_width=len(metas), nulls=nulls)

    @staticmethod
    def parquet(spark: SparkSession, path: str, row_id: str | None = None, nulls: tuple[str, ...] = values.NULLS) -> Source:
        """A Parquet table. Without a column that names its rows (``row_id``), they are numbered by their place: files in
        the order of their paths, rows in the order of each file."""
        df = spark.read.parquet(path)
        if row_id:
            return Source.from_dataframe(df, row_id, nulls)
        at = F.col("_metadata.row_index")
        if len(df.inputFiles()) < 2:
            return Source.from_dataframe(df, at, nulls)
        files = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("n")).orderBy("_file").collect()  # a row a file, as the driver lists them
        starts = pa.table({"_at": [f["_file"] for f in files], "_first": np.cumsum([0, *(f["n"] for f in files[:-1])])})
        known = spark.createDataFrame(starts).select(F.xxhash64("_at").alias("_at"), F.col("_first").cast("long"))
        known = F.broadcast(known) if len(files) <= 1_000_000 else known  # 16 bytes a file
        placed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), at.alias("_index"), F.xxhash64("_metadata.file_path").alias("_at"))
        numbered = placed.join(known, "_at").select("_row.*", (F.col("_first") + F.col("_index")).alias(ROW))
        return Source.from_dataframe(numbered.select(*df.columns, ROW), ROW, nulls)

    # columns -----------------------------------------------------------------------------------------------------

    @property
    def in_file_order(self) -> bool:
        """Whether the partitions of ``df`` come in the order of the row ids by themselves."""
        return self.scan is not None and self.scan.strategy == "lines"

    @property
    def names(self) -> list[tuple[str, str]]:
        return [(c.display, c.query) for c in self.columns]

    def column(self, name: str) -> ColumnMeta:
        return self.columns[match_column(name, self.names)]

    def cell(self, c: ColumnMeta) -> Cell:
        """How a column is read: edits, null spellings, type."""
        raw, ops = F.col(f"`{c.field}`"), self.edits.get(c.field, ())
        typed = c.native is not None and not values.is_string(c.native)
        text = raw.cast("string") if typed else raw
        if ops:
            text = edits.apply(text, ops, text.isNull() | text.isin(*self.nulls))
        elif typed and c.label == c.native:
            return Cell(c.label, c.query, text, raw.isNull(), (), raw)
        return Cell(c.label, c.query, text, text.isNull() | text.isin(*self.nulls), self.nulls)

    def cells(self) -> list[Cell]:
        return [self.cell(c) for c in self.columns]

    def text(self, c: ColumnMeta) -> Column:
        return self.cell(c).text

    def value(self, c: ColumnMeta) -> Column:
        """The typed value; null for null, missing and unreadable."""
        cell = self.cell(c)
        return cell.value() if cell.native is not None else F.when(~cell.is_null, cell.value())

    def filter(self, text: str) -> Predicate:
        return compile_filter(text, self.names, self.cells())

    def _changed(self, name: str, **changes) -> Source:
        at = match_column(name, self.names)
        return replace(self, columns=tuple(replace(c, **changes) if i == at else c for i, c in enumerate(self.columns)))

    def set_type(self, name: str, label: str) -> Source:
        """Changes only how the column is read; ``auto`` goes back to the inferred type."""
        if label != "auto" and label not in values.TYPES:
            raise ValueError(f"unknown type {label} ({', '.join(values.TYPES)}, auto)")
        return self._changed(name, override=None if label == "auto" else label)

    def hide(self, name: str, hidden: bool = True) -> Source:
        return self._changed(name, hidden=hidden)

    def reorder(self, order: list[str]) -> Source:
        """These columns first, in this order, then the others."""
        at = [match_column(n, self.names) for n in order]
        return replace(self, columns=tuple(self.columns[i] for i in [*at, *(i for i in range(len(self.columns)) if i not in at)]))

    def visible(self) -> list[ColumnMeta]:
        return [c for c in self.columns if not c.hidden]

    def all_columns(self) -> list[ColumnMeta]:
        """In the file's order."""
        order = {f: i for i, f in enumerate(self.df.columns)}
        return sorted(self.columns, key=lambda c: order[c.field])

    # edits -------------------------------------------------------------------------------------------------------

    def edit(self, name: str, text: str) -> Source:
        """Appends operations to a column's chain; ``undo`` takes the last off, ``reset`` all. Types are inferred anew
        for columns of a file; a typed table's column is text while it's edited, of whatever type is set."""
        c = self.column(name)
        chain = self.edits.get(c.field, ())
        word = text.strip()
        chain = chain[:-1] if word == "undo" else () if word == "reset" else (*chain, *edits.parse_ops(text))
        changed = {k: v for k, v in {**self.edits, c.field: chain}.items() if v}
        label = c.native if c.native is not None and not chain else "str" if c.native is not None else c.inferred
        out = replace(self, edits=changed)._changed(c.display, inferred=label)
        return out if c.native is not None else out.with_inferred_types([c.field])

    def reset_edits(self) -> Source:
        out = self
        for c in self.columns:
            if c.field in self.edits:
                out = out.edit(c.display, "reset")
        return out

    def with_inferred_types(self, fields: list[str] | None = None) -> Source:
        from quillon.operators.sampling import infer_types, sample

        held = self if self.sampled is not None or self.scan is None else replace(self, sampled=kept(sample(self)))
        labels = infer_types(held, fields)
        return replace(held, columns=tuple(replace(c, inferred=labels.get(c.field, c.inferred)) for c in self.columns))

    def reopen(self, spark: SparkSession) -> Source:
        """The file as it now is: dialect, rows, counts and types found anew."""
        spark.catalog.refreshByPath(self.path)
        return Source.open(spark, self.path, self.overrides, nulls=self.nulls)

    def with_dialect(self, spark: SparkSession, overrides: Overrides) -> Source:
        return Source.open(spark, self.path, overrides, nulls=self.nulls)

    # facts -------------------------------------------------------------------------------------------------------

    def counts(self) -> dict[str, int | bool]:
        """rows, ragged rows, and whether the file ends inside quotes."""
        n, ragged = self.df.agg(F.count("*"), F.count_if(F.col(WIDTH) != self.header_width)).first()
        return {"rows": n, "ragged": ragged, "unterminated": bool(self.scan and self.scan.unterminated)}


def check_path(path: str) -> str | None:
    """The local path of a path on this machine (None for other stores); SourceError if it can't be read."""
    if "://" in path and not path.startswith("file:"):
        return None
    local = path.removeprefix("file://").removeprefix("file:")
    try:
        mode = os.stat(local).st_mode
    except FileNotFoundError:
        raise SourceError("NotFound", path) from None
    except PermissionError:
        raise SourceError("PermissionDenied", path) from None
    except OSError as e:
        raise SourceError("Io", f"{path}: {e}") from None
    if stat.S_ISDIR(mode):
        raise SourceError("IsDirectory", path)
    if not stat.S_ISREG(mode):
        raise SourceError("NotRegular", path)
    if not os.access(local, os.R_OK):
        raise SourceError("PermissionDenied", path)
    return local


def chunks(spark: SparkSession, path: str, local: str | None, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, through Spark's file system where it isn't local."""
    if local:
        with open(local, "rb") as f:
            while data := f.read(size):
                yield data
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        while data := bytes(stream.readNBytes(size)):
            yield data
    finally:
        stream.close()


def head(spark: SparkSession, path: str, local: str | None, size: int) -> bytes:
    """The first bytes of a file."""
    found = chunks(spark, path, local, size)
    try:
        return next(found, b"")
    finally:
        found.close()


def copy_to(folder: str, name: str, data: Iterable[bytes]) -> str:
    """A new file in a folder that executors share; a folder of another store is written through Spark's file system."""
    path = f"{folder.rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}.txt"
    local = path.removeprefix("file://").removeprefix("file:")
    if "://" not in local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            f.writelines(data)
        return path
    spark = SparkSession.getActiveSession()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        for piece in data:
            stream.write(bytearray(piece))
    finally:
        stream.close()
    return path


def spool(stream, folder: str) -> str:
    """Copy a pipe to a file in the shared folder."""
    return copy_to(folder, "stdin", iter(lambda: stream.read(1 << 20), b""))


def transcode(spark: SparkSession, path: str, local: str | None, encoding: str) -> str:
    """A UTF-8 copy, in the shared folder, of a UTF-16 file without its mark; lone surrogates become U+FFFD."""
    decoder = codecs.getincrementaldecoder(CODECS[encoding])("replace")

    def pieces() -> Iterator[bytes]:
        first = True
        for data in chunks(spark, path, local):
            text = decoder.decode(data)
            if first and text:
                text, first = text.removeprefix("\ufeff"), False
            yield text.encode("utf-8", "replace")
        yield decoder.decode(b"", True).encode("utf-8", "replace")

    return copy_to(shared_folder(spark), "utf16", pieces())


def raw_lines(spark: SparkSession, path: str, cut: int = 4096) -> DataFrame:
    """(line): physical lines as they are, cut at 4 KiB."""
    line = F.col("value").cast("binary")
    return spark.read.option("lineSep", "\n").text(path).select(F.substring(line, 1, cut).cast("string").alias("line"))
