"""Delimited text, read in parallel by exact record rules, with rows numbered in file order.

The file is read by Spark's line reader, block by block. One pass looks at every line, tells each block's rows, widest
row and whether a quote is open at its end, for either state at its beginning; the driver chains the blocks' states
(one small row a block). In files where no record spans lines - known only after that pass - lines are records and
everything else is Column expressions: split, unquote, number. Otherwise blocks are put together again by a Python
pass that knows the state each block begins in; only records that cross a block's edge meet in a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.dialect import Dialect
from quillon.sources.records import open_after

#: What ISO-8859-1 has as controls and Windows-1252 as characters.
_C1 = "".join(chr(c) for c in range(0x80, 0xA0))
_CP1252 = "".join(bytes([c]).decode("cp1252", "replace") if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(c) for c in range(0x80, 0xA0))


@dataclass
class Scan:
    """What the file is found to hold."""

    rows: int  # records, the header included
    width: int  # fields of the widest record
    unterminated: bool
    strategy: str  # lines: every line is a record; blocks: some record spans lines


def literal_regex(s: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", s)


def fields_of(record: Column, dialect: Dialect) -> Column:
    """The unescaped fields of a record, as an array."""
    d = literal_regex(dialect.delimiter)
    if dialect.quote is None:
        return F.split(record, d, -1)
    q = literal_regex(dialect.quote)
    body = rf"[^{q}\\]*+(?:\\.[^{q}\\]*+)*+\\?" if dialect.escape == "backslash" else f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    matches = F.regexp_extract_all(F.concat(F.lit(dialect.delimiter), record), F.lit(f"(?s){d}(?:{q}{body}{q}?[^{d}]*|[^{d}]*)"), F.lit(0))
    inner = rf"(?s)\A.{q}({body}){q}?(.*)\z"

    def value(m: Column) -> Column:
        text = F.regexp_extract(m, inner, 1)
        text = F.regexp_replace(text, r"(?s)\\(.)", "$1") if dialect.escape == "backslash" else F.replace(text, F.lit(dialect.quote * 2), F.lit(dialect.quote))
        return F.when(F.substring(m, 2, 1) == dialect.quote, F.concat(text, F.regexp_extract(m, inner, 2))).otherwise(F.substring(m, 2, 2**31 - 1))

    return F.when(F.contains(record, F.lit(dialect.quote)), F.transform(matches, value)).otherwise(F.split(record, d, -1))


def _lines(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    """(block, at, line): physical lines as read, at rising within a block."""
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value")
    if dialect.encoding == "windows-1252":
        line = F.translate(F.decode(line.cast("binary"), "ISO-8859-1"), _C1, _CP1252)
    block = F.col("_metadata.file_block_start")
    if dialect.encoding == "utf-8-bom":
        line = F.when((block == 0) & line.startswith("﻿"), F.substring(line, 2, 2**31 - 1)).otherwise(line)
    return raw.select(block.alias("block"), F.monotonically_increasing_id().alias("at"), line.alias("line"))


def _is_record(line: Column, dialect: Dialect) -> Column:
    out = (line != "") & (line != "\r")
    return out & ~line.startswith(dialect.comment) if dialect.comment else out


def _open(line: Column, dialect: Dialect) -> Column:
    """Whether a line by itself leaves a quote open: its last field opens and doesn't close."""
    d, q = literal_regex(dialect.delimiter), literal_regex(dialect.quote)
    body = rf"[^{q}\\]*+(?:\\.[^{q}\\]*+)*+\\?" if dialect.escape == "backslash" else f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    closed = rf"\A(?:(?:{q}{body}{q}[^{d}]*+|(?!{q})[^{d}]*+)(?:{d}|\z))*+\z"
    return F.contains(line, F.lit(dialect.quote)) & ~F.concat(line, F.lit("")).rlike("(?s)" + closed)


def _states(dialect: Dialect):
    """A block's lines, from either state: records begun, the state at the end, and the lines' widest record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        for batch in batches:
            for block, at, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = line.decode("utf-8", "surrogateescape")
                s = blocks.setdefault(block, [at, [0, False], [0, True]])
                for state in s[1:]:
                    if not state[1]:
                        if line in ("", "\r") or (dialect.comment and line.startswith(dialect.comment)):
                            continue
                        state[0] += 1
                    state[1] = open_after(line, state[1], dialect)
        rows = [(b, s[0], *s[1], *s[2]) for b, s in blocks.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["block", "first", "n_out", "end_out", "n_in", "end_in"])

    return run


def _assemble(dialect: Dialect, starts: dict[int, tuple[int, bool]]):
    """(row, part, record): whole records (part -1) and, at a block's edges, their pieces in the order of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # block: next row, open?, lines of the open record, came from before?
        out: list[tuple[int, int, bytes]] = []

        def close(s: list, part: int) -> None:
            out.append((s[0] - 1, part, "\n".join(s[2]).encode("utf-8", "surrogateescape")))
            s[2], s[3] = [], False

        for batch in batches:
            for block, _, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = line.decode("utf-8", "surrogateescape")
                if block not in held:
                    row, open_ = starts[block]
                    held[block] = [row, open_, [], open_]
                s = held[block]
                if not s[1]:
                    if line in ("", "\r") or (dialect.comment and line.startswith(dialect.comment)):
                        continue
                    s[0] += 1
                s[2].append(line)
                s[1] = open_after(line, s[1], dialect)
                if not s[1]:
                    close(s, block if s[3] else -1)
            if len(out) > 5000:
                yield _batch(out)
                out = []
        for block, s in held.items():
            if s[2]:
                close(s, block)
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["row", "part", "record"])


def read_records(spark: SparkSession, path: str, dialect: Dialect, multiline: bool | None = None) -> tuple[DataFrame, Scan]:
    """(row, fields): every record of the file, numbered from 0 in file order, the header included."""
    lines = _lines(spark, path, dialect)
    alone = lines.where(_is_record(F.col("line"), dialect)).select("block", F.monotonically_increasing_id().alias("at"), "line")
    if not multiline:
        opens = _open(F.regexp_replace("line", r"\r\z", ""), dialect) if dialect.quote else F.lit(False)
        fields = F.size(fields_of(F.regexp_replace("line", r"\r\z", ""), dialect))
        seen = alone.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max(fields).alias("width"), F.bool_or(opens).alias("open")).orderBy("block").collect()
        if not any(b["open"] for b in seen):
            base, bases = 0, []
            for b in seen:
                bases.append((b["block"], base - b["first"]))
                base += b["n"]
            record = F.regexp_replace("line", r"\r\z", "")
            known = spark.createDataFrame(bases, "block long, add long")  # a row a block: small by the blocks' size
            rows = alone.join(F.broadcast(known), "block").select((F.col("at") + F.col("add")).alias("row"), fields_of(record, dialect).alias("fields"))
            return rows, Scan(base, max((b["width"] for b in seen), default=0), False, "lines")
    binary = lines.select("block", "at", F.col("line").cast("binary").alias("line"))
    states = binary.mapInArrow(_states(dialect), "block long, first long, n_out long, end_out boolean, n_in long, end_in boolean").groupBy("block").agg(*(F.first(c).alias(c) for c in ("n_out", "end_out", "n_in", "end_in"))).orderBy("block").collect()
    row, open_, starts = 0, False, {}
    for s in states:
        starts[s["block"]] = (row, open_)
        row, open_ = row + (s["n_in"] if open_ else s["n_out"]), s["end_in"] if open_ else s["end_out"]
    pieces = binary.mapInArrow(_assemble(dialect, starts), "row long, part long, record binary")
    whole = pieces.where("part < 0").select("row", "record")
    crossing = pieces.where("part >= 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("part", "record"))).alias("p"))
    crossing = crossing.select("row", F.array_join(F.transform("p", lambda x: x["record"].cast("string")), "\n").cast("binary").alias("record"))
    record = F.regexp_replace(F.col("record").cast("string"), r"\r\z", "")
    if open_ and ends_with_newline(spark, path):  # the open quote holds the last line feed too
        record = F.when(F.col("row") == row - 1, F.concat(F.col("record").cast("string"), F.lit("\n"))).otherwise(record)
    rows = whole.union(crossing).select("row", fields_of(record, dialect).alias("fields"))
    width = rows.agg(F.max(F.size("fields"))).first()[0] or 0
    return rows, Scan(row, width, open_, "blocks")


def ends_with_newline(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(target).getLen()
    stream = fs.open(target)
    try:
        stream.seek(max(size - 1, 0))
        return stream.read() == 10
    finally:
        stream.close()
