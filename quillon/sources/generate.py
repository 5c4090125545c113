"""Deterministic test tables as delimited lines, made by Column functions at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.dialect import CODECS

COUNTRIES = ("DE", "FR", "US", "JP", "BR", "IN", "GB", "ES", "IT", "CA")
STATES = ("new", "paid", "packed", "shipped", "returned", "lost")
WORDS = ("blue", "fast", "small", "old", "round", "cheap", "soft", "loud")
HEADER = ("id", "price", "date", "ts", "country", "status", "customer", "notes")


def _draw(seed: int, what: str) -> Column:
    """A number for each row and purpose."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(what)), F.lit(1 << 40))


def _chance(seed: int, what: str, share: float) -> Column:
    return _draw(seed, what) < int(share * (1 << 40))


def _pick(seed: int, what: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(seed, what) % len(values) + 1).cast("int"))


def lines(spark: SparkSession, rows: int, seed: int = 42, nulls: float = 0.0, ragged: float = 0.0, quoted_newlines: float = 0.0, crlf: bool = False) -> DataFrame:
    """(id, line): the header as row -1, then ``rows`` records. Shares of null cells, of records that lack their last
    field, and of notes that hold a line feed."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (_draw(seed, "day") % 2000).cast("int"))
    stamp = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad((_draw(seed, "h") % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((_draw(seed, "m") % 60).cast("string"), 2, "0"), F.lit(":00Z"))
    words = [_pick(seed, f"w{k}", WORDS) for k in range(3)]
    notes = F.concat(words[0], F.lit(", "), words[1], F.when(_chance(seed, "newline", quoted_newlines), F.lit("\n")).otherwise(F.lit(' "')), words[2], F.lit('"'))
    cells = {
        "price": F.format_string("%.2f", (_draw(seed, "price") % 1_999_999 - 999_999) / 100),
        "date": F.date_format(day, "yyyy-MM-dd"),
        "ts": stamp,
        "country": _pick(seed, "country", COUNTRIES),
        "status": _pick(seed, "status", STATES),
        "customer": F.concat(_pick(seed, "c1", WORDS), F.lit(" "), _pick(seed, "c2", WORDS)),
        "notes": F.concat(F.lit('"'), F.replace(notes, F.lit('"'), F.lit('""')), F.lit('"')),
    }
    given = [F.when(_chance(seed, f"null {k}", nulls), F.lit("")).otherwise(v) for k, v in cells.items()]
    short = F.concat_ws(",", F.col("id").cast("string"), *given[:-1])
    line = F.when(_chance(seed, "ragged", ragged), short).otherwise(F.concat_ws(",", short, given[-1]))
    body = spark.range(rows).select("id", line.alias("line"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(",".join(HEADER)).alias("line"))
    out = head.union(body)
    return out.withColumn("line", F.concat("line", F.lit("\r"))) if crlf else out


#: What an encoding's files begin with.
MARKS = {"utf-8": b"", "utf-8-bom": b"\xef\xbb\xbf", "utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff", "windows-1252": b""}


def write(spark: SparkSession, path: str, rows: int, **knobs) -> None:
    """A folder of UTF-8 part files, in order; the first begins with the header."""
    lines(spark, rows, **knobs).orderBy("id").select("line").write.option("lineSep", "\n").text(path)


def write_file(spark: SparkSession, path: str, rows: int, encoding: str = "utf-8", **knobs) -> None:
    """One local file in any of the encodings, streamed through the driver: for fixtures."""
    with open(path, "wb") as f:
        f.write(MARKS[encoding])
        for r in lines(spark, rows, **knobs).orderBy("id").select("line").toLocalIterator():
            f.write(f"{r.line}\n".encode(CODECS[encoding]))
