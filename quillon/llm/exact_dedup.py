"""Exact deduplication by Grace hashing.

1. Each input task collapses its own equal texts in an open-addressing table that compares complete content, and
   hands on one row for each distinct text (count, largest id) - so a text that a third of all rows share reaches
   the shuffle once a task, not once a row.
2. The collapsed rows are partitioned by the content's hash. Each partition streams its rows; while they are more
   than the memory budget they go to spill files, split by further bits of the hash, recursively, until a bucket
   fits one open-addressing table. Rows of one content that still exceed the budget are merged as they come.
3. Documents take their group's figures by a join on the content's SHA-256. Two contents of one SHA-256 would be
   seen by the tables, which compare contents, and stop the run.

A spill file belongs to one task attempt and goes with it; a lost executor only repeats its tasks.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, slices

PARTIAL = pa.schema([("hash", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("keep_id", pa.int64())])
GROUP = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def larger(a: int | None, b: int | None) -> int | None:
    """Null ranks below every id."""
    return b if a is None else a if b is None else max(a, b)


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.entries: list[list] = []  # hash, content, count, largest id
        self.size = 0

    def add(self, h: int, content: bytes, n: int, doc_id: int | None) -> None:
        mask, slots, entries = len(self.slots) - 1, self.slots, self.entries
        at = (h ^ (h >> 32)) & mask
        while (e := slots[at]) >= 0:
            entry = entries[e]
            if entry[0] == h and entry[1] == content:
                entry[2] += n
                entry[3] = larger(entry[3], doc_id)
                return
            at = (at + 1) & mask
        slots[at] = len(entries)
        entries.append([h, content, n, doc_id])
        self.size += len(content) + 200
        if 2 * len(entries) > len(slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, (h, *_) in enumerate(self.entries):
            at = (h ^ (h >> 32)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _partials(entries: list[list]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(entries), 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries[i : i + 512], strict=True), PARTIAL.types, strict=True)], schema=PARTIAL)


def _collapse(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in slices(batches):
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = xxhash.xxh64_intdigest(content)
                table.add(h - (1 << 64) if h >> 63 else h, content, 1, doc_id)
                if table.size > budget:
                    yield from _partials(table.entries)
                    table = ContentTable()
        yield from _partials(table.entries)

    return run


def _groups(entries: list[list]) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, bytes] = {}
    rows = []
    for _, content, n, keep in entries:
        sha = hashlib.sha256(content).digest()
        if seen.setdefault(sha, content) != content:
            raise ValueError("two contents with one SHA-256")
        rows.append((sha, keep, n))
    for i in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096], strict=True), GROUP.types, strict=True)], schema=GROUP)


def _spill(rows: Iterator[tuple], level: int, fan_out: int) -> list:
    """Split rows into files by the hash's bits of this level."""
    files = [tempfile.TemporaryFile() for _ in range(fan_out)]
    for row in rows:
        pickle.dump(row, files[_bits(row[0], level) % fan_out], protocol=5)
    return files


def _bits(h: int, level: int) -> int:
    return xxhash.xxh32_intdigest((h & (2**64 - 1)).to_bytes(8, "little"), level + 1)


def _load(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def grace(rows: Iterator[tuple], budget: int, fan_out: int = 16, level: int = 0, max_level: int = 8) -> Iterator[list[list]]:
    """Tables' entries, bucket by bucket. After ``max_level`` splits only one hash can be left: its rows are merged."""
    table, rows = ContentTable(), iter(rows)
    for row in rows:
        table.add(*row)
        if table.size > budget and level < max_level:
            break
    else:
        yield table.entries
        return
    files = _spill(_chain(table.entries, rows), level, fan_out)
    del table
    for file in files:
        with file:
            yield from grace(_load(file), budget, fan_out, level + 1, max_level)


def _chain(entries: list[list], rows: Iterator[tuple]) -> Iterator[tuple]:
    yield from map(tuple, entries)
    yield from rows


def _merge(budget: int, fan_out: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in slices(batches) for row in zip(*(batch.column(c).to_pylist() for c in PARTIAL.names), strict=True))
        for entries in grace(rows, budget, fan_out):
            yield from _groups(entries)

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, budget: int = 96 << 20, fan_out: int = 16) -> DataFrame:
    """(sha binary, keep_id, group_size): one row for each distinct text. Null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    parts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("content")).mapInArrow(_collapse(budget // 2), "hash long, content binary, n long, keep_id long")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "hash").mapInArrow(_merge(budget, fan_out), "sha binary, keep_id long, group_size long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of ``docs``.

    Of equal texts the row with the largest id stays (a null id ranks lowest); of repeated rows with that id, one.
    Null text counts as empty. An empty table gives an empty result.
    """
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sha.alias("sha")).groupBy("doc_id", "sha").agg(F.count("*").alias("copies"))
    joined = rows.join(groups(docs, id_col, text_col, **options), "sha")
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    found = exact_groups(docs, id_col, text_col, **options)
    gone = found.groupBy(F.col("doc_id").alias("_quillon_gone_id"), F.col("text_sha256").alias("_quillon_gone_sha")).agg(F.max("kept").alias("_quillon_kept"), F.count("*").alias("_quillon_copies"))
    gone = materialize(gone.where(~F.col("_quillon_kept") | (F.col("_quillon_copies") > 1)))
    marked = docs.withColumn("_quillon_own_sha", sha)
    on = marked[id_col].eqNullSafe(F.col("_quillon_gone_id")) & (F.col("_quillon_own_sha") == F.col("_quillon_gone_sha"))
    rest = marked.join(gone, on, "left_anti").select(*docs.columns)
    repeated = gone.where("_quillon_kept")
    if repeated.isEmpty():
        return rest
    return rest.union(marked.join(repeated, on).dropDuplicates(["_quillon_gone_id", "_quillon_gone_sha"]).select(*docs.columns))
