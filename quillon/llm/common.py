"""Helpers that the corpus operators share: tables in the shared folder, Arrow groups, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_delete, spark, path)
    if _open:
        _open[-1].paths.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


class Scratch:
    """Tables of ``materialize`` that were made inside, deleted at its end but for those that are ``kept``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.discard(df._quillon_path)
        return df

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)
        for path in self.paths:
            _delete(self.spark, path)


_open: list[Scratch] = []


def release(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    _delete(df.sparkSession, df._quillon_path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces: what Python holds of texts at a time stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``key`` into tables that hold whole keys only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1]
        if held and held[-1].column(key)[-1].equals(last) and keys[0].equals(last):
            held.append(batch)
            continue
        cut = batch.num_rows - 1
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(values != values[-1])[-1]) + 1 if (values != values[-1]).any() else 0
        table = pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held) if held or cut else None
        if table is not None and table.num_rows:
            yield table
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def bitmap(df: DataFrame, col: str, size: int, block: int = 1 << 23) -> bytes:
    """A bit for each number under ``size``, those in a column set: ``size / 8`` bytes, or none where no bit is set. Only
    blocks of a megabyte that hold a set bit come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for b in np.unique(at // block).tolist():
                held.setdefault(b, np.zeros(min(block, size - b * block), bool))[at[at // block == b] % block] = True
        for b, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    at = df.select(F.col(col).cast("long").alias("at")).repartition(F.floor(F.col("at") / block))
    blocks = {r[0]: bytes(r[1]) for r in at.mapInArrow(run, "block long, bits binary").collect()}
    return b"".join(blocks.get(b, bytes(-(-min(block, size - b * block) // 8))) for b in range(-(-size // block))) if blocks else b""


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component: the smallest reachable node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges stay the same:
    O(log^2 n) rounds, each a join on the node, whose skew the adaptive join splits. Only the count and the
    hash of the edges come to the driver. Nodes may be of any ordered type. Null ends and loops are no edges.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u > v).distinct()
    now = materialize(now)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = now.union(now.select(v, u))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u > v).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.select(v.alias("u"), F.col("m").alias("v")).where(u > v)
        fresh = materialize(small.union(small_low.select("u", F.col("m").alias("v"))).distinct())
        release(now)
        now = fresh
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select(v.alias("node"), v.alias("component")).distinct())
