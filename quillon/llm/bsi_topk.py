"""Exact top-k search by inner product over a bit-sliced index.

Every attribute (vector component) of a block of rows is stored as bit slices: bitmap s holds bit s of the
attribute, offset to be non-negative, for all rows of the block. A query's score is the sum of its components
times the attributes; each component is written in non-adjacent signed digits, so the score is a sum of shifted
slices. Slices of equal weight are added with carry-save adders, which leaves one bitmap a weight: the score's
own slices. The best rows are selected from the most significant slice downward. The lowest ``drop_bits`` slices
of the attributes are left out of the sum, so a score is known up to a bound; all rows whose bound reaches the
boundary are scored exactly, and ties go to the smaller id.

Memory: vectors go to the task of their block, and every block of queries to all blocks of vectors (an equi-dealing by
the block's number: nothing is broadcast or joined, no table of blocks is held). A task indexes one block, holds one block
of queries and works on sixteen of them at a time; each pair of blocks returns k rows a query. Every query must meet every
vector, so the work grows with the product; what is copied is a query's components once a block, so blocks are as large
as leaves each core two, up to 65,536 rows. Scores that 64 bits couldn't hold are an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEST = "query_id long, vec_id long, score long"
TOGETHER = 16  # queries that are scored at a time


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """(vec_id, q): q is floor(scale * x) of each component. Null vectors, null or non-finite components, null ids
    and empty vectors take no part. A component so large that a score of two such vectors could pass 2^62 is an error."""
    v = F.col(vec_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.lit(2.0**31) / F.sqrt(F.size(v))
    whole = F.transform(v, lambda x: F.floor(F.when(F.abs(x.cast("double") * scale) < most, x.cast("double") * scale).otherwise(F.raise_error(F.concat(F.lit("too large a component for scores of 64 bits in vector "), F.col(id_col).cast("string"))).cast("double"))).cast("long"))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("q"))


def signed_digits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, power, negative) of the digits of a matrix in non-adjacent form: a third of the bits on average."""
    size = np.abs(values)
    half = size >> 1
    both = size + half
    rows, columns, powers, negative = [], [], [], []
    for mask, minus in ((both & (half ^ both), values < 0), (half & (half ^ both), values >= 0)):
        for power in range(int(mask.max(initial=0)).bit_length()):
            r, c = np.nonzero(mask >> power & 1)
            rows.append(r), columns.append(c), powers.append(np.full(len(r), power)), negative.append(minus[r, c])
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (rows, columns, powers, negative))


def add_slices(by_weight: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Carry-save addition: {weight: k bitmaps} to {weight: one bitmap}."""
    out, w, top = {}, 0, max(by_weight, default=-1)
    pending = dict(by_weight)
    while w <= top:
        rows = pending.pop(w, None)
        carried = []
        while rows is not None and len(rows) > 1:
            n = len(rows) // 3
            if n:
                a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                x = a ^ b
                carried.append((a & b) | (x & c))
                rows = np.concatenate([x ^ c, rows[3 * n :]])
            else:
                carried.append((rows[0] & rows[1])[None])
                rows = (rows[0] ^ rows[1])[None]
        if rows is not None and len(rows):
            out[w] = rows[0]
        if carried:
            above = pending.get(w + 1)
            pending[w + 1] = np.concatenate(carried if above is None else [above, *carried])
            top = max(top, w + 1)
        w += 1
    return out


class Block:
    """The bit slices of a block of vectors, with their values for the exact step."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, drop_bits: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        base = self.rows.min(axis=0)
        self.widths = np.array([int(x).bit_length() for x in (self.rows.max(axis=0) - base)], np.int64)
        self.words = -(-len(ids) // 64)
        self.first = np.concatenate([[0], np.cumsum(self.widths)])
        self.slices = np.zeros((int(self.first[-1]) + 1, self.words), np.uint64)  # the last one stays empty
        for d, width in enumerate(self.widths.tolist()):
            up = (self.rows[:, d] - base[d]).astype(np.uint64)
            for s in range(width):
                self.slices[self.first[d] + s] = self._bitmap((up >> np.uint64(s) & np.uint64(1)).astype(np.uint8))
        self.alive = self._bitmap(np.ones(len(ids), np.uint8))
        self.drop = np.minimum(drop_bits, np.maximum(self.widths - 1, 0))
        self.lost = (1 << self.drop) - 1  # the most that the dropped slices of an attribute are worth

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(np.concatenate([bits, np.zeros(self.words * 64 - len(bits), np.uint8)]), bitorder="little").view(np.uint64)

    def scores(self, queries: np.ndarray) -> dict[int, np.ndarray]:
        """Slices of the partial scores, up to a constant a query: {weight: (queries, words)}."""
        query, d, power, minus = signed_digits(queries)
        n = self.widths[d] - self.drop[d]
        query, d, power, minus = (np.repeat(x, n) for x in (query, d, power, minus))
        s = self.drop[d] + np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
        weight = power + s
        order = np.lexsort((query, weight))
        query, weight, at, minus = query[order], weight[order], (self.first[d] + s)[order], minus[order]
        new = np.concatenate([[True], (weight[1:] != weight[:-1]) | (query[1:] != query[:-1])]) if len(weight) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        place = np.arange(len(weight)) - np.repeat(first, np.diff(np.append(first, len(weight))))
        by_weight = {}
        for w in np.unique(weight).tolist():
            lo, hi = np.searchsorted(weight, [w, w + 1])
            shape = (int(place[lo:hi].max()) + 1, len(queries))
            which, flip = np.full(shape, len(self.slices) - 1), np.zeros(shape, np.uint64)
            which[place[lo:hi], query[lo:hi]] = at[lo:hi]
            flip[place[lo:hi], query[lo:hi]] = np.where(minus[lo:hi], ~np.uint64(0), np.uint64(0))  # -b is (not b) - 1
            by_weight[w] = self.slices[which] ^ flip[:, :, None]
        return add_slices(by_weight)

    def candidates(self, queries: np.ndarray, alive: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query, positions of all rows that may be among the k best."""
        total = self.scores(queries)
        weights = sorted(total, reverse=True)
        sure, tied, boundary = np.zeros_like(alive), alive, [0] * len(queries)
        for w in weights:
            more = tied & total[w]
            enough = np.bitwise_count(sure | more).sum(axis=1) >= k
            boundary = [x | (1 << w) if e else x for x, e in zip(boundary, enough.tolist(), strict=True)]
            sure = np.where(enough[:, None], sure, sure | more)
            tied = np.where(enough[:, None], more, tied & ~total[w])
        # the k-th partial score is the boundary; a row counts if its most reaches the boundary's least
        floor = [max(x - int(spread), 0) for x, spread in zip(boundary, np.abs(queries) @ self.lost, strict=True)]
        above, equal = np.zeros_like(alive), alive
        for w in range(max(max(weights, default=0), max(floor).bit_length() - 1), -1, -1):
            bits = total.get(w, np.zeros_like(alive))
            wanted = np.array([x >> w & 1 for x in floor], bool)[:, None]
            above, equal = np.where(wanted, above, above | (equal & bits)), np.where(wanted, equal & bits, equal & ~bits)
        keep = np.unpackbits((above | equal).view(np.uint8), axis=1, bitorder="little")
        return [np.flatnonzero(x) for x in keep]

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each query with the ids and exact scores of the k best rows that aren't its own."""
        for lo in range(0, len(query_ids), TOGETHER):
            ids, some = query_ids[lo : lo + TOGETHER], queries[lo : lo + TOGETHER]
            alive = np.repeat(self.alive[None], len(ids), axis=0)
            first, last = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
            for q in np.flatnonzero(last > first):
                own = np.zeros(len(self.ids), np.uint8)
                own[first[q] : last[q]] = 1
                alive[q] &= ~self._bitmap(own)
            for i, query, at in zip(ids.tolist(), some, self.candidates(some, alive, k), strict=True):
                exact = self.rows[at] @ query
                order = np.lexsort((self.ids[at], -exact))[:k]
                yield i, self.ids[at][order], exact[order]


def _search(k: int, drop_bits: int):
    """Rows sorted by (dim, block, kind): a block's vectors, then the blocks of queries that it is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, block = None, [], [], None
        for batch in batches:
            for x in (y for part in slices(batch) for y in part):
                if x["queries"] is None:
                    if (x["dim"], x["block"]) != key:
                        key, ids, rows, block = (x["dim"], x["block"]), [], [], None
                    ids.append(x["vec_id"])
                    rows.append(np.array(x["q"], np.int64))
                elif (x["dim"], x["block"]) == key:  # else a block without vectors
                    if block is None:
                        block = Block(np.array(ids, np.int64), np.stack(rows), drop_bits)
                        ids, rows = [], []
                    asked = np.frombuffer(x["query_ids"], np.int64)
                    found = list(block.best(asked, np.frombuffer(x["queries"], np.int32).reshape(len(asked), -1).astype(np.int64), k))
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(asked, [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found]).astype(np.int64)})

    def slices(batch: pa.RecordBatch) -> Iterator[list[dict]]:
        for lo in range(0, batch.num_rows, 512):
            yield batch.slice(lo, 512).to_pylist()

    return run


def _query_block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vec_id")
    return pd.DataFrame([{"dim": key[0], "query_block": key[1], "query_ids": frame["vec_id"].to_numpy(np.int64).tobytes(), "queries": np.stack(frame["q"].to_numpy()).astype(np.int32).tobytes()}])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int | None = None, query_rows: int = 1024, drop_bits: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the highest inner product for each of ``queries``.

    Both tables have (vec_id long, q array<long>), as from ``quantise``. A query is compared with the vectors of its
    own length, except rows with its own id. Ties go to the smaller vec_id; equal rows of one id count each.
    A query without candidates returns no rows. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("dim", F.size("q"))
    n = rows.count()
    block_rows = block_rows or max(1024, min(65536, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    blocks = max(1, -(-n // block_rows))
    placed = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(None).cast("long").alias("query_block"), "vec_id", "q", F.lit(None).cast("binary").alias("query_ids"), F.lit(None).cast("binary").alias("queries"))
    asked = queries.withColumn("dim", F.size("q"))
    groups = max(1, -(-asked.count() // query_rows))
    packed = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups))).groupBy("dim", "query_block").applyInPandas(_query_block, "dim int, query_block long, query_ids binary, queries binary")
    dealt = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    both = placed.union(dealt.select("dim", "block", "query_block", F.lit(None).cast("long"), F.lit(None).cast("array<bigint>"), "query_ids", "queries"))
    # a partition a block: the work of a block of vectors is that of all queries, so none should wait behind another
    met = both.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("dim", "block", F.asc_nulls_first("query_block"))
    found = met.mapInArrow(_search(k, drop_bits), BEST)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
