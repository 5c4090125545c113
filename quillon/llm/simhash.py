"""SimHash near-deduplication with a byte-position inverted index and count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most three bits differ in at
most three bytes, so they share at least five of the eight (the guaranteed minimum). Every choice of five positions
out of 0..7 holds three of 0..3 or three of 4..7; an inverted index on the eight triples of one half therefore meets
every such pair at least once, with postings 2^24 times shorter than the corpus, not 2^8. Where a posting list brings
two fingerprints together, their shared positional bytes are tallied over all eight positions; pairs under five are
left, the rest are verified on their bits.

Only distinct fingerprints are indexed, each with the smallest id that has it, so exact copies cost nothing. A list
does not give out all its pairs but a spanning forest of its links (a search that visits each member once). Lists
longer than ``long_list`` are dealt anew under two more positions each: a pair that shares a triple and five bytes in
all shares two of the other five positions, so ten sublists of 40 bits hold all its links. A sublist still too long is
split by six-bit groups of the last 24 bits (at most three bits differ, so one of four groups is equal), which leaves
2^18 fingerprints at most: that bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, materialize, slices, sorted_groups

TRIPLES = [(h + a, h + b, h + c) for h in (0, 4) for a, b, c in combinations(range(4), 3)]
BITS, SHARED = 3, 5


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of A-Z-lowered words, repeats included; fewer words: one shingle; none: none."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and \x20 \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -width] + 1).tolist()]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; no hashes: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = [fingerprint(shingle_hashes(x)) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "h", "fp"])


def text_hash(text_col: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp long), h the text's hash: null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("h"), text.alias("text")).mapInArrow(_fingerprints, "doc_id long, h long, fp long")


def _near(fp: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each pair shares at least five positional bytes and differs in at most three bits."""
    x = fp[rows] ^ fp[others]
    shared = 8 - np.count_nonzero(x.view(np.uint8).reshape(-1, 8), axis=1)
    near = shared >= SHARED
    near[near] = np.bitwise_count(x[near]) <= BITS
    return near


def forest(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the near pairs of distinct fingerprints: a search that visits each once."""
    left = np.arange(len(fp))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = _near(fp, np.full(len(left), at), left)
            found, left = left[near], left[~near]
            if len(found):
                yield np.full(len(found), at), found
                front.extend(found)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in sorted_groups(batches, "key"):
        key, fp = table["key"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        found = []
        small = np.repeat(sizes <= 16, sizes)
        for d in range(1, 16):  # short lists, all at once: each row with the one d places on
            rows = np.flatnonzero((key[:-d] == key[d:]) & small[:-d]) if d < len(key) else []
            if not len(rows):
                break
            rows = rows[_near(fp, rows, rows + d)]
            found.append((rows, rows + d))
        for i in np.flatnonzero(sizes > 16):
            found += [(a + starts[i], b + starts[i]) for a, b in forest(fp[starts[i] : starts[i] + sizes[i]])]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])


def _byte(i: int):
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _mixed(*parts):
    """Bytes side by side, as one number."""
    out = parts[0]
    for p in parts[1:]:
        out = F.shiftleft(out, 8).bitwiseOR(p)
    return out


def _linked(postings: DataFrame) -> DataFrame:
    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def links(distinct: DataFrame, long_list: int = 16384) -> DataFrame:
    """(a, b): fingerprints at three bits or fewer; enough of them to connect all that are connected."""
    keys = F.array(*(F.struct(F.lit(t).alias("t"), _mixed(F.lit(t).cast("long"), *map(_byte, p)).alias("key")) for t, p in enumerate(TRIPLES)))
    postings = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    long_keys = materialize(postings.groupBy("key").count().where(F.col("count") > long_list).select("key"))
    if long_keys.isEmpty():
        return _linked(postings)
    short = postings.join(long_keys, "key", "left_anti")
    out = _linked(short)
    for _, level in enumerate(("pairs", "bits")):
        held = postings.join(long_keys, "key", "left_semi")
        sub = []
        if level == "pairs":
            for t, p in enumerate(TRIPLES):
                rest = [i for i in range(8) if i not in p]
                for n, (x, y) in enumerate(combinations(rest, 2)):
                    last = [i for i in rest if i not in (x, y)]
                    sub.append(F.when(F.col("t") == t, F.struct(F.col("t"), F.lit(n).alias("n"), F.xxhash64(F.lit(level), "key", F.lit(n), _byte(x), _byte(y)).alias("key"), _mixed(*map(_byte, last)).alias("last"))))
        else:
            for g in range(4):
                six = F.shiftrightunsigned("last", 6 * g).bitwiseAND(F.lit(63).cast("long"))
                sub.append(F.struct("t", F.lit(g).alias("n"), F.xxhash64(F.lit(level), "key", F.lit(g), six).alias("key"), F.col("last")))
        postings = held.select("fp", F.explode(F.array_compact(F.array(*sub))).alias("k")).select("fp", "k.t", "k.key", "k.last")
        if level == "pairs":
            long_keys = materialize(postings.groupBy("key").count().where(F.col("count") > long_list).select("key"))
            out = out.union(_linked(postings.join(long_keys, "key", "left_anti")))
    return out.union(_linked(postings))


def _members(prints: DataFrame, long_list: int) -> DataFrame:
    """(fp, first, root): every fingerprint, the least (doc_id, h) that has it, and one fingerprint for its component."""
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))
    distinct = prints.groupBy("fp").agg(F.min(named).alias("first"))
    component = connected_components(links(distinct.select("fp"), long_list))
    return distinct.join(component, distinct["fp"] == component["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = 16384) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    Fingerprints at three bits or fewer link; component_id is the smallest id that a row reaches, itself included.
    Null and empty texts have fingerprint zero and link like any other. A null id never is a component's id unless
    all its members' are null. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col))
    member = _members(prints, long_list)
    lowest = member.groupBy("root").agg(F.min("first").alias("first"))
    named = member.join(lowest.withColumnRenamed("first", "_least"), "root").select("fp", F.col("_least.doc_id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = 16384) -> DataFrame:
    """One row of each component stays: the one with the smallest id, with all its columns. A row is known by its id and
    its text's hash, so an id with several texts loses only those whose component keeps another row; of repeated rows,
    and of the texts that one id has in one component, one stays. Rows without an id stay."""
    prints = materialize(fingerprints(docs, id_col, text_col))
    member = _members(prints, long_list)
    lowest = member.where(F.col("first").isNotNull()).groupBy("root").agg(F.min("first").alias("_least"))
    named = member.select("fp", "root").join(lowest, "root").select("fp", "_least")
    rows = prints.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "h", "fp").agg(F.count("*").alias("_copies"))
    kept = (F.col("doc_id") == F.col("_least.doc_id")) & (F.col("h") == F.col("_least.h"))
    gone = materialize(rows.join(named, "fp").select(F.col("doc_id").alias("_quillon_gone_id"), F.col("h").alias("_quillon_gone_h"), kept.alias("_quillon_stays"), "_copies").where(~F.col("_quillon_stays") | (F.col("_copies") > 1)).drop("_copies"))
    keyed = docs.withColumn("_quillon_h", text_hash(text_col))
    on = (F.col(id_col).cast("long") == F.col("_quillon_gone_id")) & (F.col("_quillon_h") == F.col("_quillon_gone_h"))
    rest = keyed.join(gone, on, "left_anti").select(*docs.columns)
    repeated = gone.where("_quillon_stays")
    if repeated.isEmpty():
        return rest
    return rest.union(keyed.join(repeated, on).dropDuplicates(["_quillon_gone_id", "_quillon_h"]).select(*docs.columns))
