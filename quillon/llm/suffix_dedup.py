"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Suffixes need
only be told apart to that depth, so they are dealt to buckets and each bucket is sorted by itself:

1. Dealing. A suffix's anchor is the least hash of the 8-byte strings within its first 50 bytes: equal suffixes have
   one anchor, and neighbours mostly share theirs. Runs of neighbours with one anchor travel together, so a run of n
   suffixes costs n + 49 bytes. Buckets are remainders of the anchors. Buckets that would outgrow a task (an anchor that
   very many different runs share) are found by a count over all texts before; their suffixes are dealt anew, by anchors
   of 28 bytes and, where those are crowded too, of all 50: then a bucket's crowd is copies, which fold.
2. Folding. Equal runs (compared byte by byte) are kept once, for the smallest document that has them; in all others
   every suffix of the run is marked. Each task does so before it hands on, so a passage in a third of all documents
   reaches its bucket once a task; each bucket does so again.
3. Cover sample. In a bucket's text, positions whose remainder by 21 is in a difference cover ({0, 1, 4, 14, 16}: every
   difference occurs) are sampled. Two equal suffixes hold, at some offset under 21, two sampled positions with 30 bytes
   in common; suffixes without a sampled string that several documents share in reach have no tie and are left out.
   The samples in reach of the others are ranked by their bytes, to depth 56, before these are sorted.
4. Suffixes. They are sorted one block of leading bytes at a time, by their first 24 bytes. Those that still tie are
   ordered by a three-way quicksort whose comparison is one of ranks: at the offset where both are sampled. Neighbours
   in the order are then compared to 50 bytes; of each class the smallest document stays and the suffixes of all others
   are marked. Hashes only choose where to look; what is marked has been compared byte by byte.
5. Each document's marked suffixes cover the bytes that go: texts are shuffled once, to meet their marks.

A task holds one bucket, a few MB of texts or one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bitmap, materialize, release, slices

LENGTH, PERIOD, RANKED = 50, 21, 30
GRAMS = (8, 28, LENGTH)  # sizes of the strings whose least hash is an anchor, from the first deal to the last
LEAD, DEPTH = (0, 8, 16), tuple(range(0, 56, 8))  # words of a suffix sorted at first, words of a ranked sample
#: A difference cover: every remainder by 21 is a difference of two of these.
COVER = (0, 1, 4, 14, 16)
IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: The offset at which positions of two remainders are both sampled.
MEETS = np.array([[next(d for d in range(PERIOD) if IN_COVER[(a + d) % PERIOD] and IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])
PIECE = 1 << 22  # bytes of text that are cut into runs at a time; longer documents come in pieces
HELD = 24 << 20  # bytes of different runs that a task gathers before it hands them on
TOGETHER = 12 << 20  # bytes of texts that are packed at a time
SORTED = 1 << 18  # suffixes that are sorted at a time
PAD = bytes(128)
PACKED = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
PACKED_SQL = "bucket long, kind int, payload binary"
RUNS, MARKS, TEXTS = 0, 1, 2


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=6).compress(sizes.tobytes() + b"".join(np.ascontiguousarray(a).data for a in arrays))


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for (width, length), kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, length, at))
        at += width * length
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def words_of(raw: np.ndarray, order: str = "<") -> np.ndarray:
    """Each position's eight bytes as a number, read in place (positions near the end are left out)."""
    return np.ndarray((len(raw) - 7,), np.dtype(f"{order}u8"), raw.data, strides=(1,))


def string_keys(eight: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes (at least 8) that start at the given positions."""
    key = np.full(len(at), size, np.uint64)
    for k in (*range(0, size - 8, 8), size - 8):
        key = mixed((key ^ eight[at + k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return key


def anchors(eight: np.ndarray, n: int, gram: int, piece: int = 1 << 17) -> np.ndarray:
    """For each of the first n positions, the least hash of the strings of ``gram`` bytes within its 50 bytes."""
    out = np.empty(n, np.uint32)
    window = LENGTH - gram + 1
    for lo in range(0, n, piece):
        hi = min(n, lo + piece)
        m = hi - lo + window - 1
        x = eight[lo : lo + m] * np.uint64(0x9E3779B97F4A7C15)
        for k in (*range(8, gram - 8, 8), gram - 8):
            x ^= x >> np.uint64(31)
            x += eight[lo + k : lo + k + m] * np.uint64(0xC2B2AE3D27D4EB4F)
            x *= np.uint64(0xD6E8FEB86659FD93)
        x >>= np.uint64(32)
        h, wide = x.astype(np.uint32), 1
        while wide < window:
            step = min(wide, window - wide)
            h = np.minimum(h[: len(h) - step], h[step:])
            wide += step
        out[lo:hi] = h
    return out


def is_set(bits: bytes, at: np.ndarray) -> np.ndarray:
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Texts:
    """Some documents, or pieces of them, side by side."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        self.ids, self.hashes, self.offset = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        size = np.fromiter((len(r[3]) for r in rows), np.int64, len(rows))
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.raw = np.frombuffer(b"".join([*(r[3] for r in rows), PAD]), np.uint8)
        self.eight = words_of(self.raw)

    def runs(self, gram: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first position, suffixes, anchor) of the runs of wanted suffixes with one anchor."""
        anchor = anchors(self.eight, len(wanted), gram)
        cut = np.empty(len(wanted), bool)
        cut[0] = True
        np.not_equal(anchor[1:], anchor[:-1], out=cut[1:])
        cut[1:] |= wanted[1:] != wanted[:-1]
        cut[self.start] = True
        first = np.flatnonzero(cut)
        count = np.diff(np.append(first, len(wanted)))
        own = wanted[first]
        first, count = first[own], count[own]
        return first, count, anchor[first]

    def dealt(self, buckets: int, crowded: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first position, suffixes, bucket) of the runs of each deal: those of a deal's crowded buckets go to the next."""
        wanted = np.ones(int(self.end[-1]), bool)
        for e in self.end.tolist():
            wanted[max(e - LENGTH + 1, 0) : e] = False
        out = []
        for deal, gram in enumerate(GRAMS[: len(crowded) + 1]):
            first, count, anchor = self.runs(gram, wanted)
            bucket = (mixed(anchor.astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            over = is_set(crowded[deal], bucket) if deal < len(crowded) else np.zeros(len(first), bool)
            out.append((first[~over], count[~over], bucket[~over] + deal * buckets))
            if not over.any():
                break
            steps = np.zeros(len(wanted) + 1, np.int8)
            steps[first[over]] += 1
            steps[first[over] + count[over]] -= 1
            wanted = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
        return out


def taken(raw: np.ndarray, first: np.ndarray, size: np.ndarray, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """The strings of some sizes at some positions, one after the other, and where each ends."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for lo in range(0, len(first), step):
        s, e = size[lo : lo + step], ends[lo : lo + step]
        base = int(e[0] - s[0])
        at = np.repeat((first[lo : lo + step] - (e - s - base)).astype(np.int64), s)
        at += np.arange(len(at))
        out[base : int(e[-1])] = raw[at]
    return out, ends


class Runs:
    """Different runs, each with its places in the smallest document that has it."""

    def __init__(self, strings: pa.Array, bucket: np.ndarray, run: np.ndarray, doc: np.ndarray, h: np.ndarray, at: np.ndarray):
        self.strings, self.bucket, self.run, self.doc, self.h, self.at = strings, bucket, run, doc, h, at

    @property
    def ends(self) -> np.ndarray:
        return np.frombuffer(self.strings.buffers()[1], np.int32, len(self.strings) + 1, self.strings.offset * 4).astype(np.int64)


def as_strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def folded(parts: list[Runs]) -> tuple[Runs, tuple[np.ndarray, ...]]:
    """Equal runs kept once, at the places of the smallest document; and the marks (doc, h, first, n) of all others."""
    base = np.cumsum([0, *(len(p.strings) for p in parts)])
    coded = pa.concat_arrays([p.strings for p in parts]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    run = codes[np.concatenate([p.run + b for p, b in zip(parts, base, strict=False)])]
    doc, h, at = (np.concatenate([getattr(p, k) for p in parts]) for k in ("doc", "h", "at"))
    bucket = np.empty(len(coded.dictionary), np.int64)
    bucket[codes] = np.concatenate([p.bucket for p in parts])
    least = np.full(len(bucket), np.iinfo(np.int64).max)
    np.minimum.at(least, run, doc)
    own = doc == least[run]
    out = Runs(coded.dictionary, bucket, run[own], doc[own], h[own], at[own])
    n = np.diff(out.ends) - LENGTH + 1
    return out, (doc[~own], h[~own], at[~own], n[run[~own]])


def ranges_of(groups: np.ndarray) -> zip:
    """Where each group of equal neighbours starts and ends."""
    cuts = (np.flatnonzero(np.diff(groups)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(groups)], strict=True) if len(groups) else zip()


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves of 32 bits, apart: the high ones are mostly zero and pack away."""
    return (x & 0xFFFF).astype(np.uint16), (x >> 16).astype(np.uint16)


def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | high.astype(np.int64) << 16


def packed_runs(runs: Runs) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, RUNS, payload) of each bucket; its runs in the order of their documents."""
    ends = runs.ends
    size = np.diff(ends)
    raw = np.frombuffer(runs.strings.buffers()[2], np.uint8)
    owner = np.empty(len(size), np.int64)
    owner[runs.run] = runs.doc
    order = np.lexsort((owner, runs.bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.argsort(place[runs.run], kind="stable")
    run, h, at = place[runs.run[by]], runs.h[by], runs.at[by]
    for a, b in ranges_of(runs.bucket[order]):
        own = order[a:b]
        x, y = np.searchsorted(run, [a, b])
        data, _ = taken(raw, ends[own], size[own])
        yield int(runs.bucket[own[0]]), RUNS, pack(data, *halves(size[own]), np.diff(owner[own], prepend=0), np.diff(run[x:y], prepend=a).astype(np.uint32), h[x:y], *halves(at[x:y]))


def read_runs(bucket: int, payload: bytes) -> Runs:
    data, low, high, owner, step, h, low_at, high_at = unpack(payload, np.uint8, np.uint16, np.uint16, np.int64, np.uint32, np.int64, np.uint16, np.uint16)
    size, run = whole(low, high), np.cumsum(step, dtype=np.int64)
    return Runs(as_strings(data, np.cumsum(size)), np.full(len(size), bucket), run, np.cumsum(owner)[run], h, whole(low_at, high_at))


def packed_marks(marks: list[tuple[np.ndarray, ...]], blocks: int, buckets: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(block, MARKS, payload) by the documents' blocks; with ``buckets``, on their way through a bucket."""
    doc, h, first, n = (np.concatenate(x) for x in zip(*marks, strict=True)) if marks else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((first, h, doc, doc % blocks))
    doc, h, first, n = doc[order], h[order], first[order], n[order]
    for a, b in ranges_of(doc % blocks):
        d, x = doc[a:b], h[a:b]
        start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])]))
        block = int(d[0] % blocks)
        yield block if buckets is None else block % buckets, MARKS, pack(d[start], x[start], np.diff(np.append(start, b - a)).astype(np.uint32), first[a:b].astype(np.uint32), n[a:b].astype(np.uint32))


def read_marks(payload: bytes) -> list[np.ndarray]:
    return unpack(payload, np.int64, np.int64, np.uint32, np.uint32, np.uint32)


def _rows(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of about 8 MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), PACKED.types, strict=True)], schema=PACKED)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), PACKED.types, strict=True)], schema=PACKED)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """Documents of (doc_id, h, text binary) batches, some MB at a time; pieces of a longer one overlap by 49 bytes."""
    rows, size = [], 0
    for batch in slices(batches):
        for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
            for lo in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
                rows.append((i, h, lo, t[lo : lo + PIECE + LENGTH - 1] if len(t) > PIECE else t))
                size += len(rows[-1][3])
                if size > PIECE:
                    yield Texts(rows)
                    rows, size = [], 0
    if rows:
        yield Texts(rows)


def _sizes(buckets: int, crowded):
    """(bucket, bytes): what the runs of the last deal would weigh in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        earlier = [c.value for c in crowded]
        for texts in _texts(batches):
            _, count, bucket = texts.dealt(buckets, earlier)[-1]
            own, at = np.unique(bucket - len(earlier) * buckets, return_inverse=True)
            if len(own) and own[0] >= 0:  # else no run came as far as the last deal
                for b, n in zip(own.tolist(), np.bincount(at, count + LENGTH - 1).astype(np.int64).tolist(), strict=True):
                    held[b] = held.get(b, 0) + n
            if len(held) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["bucket", "bytes"])
                held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["bucket", "bytes"])

    return run


def _deal(buckets: int, blocks: int, crowded):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        held: list[Runs] = []
        marks: list[tuple[np.ndarray, ...]] = []
        size = 0
        bits = [c.value for c in crowded]

        def flush() -> Iterator[tuple[int, int, bytes]]:
            runs, found = folded(held)
            yield from packed_runs(runs)
            yield from packed_marks([*marks, found], blocks, buckets)

        for texts in _texts(batches):
            for first, count, bucket in texts.dealt(buckets, bits):
                cut = -(-int((count + LENGTH).sum()) // HELD)  # single suffixes weigh 50 times their text
                for part in np.array_split(np.arange(len(first)), cut) if cut else ():
                    data, ends = taken(texts.raw, first[part], count[part] + LENGTH - 1)
                    own = np.searchsorted(texts.start, first[part], "right") - 1
                    runs, found = folded([Runs(as_strings(data, ends), bucket[part], np.arange(len(part)), texts.ids[own], texts.hashes[own], first[part] - texts.start[own] + texts.offset[own])])
                    held.append(runs)
                    marks.append(found)
                    size += int(runs.ends[-1])
                    if size > HELD:
                        yield from flush()
                        held, marks, size = [], [], 0
        if held:
            yield from flush()

    return lambda batches: _rows(rows(batches))


def _pack_texts(blocks: int):
    """(block, TEXTS, payload): the documents of a block that a task has at hand, packed together."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[tuple[int, int, bytes]]:
            for block, some in held.items():
                ids, hashes, texts = zip(*some, strict=True)
                yield block, TEXTS, pack(np.array([i is None for i in ids], np.uint8), np.array([i or 0 for i in ids], np.int64), np.array(hashes, np.int64), np.array([len(t) for t in texts], np.uint32), np.frombuffer(b"".join(texts), np.uint8))

        for batch in slices(batches):
            for block, i, h, t in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "h", "text")), strict=True):
                held.setdefault(block, []).append((i, h, t))
                size += len(t) + 100
                if size > TOGETHER:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return lambda batches: _rows(rows(batches))


def sampled(eight: np.ndarray, ends: np.ndarray, runs: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The sampled positions of a bucket's text whose 30 bytes stand in runs of several documents."""
    at = (np.arange(0, int(ends[-1]), PERIOD)[:, None] + np.array(COVER)).ravel()
    at = at[: np.searchsorted(at, ends[-1])]
    run = runs[at]
    fits = at + RANKED <= ends[run + 1]
    at, run = at[fits], run[fits]
    if not len(at):
        return at
    key = string_keys(eight, at, RANKED)
    order = np.argsort(key)
    k, doc = key[order], owner[run[order]]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    return at[order[np.repeat(several, np.diff(np.append(first, len(k))))]]


def in_reach(ends: np.ndarray, runs: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The suffixes of 50 bytes with a shared sample at most PERIOD - 1 bytes on."""
    shared = np.sort(shared)
    first = np.maximum(shared - (PERIOD - 1), np.concatenate([[0], shared[:-1] + 1]))
    n = shared + 1 - first
    at = np.repeat((first - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
    last = (ends - LENGTH).astype(np.int32)
    return at[at <= last[runs[at] + 1]]


def cover_ranks(big: np.ndarray, suffixes: np.ndarray, size: int) -> np.ndarray:
    """At each sampled position in reach of the suffixes, its rank by 56 bytes."""
    wanted = np.zeros(size + PERIOD, bool)
    for d in range(PERIOD):
        wanted[suffixes[IN_COVER[(suffixes + d) % PERIOD]] + d] = True
    at = np.flatnonzero(wanted).astype(np.int32)
    order, new = np.arange(len(at), dtype=np.int32), np.zeros(len(at), bool)
    for k in DEPTH[::-1]:  # stable, from the last word to the first
        order = order[np.argsort(big[at[order] + k].astype(np.uint64), kind="stable")]
    for k in DEPTH:
        s = big[at[order] + k]
        new[1:] |= s[1:] != s[:-1]
    ranks = np.zeros(size + PERIOD, np.int32)
    ranks[at[order]] = np.cumsum(new, dtype=np.int32)
    return ranks


def by_ranks(suffixes: np.ndarray, group: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The suffixes, those of each group (equal leading bytes, side by side) in the order of their strings: a quicksort of
    all groups at once, whose comparisons are of cover ranks."""
    out, at, pos = suffixes.copy(), np.arange(len(suffixes)), suffixes
    r = np.random.default_rng(len(suffixes))
    while len(at):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        pivot = np.repeat(pos[first + (r.random(len(first)) * size).astype(np.int64)], size)
        d = MEETS[pos % PERIOD, pivot % PERIOD]
        side = np.repeat(np.arange(len(first)), size) * 3 + np.sign(ranks[pos + d] - ranks[pivot + d]) + 1
        order = np.argsort(side, kind="stable")
        pos, side = pos[order], side[order]
        out[at] = pos
        size = np.bincount(side)
        left = (side % 3 != 1) & (size[side] > 1)
        at, pos, group = at[left], pos[left], side[left]
    return out


def blocks_of(lead: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Positions in ``lead`` by ranges of its first two bytes, at most ``most`` in a range unless two bytes hold more."""
    prefix = (lead >> np.uint64(48)).astype(np.int64)
    block = np.bincount(prefix, minlength=1 << 16)
    total, block_of, number = 0, np.zeros(1 << 16, np.int32), 0
    for k in np.flatnonzero(block).tolist():
        total += int(block[k])
        if total > most and total > block[k]:
            number, total = number + 1, int(block[k])
        block_of[k] = number
    own = block_of[prefix]
    for n in range(number + 1):
        yield np.flatnonzero(own == n)


def ties(raw: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions of the suffixes whose 50 bytes also start in a run of a smaller document. ``raw`` holds the runs side
    by side, from ``ends[k]`` to ``ends[k + 1]``, and some bytes more; ``owner`` has each run's document. The samples are
    ranked first; then the suffixes are sorted one block of leading bytes at a time."""
    none = np.zeros(0, np.int64)
    if len(owner) < 2 or owner.min() == owner.max():
        return none
    runs = np.repeat(np.arange(len(owner), dtype=np.int32), np.diff(ends))  # of each position
    shared = sampled(words_of(raw), ends, runs, owner)
    at = in_reach(ends, runs, shared) if len(shared) else none
    if not len(at):
        return none
    big = words_of(raw, ">")
    ranks = cover_ranks(big, at, int(ends[-1]))
    lead = big[at].astype(np.uint64)
    return np.concatenate([tied_in_block(big, at[part], owner, runs, ranks) for part in blocks_of(lead, SORTED)])


def tied_in_block(big: np.ndarray, at: np.ndarray, owner: np.ndarray, runs: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Of suffixes, all of those with some leading bytes, the ones that tie with one of a smaller document."""
    lead = [big[at + k].astype(np.uint64) for k in LEAD]
    order = np.lexsort(lead[::-1])
    new = np.zeros(len(at), bool)
    new[0] = True
    for w in lead:
        s = w[order]
        new[1:] |= s[1:] != s[:-1]
    at = at[order]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    doc = owner[runs[at]]
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    at, group = at[np.repeat(several, size)], np.repeat(np.arange(several.sum()), size[several])
    if not len(at):
        return at
    at = by_ranks(at, group, ranks)
    same = group[1:] == group[:-1]
    for k in (24, 32, 40, 42):
        w = big[at + k]
        same &= w[1:] == w[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    doc = owner[runs[at]]
    return at[doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(at))))]


def settled(parts: list[Runs]) -> list[tuple[np.ndarray, ...]]:
    """All marks of a bucket."""
    runs, found = folded(parts)
    ends = runs.ends
    owner = np.empty(len(runs.strings), np.int64)
    owner[runs.run] = runs.doc
    raw = np.frombuffer(runs.strings.buffers()[2], np.uint8, int(ends[-1]))
    at = np.sort(ties(np.concatenate([raw, np.frombuffer(PAD, np.uint8)]), ends, owner))
    if not len(at):
        return [found]
    run = np.searchsorted(ends, at, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (run[1:] != run[:-1])]))
    n, run = np.diff(np.append(first, len(at))), run[first]
    into = at[first] - ends[run]
    by = np.argsort(runs.run, kind="stable")  # every place of the run
    lo, hi = np.searchsorted(runs.run[by], run, "left"), np.searchsorted(runs.run[by], run, "right")
    times = hi - lo
    place = by[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    return [found, (runs.doc[place], runs.h[place], runs.at[place] + np.repeat(into, times), np.repeat(n, times))]


def _sort_buckets(blocks: int):
    """One bucket at a time: the marks of its suffixes, by block of documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        bucket, parts, marks, size = None, [], [], 0
        for batch in slices(batches, 16):
            for b, kind, payload in zip(*(batch.column(c).to_pylist() for c in PACKED.names), strict=True):
                if b != bucket:
                    if parts:
                        marks += settled(parts)
                    bucket, parts = b, []
                    if sum(len(m[0]) for m in marks) > 1 << 19:
                        yield from packed_marks(marks, blocks)
                        marks = []
                if kind == MARKS:
                    ids, *_ = read_marks(payload)
                    yield int(ids[0] % blocks), MARKS, payload
                else:
                    parts.append(read_runs(b, payload))
        if parts:
            marks += settled(parts)
        yield from packed_marks(marks, blocks)

    return lambda batches: _rows(rows(batches))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"


def covered(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that marked suffixes cover."""
    if not len(first):
        return first, first
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate((first + n + LENGTH - 1)[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return a[new], b[np.append(new[1:], len(b)) - 1]


def _cut(texts_too: bool):
    """Rows sorted by (block, kind): a block's marks, then its texts."""

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block, known = None, {}
        for batch in slices(batches, 16):
            for b, kind, payload in zip(*(batch.column(c).to_pylist() for c in PACKED.names), strict=True):
                if b != block:
                    block, known = b, {}
                if kind == MARKS:
                    ids, hashes, counts, first, n = read_marks(payload)
                    cuts = np.cumsum(counts, dtype=np.int64)[:-1]
                    for x, y, p, q in zip(ids.tolist(), hashes.tolist(), np.split(first, cuts), np.split(n, cuts), strict=True):
                        known.setdefault((x, y), []).append((p, q))
                    continue
                unnamed, ids, hashes, sizes, raw = unpack(payload, np.uint8, np.int64, np.int64, np.uint32, np.uint8)
                ends = np.cumsum(sizes, dtype=np.int64).tolist()
                for no_id, i, h, lo, hi in zip(unnamed.tolist(), ids.tolist(), hashes.tolist(), [0, *ends], ends, strict=False):
                    text, marks = raw[lo:hi].tobytes(), () if no_id else known.get((i, h), ())
                    a, c = covered(*(np.concatenate(x).astype(np.int64) for x in zip(*marks, strict=True))) if marks else (np.zeros(0, np.int64),) * 2
                    kept = b"".join(text[x:y] for x, y in zip([0, *c.tolist()], [*a.tolist(), len(text)], strict=True))
                    yield None if no_id else i, len(text), int((c - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept if texts_too else None, [{"start": x, "end": y} for x, y in zip(a.tolist(), c.tolist(), strict=True)] if texts_too else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in results(batches):
            held.append(row)
            size += len(row[5] or b"") + 100
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), RESULT.types, strict=True)], schema=RESULT)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), RESULT.types, strict=True)], schema=RESULT)

    return run


def prime_from(n: int) -> int:
    """The least prime that is n or more."""
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return max(n, 2)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, bucket_bytes: int = 5 << 20, crowded_bytes: int = 10 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) for each row of ``docs``.

    Null text counts as empty. Rows of one id don't remove each other's bytes; rows without an id lose none and remove
    none. Strings are judged on the input, so what goes doesn't hide other repeats. Texts under 50 bytes stay whole.
    Texts of 4 GB and more can't be numbered and fail. An empty table gives an empty result.

    Buckets hold ``bucket_bytes`` of runs on average; one with over ``crowded_bytes`` is dealt anew. Which buckets
    are crowded is broadcast, one bit a bucket (a 40 millionth of the runs' bytes). Neither changes a result.
    """
    spark = docs.sparkSession
    i, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(i.alias("doc_id"), F.xxhash64(F.lit(1), i, text).alias("h"), text.alias("text"))
    ids = materialize(rows.select("doc_id", "h", F.octet_length("text").cast("long").alias("n")))
    total = ids.agg(F.sum("n")).first()[0] or 0
    several = materialize(ids.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b and doc_id is not null").select("doc_id"))
    release(ids)
    # a row is known by its id, and by its text's hash where the id has several texts
    if several.isEmpty():
        rows = rows.withColumn("h", F.lit(0).cast("long"))
    else:
        rows = rows.join(several.select(F.col("doc_id").alias("_several")), F.col("doc_id") == F.col("_several"), "left").withColumn("h", F.when(F.col("_several").isNotNull(), F.col("h")).otherwise(F.lit(0).cast("long"))).drop("_several")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-total * 4 // bucket_bytes))  # runs weigh up to four times their texts
    blocks = prime_from(max(shuffles, -(-total // (64 << 20))))  # ids in steps of anything fall on all blocks
    candidates = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    crowded = []
    while len(crowded) < len(GRAMS) - 1:
        sizes = candidates.mapInArrow(_sizes(buckets, crowded), "bucket long, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
        over = bitmap(sizes.where(F.col("bytes") > crowded_bytes), "bucket", buckets)
        if not over:
            break
        crowded.append(spark.sparkContext.broadcast(over))
    runs = candidates.mapInArrow(_deal(buckets, blocks, crowded), PACKED_SQL)
    parts = max(shuffles, -(-total * 4 // (32 << 20)))
    marked = runs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets(blocks), PACKED_SQL)
    block = F.pmod(F.coalesce("doc_id", F.xxhash64("text")), F.lit(blocks)).alias("block")
    both = marked.union(rows.select(block, "doc_id", "h", "text").mapInArrow(_pack_texts(blocks), PACKED_SQL))
    out = both.repartition(blocks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_cut(texts), RESULT_SQL)
    return out if texts else out.drop("kept", "spans")
