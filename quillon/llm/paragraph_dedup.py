"""Near-duplicate paragraphs: MinHash banding, exact verification, removal by components.

A paragraph is a line that isn't blank. Paragraphs of equal words are one class from the start; of each class one is
signed with MinHash values over five-word shingles. Twelve bands of three values let a pair of similarity 0.8 through
with probability 1 - (1 - 0.8^3)^12 = 0.9998. A set of up to three shingles is similar to its equal alone, so it has one
key, of the whole set, in place of bands. Paragraphs that share a band are joined to the first of its list (no pairs are
given out), the joins' components are the candidate groups, and within each group the exact Jaccard similarity of the
shingle sets decides. Verified links are closed into components; of each the first paragraph, by document, text and
place, stays.

A group is searched by visiting each member once and comparing it with those not yet reached, so a group of near
copies costs about one pass. Joins that aren't verified chain: where paragraphs of little similarity meet in some band,
groups grow together. A group over ``group_limit`` is therefore not searched as a whole but list by list: a similar
pair has met in some band, so comparing within that band's members finds it. A list over the limit is dealt out as pairs
of chunks, each pair a task of at most two chunks, and loses no link by it.

Band keys are dealt to buckets, packed: each task joins the equal keys it has itself and sends one row a key, so a key
that most paragraphs share costs one a task. Paragraphs are named there by 48 bits of their words' hash and keys by 50
bits; a collision only adds a candidate. Texts are then read again for the words of candidates alone.

A passage may also repeat inside lines that differ, or across line breaks. Of each document's strings of 40 words,
whatever its lines, winnowing takes the least hash of every 12 in a row: a run of more than 50 words that two documents
share holds a string that is taken in both. ``n_shared`` counts the taken strings that another document's have too; it
is zero where no 40 words are shared, and changes nothing of what is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bitmap, connected_components, materialize, slices, sorted_groups
from quillon.llm.simhash import text_hash

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS, WHOLE = 12, 3, 3
MEMO = 200_000
GRAM, REACH = 40, 12  # a run of GRAM + REACH - 1 words holds a string that is taken
BUCKETS, FLUSH, FILTER_BITS = 1024, 250_000, 1 << 27
_rng = np.random.Generator(np.random.PCG64(20240501))
_A = _rng.integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)
LONG, BLOCK = 32, 1 << 17
_TABLE = _rng.integers(0, 2**64, LONG << 8, np.uint64)
_IN_WORD = ~np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_C = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WIDTH + 1)], np.uint64)


def fold(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, and where they start. Up to 32 bytes: the sum of a random number for each byte and its
    place (tabulation; two words collide with probability 2^-64); longer ones: XXH64. Taken by blocks of the text."""
    raw = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(_IN_WORD[raw], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    out, lo = np.empty(len(start), np.uint64), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + BLOCK, "right")))
        if hi == lo + 1 and end[lo] - start[lo] > LONG:
            out[lo] = xxhash.xxh64_intdigest(text[start[lo] : end[lo]])
        else:
            base = start[lo]
            a, b = start[lo:hi] - base, end[lo:hi] - base
            place = np.arange(b[-1]) - np.repeat(a, np.diff(a, append=b[-1]))
            sums = np.zeros(len(place) + 1, np.uint64)
            np.cumsum(_TABLE[np.minimum(place, LONG - 1) << 8 | raw[base : base + b[-1]]], out=sums[1:])
            out[lo:hi] = sums[b] - sums[a]
            for k in (lo + np.flatnonzero(b - a > LONG)).tolist():
                out[k] = xxhash.xxh64_intdigest(text[start[k] : end[k]])
        lo = hi
    return out, start


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of paragraphs, given as words with a blank between, one after the other, and where each paragraph's
    start. A paragraph of fewer than five words (at least one) has one shingle: all its words."""
    flat, _ = word_hashes(b"\n".join(words))
    size = np.fromiter((w.count(b" ") + 1 for w in words), np.int64, len(words))
    first = np.cumsum(size) - size
    count = np.maximum(size - WIDTH + 1, 1)
    start = np.cumsum(count) - count
    at = np.arange(count.sum()) - np.repeat(start, count) + np.repeat(first, count)
    last = np.repeat(first + size, count)
    out = np.repeat(np.minimum(size, WIDTH), count).astype(np.uint64)
    padded = np.append(flat, np.zeros(WIDTH, np.uint64))
    for k in range(WIDTH):
        out = fold(out + np.where(at + k < last, padded[at + k] * _C[k], np.uint64(0)))
    return out, start


def bands(values: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Each paragraph's band keys, or the one key of a set of up to three shingles."""
    out = np.empty((len(start), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(start), b + 1, np.uint64)
        for r in range(b * ROWS, b * ROWS + ROWS):
            key = fold(key * np.uint64(0xC2B2AE3D27D4EB4F) + np.minimum.reduceat(fold(values * _A[r] + _B[r]), start))
        out[:, b] = key
    out, ends = out.view(np.int64), np.append(start[1:], len(values))
    few = {}
    for i in np.flatnonzero(ends - start <= WHOLE).tolist():  # more shingles are different ones, but for repeats: bands will do
        some = np.unique(values[start[i] : ends[i]])
        few[i] = np.array([xxhash.xxh64_intdigest(some.tobytes(), len(some)) >> 1], np.int64)
    return [few.get(i, x) for i, x in enumerate(out)]


def paragraphs(text: str) -> list[tuple[int, list[bytes]]]:
    """(line number, lower-case words) of each line with words."""
    return [(i, w) for i, line in enumerate(text.encode("utf-8", "replace").lower().split(b"\n")) if (w := line.split())]


SIGNED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("para", pa.int32()), ("ph", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(min_words: int, banded: bool = True):
    """Paragraphs with their band keys, those that the task has signed before without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, 500):
            rows, fresh, words = [], [], []
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for line, w in paragraphs(text):
                    if len(w) >= min_words:
                        one = b" ".join(w)
                        ph = xxhash.xxh3_128_digest(one)
                        if banded and ph not in seen:
                            seen.add(ph)
                            fresh.append(len(rows))
                            words.append(one)
                        rows.append((i, h, line, ph))
            if len(seen) > MEMO:
                seen.clear()
            if rows:
                signed: list = [None] * len(rows)
                if words:
                    for at, x in zip(fresh, bands(*shingles(words)), strict=True):
                        signed[at] = x
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SIGNED.types, strict=False)), pa.array(signed, pa.list_(pa.int64()))], schema=SIGNED)

    return run


def _fresh_keys(min_words: int):
    """Band keys and the names of the paragraphs that have them, from (text): paragraphs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen = set()
        for batch in slices(batches, 250):
            words, names = [], []
            for text in batch.column(0).to_pylist():
                for _, w in paragraphs(text):
                    if len(w) >= min_words:
                        one = b" ".join(w)
                        ph = xxhash.xxh3_128_digest(one)
                        if ph not in seen:
                            seen.add(ph)
                            words.append(one)
                            names.append(int.from_bytes(ph[:6], "little"))
            if len(seen) > MEMO:
                seen.clear()
            if words:
                keys = bands(*shingles(words))
                yield np.concatenate(keys).view(np.uint64), np.repeat(np.array(names, np.uint64), [len(x) for x in keys])

    return run


DEALT = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("pairs", pa.binary())])
DEALT_SQL = "bucket int, settled boolean, pairs binary"


def pack(a: np.ndarray, b: np.ndarray, wide: int, long: int) -> np.ndarray:
    """A row of bytes a pair: the low bytes of each."""
    low = [np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :n] for x, n in ((a, wide), (b, long))]
    return np.concatenate(low, axis=1)


def unpack(data: bytes, wide: int, long: int) -> list[np.ndarray]:
    rows = np.frombuffer(data, np.uint8).reshape(-1, wide + long)
    out = []
    for lo, n in ((0, wide), (wide, long)):
        x = np.zeros((len(rows), 8), np.uint8)
        x[:, :n] = rows[:, lo : lo + n]
        out.append(x.view("<u8").ravel())
    return out


def deal(a: np.ndarray, b: np.ndarray, settled: tuple[np.ndarray, np.ndarray], wide: int, long: int) -> pa.RecordBatch:
    """Pairs (a, b), sorted by a, by the leading bits of a; settled ones in a row of their own."""
    cut = np.searchsorted(a, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(54))
    cut[-1] = len(a)
    rows = pack(a, b, wide, long)
    out = [(k, False, rows[cut[k] : cut[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cut)).tolist()]
    if len(settled[0]):
        out.append((int(settled[0][0]) % BUCKETS, True, pack(*settled, 8, 8).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), DEALT.types, strict=True)], schema=DEALT)


def met(table: pa.Table, wide: int, long: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The pairs of whole buckets, a with its bucket in the leading bits, and the settled ones."""
    a, b, done = [], [], [np.zeros(0, np.uint64)] * 2
    for bucket, settled, data in zip(*(c.to_pylist() for c in table.columns), strict=True):
        if settled:
            done = [np.concatenate(x) for x in zip(done, unpack(data, 8, 8), strict=True)]
        else:
            x, y = unpack(data, wide, long)
            a.append((x & np.uint64((1 << 54) - 1)) | np.uint64(bucket << 54))
            b.append(y)
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)], done


def in_order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs by a, then b, and whether each is the first of its a."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.append(True, a[1:] != a[:-1])[: len(a)]
    own = first | np.append(True, b[1:] != b[:-1])[: len(a)]
    return a[own], b[own], first[own]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least b of each a, and links that join the others of an a to it, each link once."""
    a, b, first = in_order(a, b)
    low = b[first][np.cumsum(first) - 1] if len(b) else b
    x, y, _ = in_order(b[~first], low[~first])
    return a[first], b[first], x, y


def _named(phs: pa.Array) -> np.ndarray:
    """Paragraphs' names among candidates: 48 bits of their words' hash."""
    return np.frombuffer(b"".join(phs.to_pylist()), "<u8")[::2] & np.uint64((1 << 48) - 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Band keys and the names of the paragraphs that have them, from (ph, bands)."""
    for batch in batches:
        phs, keys = batch.columns
        if batch.num_rows:
            yield keys.flatten().to_numpy().view(np.uint64), np.repeat(_named(phs), keys.value_lengths().to_numpy())


def _deal_keys(batches: Iterator[pa.RecordBatch], read=_keys) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for pair in read(batches):
        held.append(pair)
        n += len(pair[0])
        if n >= FLUSH:
            a, b, *links = stars(*map(np.concatenate, zip(*held, strict=True)))
            yield deal(a, b, links, 5, 6)
            held, n = [], 0
    if held:
        a, b, *links = stars(*map(np.concatenate, zip(*held, strict=True)))
        yield deal(a, b, links, 5, 6)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in sorted_groups(slices(batches), "bucket"):
        (a, b), done = met(table, 5, 6)
        _, _, x, y = stars(a, b)
        yield pa.RecordBatch.from_arrays([np.concatenate(z).view(np.int64) for z in zip((x, y), done, strict=True)], ["a", "b"])


def _listed(shared, read=_keys):
    """(key, node): the band keys of paragraphs in a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for keys, names in read(batches):
            at = names & np.uint64(FILTER_BITS - 1)
            some = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (keys, names)], ["key", "node"])

    return run


def _take_words(shared):
    """(node, ph, words): the words of paragraphs in a filter, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in slices(batches):
            out = []
            for text in batch.column(0).to_pylist():
                for _, w in paragraphs(text):
                    words = b" ".join(w)
                    ph = xxhash.xxh3_128_digest(words)
                    name = int.from_bytes(ph[:6], "little")
                    at = name % FILTER_BITS
                    if bits[at >> 3] >> (at & 7) & 1 and ph not in seen:
                        seen.add(ph)
                        out.append((name, ph, words))
            if len(seen) > MEMO:
                seen.clear()
            if out:
                nodes, phs, words = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(phs, pa.binary()), pa.array(words, pa.binary())], ["node", "ph", "words"])

    return run


def sliding(x: np.ndarray, f: np.ufunc, width: int) -> np.ndarray:
    """``f`` over every ``width`` values in a row."""
    k = 1
    while 2 * k <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - width + k], x[width - k :]) if k < width else x


_BASE = 0x9E3779B97F4A7C15
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def taken(values: np.ndarray) -> np.ndarray:
    """Hashes of the 40-word strings that winnowing takes of a document's words, different ones."""
    n = len(values)
    if n < GRAM + REACH - 1:
        return np.zeros(0, np.uint64)
    if len(_power[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _power[k] = np.cumprod(np.append(np.uint64(1), np.full(2 * n, base, np.uint64)), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(values * _power[0][:n], dtype=np.uint64))
    grams = fold((sums[GRAM:] - sums[:-GRAM]) * _power[1][: n - GRAM + 1])
    edge = np.zeros(REACH - 1, np.uint64)
    least = sliding(grams, np.minimum, REACH)
    return np.unique(grams[sliding(np.concatenate([edge, least, edge]), np.maximum, REACH) == grams])


def shared_by_several(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings a of documents b, sorted; the first of each string and whether documents differ on it. A document's lowest
    bit tells that the pair has been settled."""
    a, b, first = in_order(a, b)
    at = np.cumsum(first) - 1
    several = np.bincount(at, (b | np.uint64(1)) != (b[first] | np.uint64(1))[at], first.sum()) > 0 if len(a) else first
    return a, b, first, several[at] if len(a) else first


def _deal_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        a, b, first, several = shared_by_several(*map(np.concatenate, zip(*held, strict=True)))
        return deal(a[first], b[first] | several[first].astype(np.uint64), (b[several], a[several]), 7, 8)

    for batch in slices(batches, 64):
        ds, texts = batch.column(0).to_pylist(), [t.encode("utf-8", "replace").lower() for t in batch.column(1).to_pylist()]
        hashes, start = word_hashes(b"\n".join(texts))
        cut = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])).tolist()
        for d, lo, hi in zip(ds, [0, *cut], cut, strict=False):
            grams = taken(hashes[lo:hi])
            if len(grams):
                held.append((grams, np.full(len(grams), d & ((1 << 64) - 2), np.uint64)))
                n += len(grams)
        if n >= FLUSH:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in sorted_groups(slices(batches), "bucket"):
        (a, b), done = met(table, 7, 8)
        a, b, _, several = shared_by_several(a, b)
        fresh = several & (b & np.uint64(1) == 0)
        yield pa.RecordBatch.from_arrays([np.concatenate(z).view(np.int64) for z in zip((b[fresh], a[fresh]), done, strict=True)], ["d", "gram"])


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, n_shared): how many of the 40-word strings taken of a document another has too, where any; d from
    ``_document``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    dealt = docs.select(_document(id_col, text_col).alias("d"), text.alias("text")).mapInArrow(_deal_passages, DEALT_SQL)
    met_ = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "d long, gram long")
    return met_.distinct().groupBy("d").agg(F.count("*").alias("n_shared"))


def _document(id_col: str, text_col: str) -> Column:
    """A document's name: its id and text, 63 bits."""
    return F.xxhash64(F.col(id_col).cast("long"), text_hash(text_col)).bitwiseAND(F.lit(-2))


def similar_forest(sets: list[np.ndarray], threshold: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that span all pairs of at least this Jaccard similarity."""
    size = np.array([len(s) for s in sets])
    flat, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    mark = np.zeros(len(flat), bool)
    left, links = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], front = False, [seed]
        while front:
            at = front.pop()
            open_ = left[owner]
            if len(owner) > 1000 and open_.sum() * 2 < len(owner):  # forget those that are done
                code, owner = code[open_], owner[open_]
            own = np.searchsorted(flat, sets[at])
            mark[own] = True
            shared = np.bincount(owner[mark[code]], minlength=len(sets))
            mark[own] = False
            near = np.flatnonzero(left & (shared >= threshold * (size[at] + size - shared) - 1e-9) & (shared > 0))
            left[near] = False
            links += [(at, int(j)) for j in near]
            front.extend(near.tolist())
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in sorted_groups(batches, "deal"):
        a, b, group, last = [], [], {}, None

        def link(group=group, a=a, b=b) -> None:
            if len(group) > 1:
                phs = list(group)
                values, start = shingles(list(group.values()))
                for i, j in similar_forest([np.unique(x) for x in np.split(values, start[1:])]):
                    a.append(phs[i]), b.append(phs[j])
            group.clear()

        for d, ph, words in zip(*(table.column(c).to_pylist() for c in ("deal", "ph", "words")), strict=True):
            if d != last:
                link()
                last = d
            group[ph] = words  # several tasks may have brought it
        link()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _filter_of(nodes: DataFrame):
    at = nodes.select(F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("at"))
    return nodes.sparkSession.sparkContext.broadcast(bitmap(at, "at", FILTER_BITS) or bytes(FILTER_BITS // 8))


def compared(rows: DataFrame, distinct: DataFrame | None, group_limit: int, min_words: int = 1) -> DataFrame:
    """(deal, ph, words): the paragraphs that meet, those of one deal together: a group, or a pair of a large group's
    list's chunks. A paragraph may come several times. The texts are signed by the worker that deals out their keys,
    unless ``distinct`` has the paragraphs' keys."""
    if distinct is None:
        keys, read = rows.select("text"), _fresh_keys(min_words)
    else:
        keys, read = distinct.select("ph", F.col("at.bands").alias("bands")), _keys
    links = keys.mapInArrow(lambda batches: _deal_keys(batches, read), DEALT_SQL).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_stars, "a long, b long")
    groups = materialize(connected_components(links))
    large = materialize(groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select("component"))
    words = rows.select("text").mapInArrow(_take_words(_filter_of(groups)), "node long, ph binary, words binary")
    deals = groups.join(large, "component", "left_anti").select("node", F.concat(F.lit("g"), "component").alias("deal"))
    if not large.isEmpty():
        members = materialize(groups.join(large, "component", "left_semi").select("node"))
        lists = materialize(keys.mapInArrow(_listed(_filter_of(members), read), "key long, node long").join(members, "node", "left_semi").distinct())
        lengths = lists.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key", F.ceil(F.col("n") / group_limit).cast("int").alias("chunks"))
        own = lists.join(lengths, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        deals = deals.union(other.select("node", F.concat_ws(":", F.lit("k"), "key", F.least("own", "other"), F.greatest("own", "other"))))
    return words.join(deals, "node").select("deal", "ph", "words")


def paragraph_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1, group_limit: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Two tables: every compared paragraph (doc_id, h, para), h the text's hash; and, for those in a class of several,
    (doc_id, h, para, class_doc, class_para, goes): the class's first paragraph, which is the one to keep, by document,
    text and place, and whether this is another."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    columns = "doc_id long, h long, para int, ph binary, bands array<long>"
    signed = materialize(rows.mapInArrow(_sign(min_words, banded=False), columns).drop("bands"))
    pairs = compared(rows, None, group_limit, min_words).repartition("deal").sortWithinPartitions("deal", "ph")
    links = connected_components(materialize(pairs.mapInArrow(_verify, "a binary, b binary")))
    # a class's first paragraph is found among the first ones of equal words, so the paragraphs themselves join once
    each = signed.groupBy("ph").agg(F.min(F.struct("doc_id", "h", "para")).alias("first"), F.count("*").alias("n"))
    each = each.join(links, F.col("ph") == F.col("node"), "left").where((F.col("n") > 1) | F.col("component").isNotNull())
    each = materialize(each.select("ph", "first", "n", F.coalesce("component", "ph").alias("cls")))
    first = each.groupBy("cls").agg(F.min("first").alias("_first"), F.sum("n").alias("n")).where(F.col("n") > 1).drop("n")
    members = signed.join(each.select("ph", "cls").join(first, "cls").select("ph", "_first"), "ph")
    goes = ~F.struct("doc_id", "h", "para").eqNullSafe(F.col("_first"))
    return signed.select("doc_id", "h", "para"), members.select("doc_id", "h", "para", F.col("_first.doc_id").alias("class_doc"), F.col("_first.para").alias("class_para"), goes.alias("goes"))


def _count(text_col: str, min_words: int = 1) -> Column:
    """How many paragraphs a text has."""
    white = "[ \\t\\r\\x0B\\f]"
    some = f"(?:{white.replace('[', '[^')}+{white}+){{{min_words - 1}}}{white.replace('[', '[^')}"
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)
    return F.size(F.filter(lines, lambda x: x.rlike(some))).cast("long")


def _judged(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(doc_id, h, class_id, n_paragraphs, n_removed, removed, classes): a row's id, its text's hash and what goes."""
    _, members = paragraph_classes(docs, id_col, text_col, **options)
    found = members.distinct().groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("para", "class_doc", "class_para"))).alias("classes"), F.sort_array(F.collect_list(F.when(F.col("goes"), F.col("para")))).alias("removed"), F.min("class_doc").alias("class_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("_i"), text_hash(text_col).alias("_h"), _count(text_col, options.get("min_words", 1)).alias("n_paragraphs"))
    same = F.col("_i").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h"))
    out = rows.join(found, same, "left")
    none = F.array().cast("array<int>")
    return out.select(F.col("_i").alias("doc_id"), F.col("_h").alias("h"), F.coalesce("class_id", "_i").alias("class_id"), "n_paragraphs", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"), F.coalesce("classes", F.array().cast("array<struct<para:int,class_doc:bigint,class_para:int>>")).alias("classes"))


def near_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, n_paragraphs, n_removed, removed, classes, n_shared) for each row of ``docs``.

    class_id is the smallest document that keeps a paragraph of the row's classes (its own id if none is shared).
    n_paragraphs counts the compared ones (of at least ``min_words`` words). removed has the line numbers that go;
    classes has (para, class_doc, class_para) of every paragraph in a class of several, the kept one included.
    n_shared counts the row's taken 40-word strings that another document has: over 0 wherever a passage of over 50 words
    repeats, inside lines too; those of a first document count as well. Null and empty texts have no paragraphs. A row is known by its id and its text: rows repeated in both are one document
    here, returned for each row, and agree; several texts of one id, or of none, are several documents. A null id ranks
    before all others. An empty table gives an empty result.
    """
    judged = _judged(docs, id_col, text_col, **options).withColumn("d", F.xxhash64("doc_id", "h").bitwiseAND(F.lit(-2)))
    passages = materialize(shared_passages(docs, id_col, text_col))
    return judged.join(passages, "d", "left").drop("h", "d").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)).cast("long"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the removed lines gone from their texts, all columns kept."""
    found = _judged(docs, id_col, text_col, **options).where(F.col("n_removed") > 0).groupBy(F.col("doc_id").alias("_quillon_i"), F.col("h").alias("_quillon_h")).agg(F.first("removed").alias("_quillon_gone"))
    joined = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("_quillon_i")) & (text_hash(text_col) == F.col("_quillon_h")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_quillon_gone", i)), "\n")
    text = F.when(F.col("_quillon_gone").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))
