"""BPE encoding and decoding through a minimal acyclic transducer.

The corpus's most frequent words (counted over all documents) are compiled into a minimal acyclic automaton with shared
suffixes. Each arc carries how many words leave the state before it, so the sum along a path is the word's number,
and the numbers point into one array of token ids: the automaton's output. The arrays are one file, mapped into memory
by each worker. Words that the automaton doesn't have are merged exactly, pair by pair in rank order.

Bounds: ``lexicon_words`` caps the automaton (it's a cache for speed; no result depends on it); a worker's memo of
words is emptied at ``MEMO`` entries; the broadcast model is a vocabulary file of fixed size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os.path
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, slices

#: Words of byte-level BPE, as published with the vocabulary; its white space is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A stretch of ASCII within other text, from one blank between two letters, where a word begins, to another.
STRETCH = r"(?<=[A-Za-z]) [A-Za-z][\x00-\x7f]{60,}[A-Za-z](?= [A-Za-z])"
_words, _stretches = regex.compile(PATTERN).findall, re.compile(STRETCH).finditer
MEMO = 400_000
COUNTED = 500_000  # words that a task counts before it hands them on
LONGEST = 64  # bytes of a word in the lexicon
SHORT = 32  # bytes of a word that is merged side by side with others
NO_RANK = 2**30


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself if visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _plain_words():
    """``PATTERN`` for texts without characters above U+FFFF, where the plain engine reads them in under half the time;
    its classes are those of ``regex``, written out."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    letter, number, white = ("".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(rf"{c}+", every)) for c in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+").findall


_plain = _plain_words()


class Model:
    """A byte-level BPE vocabulary: bytes of each id, rank and result of each merge, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_alphabet().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw(s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        top = max(self.bytes_of) + 1
        self.bytes_at = [self.bytes_of.get(i, b"") for i in range(top)]
        self.name_at = list(map(str, range(top)))
        self.of_byte = [vocab.get(c) for _, c in sorted(byte_alphabet().items())]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.new_of = np.zeros(len(spec["model"]["merges"]), np.int32)  # by rank
        for rank, new in self.merges.values():
            self.new_of[rank] = new
        self.byte_ids = np.array(self.of_byte, np.int32)
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        """An open-addressing table of the pairs, read for many pairs at once."""
        bits = max(4, (8 * len(self.merges)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_pair, self.slot_rank, self.probes = np.full(2**bits + 64, -1, np.int64), np.full(2**bits + 64, NO_RANK, np.int32), 1
        for (a, b), (rank, _) in self.merges.items():
            at = int((a << 20 | b) * 0x9E3779B97F4A7C15 % 2**64 >> int(self.shift))
            start = at
            while self.slot_pair[at] >= 0:
                at += 1
            self.slot_pair[at], self.slot_rank[at] = a << 20 | b, rank
            self.probes = max(self.probes, at - start + 1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NO_RANK for pairs that don't merge; a negative id is none."""
        key = a.astype(np.int64) << 20 | b
        at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        there = self.slot_pair[at]
        out = np.where(there == key, self.slot_rank[at], NO_RANK)
        open_ = np.flatnonzero((there != key) & (there >= 0) & (key >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            there = self.slot_pair[at.flat[open_] + probe]
            hit = there == key.flat[open_]
            out.flat[open_[hit]] = self.slot_rank[at.flat[open_[hit]] + probe]
            open_ = open_[~hit & (there >= 0)]
        return out

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of many words at once: in each step every word makes its own best merge."""
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_width.setdefault(4 * -(-len(w) // 4), []).append(i)
        groups = [(w, m[lo : lo + 4096]) for w, m in by_width.items() for lo in range(0, len(m), 4096)]
        for width, members in groups:
            if width > SHORT or width == 0:
                for i in members:
                    out[i] = self.merge(words[i])
                continue
            rows = np.array(members)
            size = np.fromiter((len(words[i]) for i in members), np.int64, len(members))
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in members), np.uint8).reshape(-1, width)
            ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], np.int32(-1))
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(rows):
                at = rank.argmin(axis=1)
                line = np.arange(len(rows))
                best = rank[line, at]
                done = best == NO_RANK
                if done.any():
                    for i, row, n in zip(rows[done].tolist(), ids[done].tolist(), size[done].tolist(), strict=True):
                        out[i] = row[:n]
                    rows, ids, rank, at, best, size = (x[~done] for x in (rows, ids, rank, at, best, size))
                    line = np.arange(len(rows))
                if not len(rows):
                    break
                ids[line, at] = self.new_of[best]
                late = np.arange(ids.shape[1] - 1) > at[:, None]  # what stands behind the merge moves one place up
                ids = np.concatenate([np.where(late, ids[:, 1:], ids[:, :-1]), np.full((len(rows), 1), -1, np.int32)], axis=1)
                rank = np.concatenate([np.where(late[:, :-1], rank[:, 1:], rank[:, :-1]), np.full((len(rows), 1), NO_RANK, np.int32)], axis=1)
                size = size - 1
                nxt = at + 1 < ids.shape[1]
                rank[line[nxt], at[nxt]] = self.ranks(ids[line[nxt], at[nxt]], ids[line[nxt], at[nxt] + 1])
                prv = at > 0
                rank[line[prv], at[prv] - 1] = self.ranks(ids[line[prv], at[prv] - 1], ids[line[prv], at[prv]])
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of least rank first, leftmost on ties; n log n for long words."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) < 2:
            return ids
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[p], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or (now := merges.get((ids[i], ids[j]))) is None or now[1] != new:
                continue
            ids[i], ids[j] = new, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := merges.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (p[0], i, p[1]))
            if (h := before[i]) >= 0 and (p := merges.get((ids[h], new))) is not None:
                heapq.heappush(heap, (p[0], h, p[1]))
        return [x for x in ids if x is not None]


def build_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arcs as state * 256 + byte, sorted; their targets; their numbers, then whether each state is final.

    Incremental construction (Daciuk et al. 2000): states are merged with an equal one as soon as no word can change
    them, so the automaton is minimal at any time.
    """
    arcs: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    known: dict[tuple, int] = {}
    path = [0]
    last = b""

    def settle(down_to: int) -> None:
        while len(path) > down_to + 1:
            state = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            same = known.setdefault(key, state)
            if same != state:
                arcs[path[-1]][last[len(path) - 1]] = same

    for word in words:
        shared = len(os.path.commonprefix([word, last]))
        settle(shared)
        for b in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    number, order, stack = {}, [], [0]
    seen = {0}
    while stack:  # reachable states
        s = stack.pop()
        order.append(s)
        for t in arcs[s].values():
            if t not in seen:
                seen.add(t)
                stack.append(t)
    number = {s: i for i, s in enumerate(order)}
    count: dict[int, int] = {}
    for s in _postorder(arcs):
        count[s] = final[s] + sum(count[t] for t in arcs[s].values())
    first, label, target, skip = [0], [], [], []
    for s in order:
        before = int(final[s])
        for b, t in sorted(arcs[s].items()):
            label.append(b)
            target.append(number[t])
            skip.append(before)
            before += count[t]
        first.append(len(label))
    key = np.repeat(np.arange(len(order)), np.diff(first)) * 256 + np.array(label, np.int64) if label else np.zeros(0, np.int64)
    return key.astype(np.int64), np.array(target, np.int64), np.array([*skip, *(final[s] for s in order)], np.int64)


def _postorder(arcs: list[dict[int, int]]) -> list[int]:
    out, done, stack = [], set(), [(0, False)]
    while stack:
        s, ready = stack.pop()
        if ready:
            out.append(s)
        elif s not in done:
            done.add(s)
            stack.append((s, True))
            stack.extend((t, False) for t in arcs[s].values() if t not in done)
    return out


class Lexicon:
    """The transducer, mapped from a file: word to token ids."""

    PARTS = ("key", "target", "skip", "offset", "ids")

    @staticmethod
    def compile(words: list[bytes], model: Model) -> bytes:
        words = sorted(set(words))
        key, target, skip = build_automaton(words)
        merged = model.merge_many(words)
        offset = np.concatenate([[0], np.cumsum([len(m) for m in merged])]).astype(np.int64)
        arrays = [key, target, skip, offset, np.array([i for m in merged for i in m])]
        return np.concatenate([[len(a) for a in arrays], *arrays]).astype(np.int32).tobytes()

    def __init__(self, path: str):
        data = np.asarray(np.memmap(path, np.int32, "r"))  # still mapped, without the subclass's cost for each slice
        at = len(self.PARTS)
        for name, n in zip(self.PARTS, data[:at].tolist(), strict=True):
            setattr(self, name, data[at : at + n])
            at += n
        self.final = self.skip[len(self.key) :]

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for words that it doesn't have; all words take a step at a time."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.key) or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.flatnonzero((size > 0) & (size <= LONGEST))
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        text = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for step in range(LONGEST + 1):
            ended = size[rows] == step
            accepted = ended & (self.final[state] == 1)
            out[rows[accepted]] = number[accepted]
            rows, state, number = rows[~ended], state[~ended], number[~ended]
            if not len(rows):
                break
            key = state * 256 + text[start[rows] + step]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            there = self.key[arc] == key
            rows, arc = rows[there], arc[there]
            state, number = self.target[arc].astype(np.int64), number[there] + self.skip[arc]
        return out

    def many(self, numbers: list[int]) -> Iterator[list[int]]:
        """The outputs of many words."""
        at = np.array(numbers, np.int64)
        starts, ends, ids = self.offset[at].tolist(), self.offset[at + 1].tolist(), self.ids
        for a, b in zip(starts, ends, strict=True):
            yield ids[a:b].tolist()

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.offset[number] : self.offset[number + 1]].tolist()


def split_words(text: str) -> list[str]:
    """The words of ``PATTERN``, in order."""
    if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
        return _plain(text)
    out, at = [], 0
    for found in _stretches(text):
        out += _words(text[at : found.start()])
        out += _plain(found[0])
        at = found.end()
    out += _words(text[at:])
    return out


class Encoder:
    """Encodes and decodes texts; one for each worker process."""

    def __init__(self, model: Model, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(model.special, key=len, reverse=True)) + ")") if model.special else None
        self.names: dict[str, str] = {}  # a word's ids, joined by commas
        self.pieces: dict[str, bytes] = {}  # their bytes

    def parts(self, text: str) -> list[str]:
        """Words, with special strings as words of their own."""
        if self.split is None or not any(s in text for s in self.model.special):
            return split_words(text)
        return [w for i, p in enumerate(self.split.split(text)) for w in ([p] if i % 2 else split_words(p))]

    def learn(self, words: set[str]) -> None:
        """Remember words: those of the automaton by its output, the others by merging."""
        if len(self.names) > MEMO:
            self.names.clear()
            self.pieces.clear()
        fresh = [w for w in words if w not in self.names]
        raw = [w.encode("utf-8", "replace") for w in fresh]
        found = self.lexicon.find(raw).tolist()
        unseen = iter(self.model.merge_many([b for b, number in zip(raw, found, strict=True) if number < 0]))
        of, name, names, pieces = self.model.bytes_at, self.model.name_at, self.names, self.pieces
        hits = self.lexicon.many([number for number in found if number >= 0])
        for word, number in zip(fresh, found, strict=True):
            ids = next(hits if number >= 0 else unseen)
            if len(ids) == 1:
                names[word], pieces[word] = name[ids[0]], of[ids[0]]
            else:
                names[word], pieces[word] = ",".join([name[i] for i in ids]), b"".join([of[i] for i in ids])
        for word, i in self.model.special.items():
            if word in names:
                names[word], pieces[word] = name[i], of[i]

    def encode(self, text: str) -> list[int]:
        words = self.parts(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.names[w].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.model.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids and of the decoded text; the pieces are those of each word's ids."""
        out = []
        for lo in range(0, len(texts), 512):
            parts = [self.parts(t) for t in texts[lo : lo + 512]]
            self.learn(set().union(*parts))
            name, piece = self.names.__getitem__, self.pieces.__getitem__
            for words in parts:
                ids = ",".join(map(name, words))
                decoded = b"".join(map(piece, words)).decode("utf-8", "replace")
                out.append((ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(model: Broadcast, lexicon: Broadcast, name: str) -> Encoder:
    """The process's encoder; the lexicon's file is mapped and unlinked, so nothing stays behind."""
    if name not in _encoders:
        with tempfile.NamedTemporaryFile(prefix="quillon-lexicon-") as f:
            f.write(lexicon.value)
            f.flush()
            mapped = Lexicon(f.name)
        _encoders.clear()
        _encoders[name] = Encoder(model.value, mapped)
    return _encoders[name]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n): how often each word occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()

        def out():
            rows = [(w.encode("utf-8", "replace"), n) for w, n in seen.items()]
            for i in range(0, len(rows), 20_000):
                w, n = zip(*rows[i : i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(split_words(text))
                if len(seen) > COUNTED:
                    yield from out()
                    seen.clear()
        yield from out()

    parts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Tokenizer:
    """Compiled for a corpus: model and lexicon, broadcast."""

    def __init__(self, docs: DataFrame, path: str, text_col: str = "text", lexicon_words: int = 50_000):
        model = Model(path)
        counts = word_counts(docs, text_col).where((F.length("word") <= LONGEST) & (F.col("n") > 1))
        counts = materialize(counts.withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
        least, held = 0, 0  # of the levels of frequency (under 1024), as many from the top as fit
        for level, words in sorted(counts.groupBy("level").count().collect(), reverse=True):
            held += words
            if held > lexicon_words:
                least = level + 1
                break
        frequent = [bytes(r[0]) for r in counts.where(F.col("level") >= least).select("word").toLocalIterator()]
        compiled = Lexicon.compile(frequent, model)
        context = docs.sparkSession.sparkContext
        self.name = hashlib.sha256(compiled).hexdigest()[:24]
        self.model, self.lexicon = context.broadcast(model), context.broadcast(compiled)

    def _map(self, docs: DataFrame, text_col: str, fn, columns: list[str], schema: str) -> DataFrame:
        model, lexicon, name = self.model, self.lexicon, self.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = encoder(model, lexicon, name)
            for batch in slices(batches):
                yield fn(enc, batch)

        return docs.select(*columns, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).mapInArrow(run, schema)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, ids array<int>): the token ids themselves."""
        fn = lambda enc, b: pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([enc.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])
        return self._map(docs, text_col, fn, [id_col], "doc_id long, ids array<int>")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(doc_id, text) of (doc_id, ids)."""
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = model.value.bytes_at
            for b in slices(batches):
                texts = [b"".join(of[i] for i in ids or ()).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

    def digest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row. Null text counts as empty: no tokens."""

        def fn(enc: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, text = zip(*enc.digests(b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return self._map(docs, text_col, fn, [id_col], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
