"""Operators against plain re-computations on the smallest tables."""

import hashlib
import random
import re
import types
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, common, exact_dedup, mixing, paragraph_dedup, pii, quality, queries, simhash, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] or "" for r in rows}


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(1)
    edges = [(a, a + r.randint(1, 3)) for a in range(0, 400, 2)] + [(1000, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(60)]
    u = Union({x for e in edges for x in e})
    for e in edges:
        u.link(*e)
    got = {x[0]: x[1] for x in common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {x: u.find(x) for x in u.up}


def test_topk_is_the_oracle(spark, sf_dir):
    got = defaultdict(list)
    for r in queries.op1_topk(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = {r[0]: np.floor(256 * np.array(r[1], np.float64)).astype(np.int64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()}
    for q in (i for i in v if i % 50 == 0):
        assert got[q] == sorted(((i, int(v[q] @ x)) for i, x in v.items() if i != q), key=lambda p: (-p[1], p[0]))[:5]


@pytest.mark.parametrize("long_list", [16384, 2])
def test_simhash(spark, sf_dir, texts, long_list):
    prints = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    u, ids = Union(texts), sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                u.link(a, b)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs, long_list=long_list).collect()}
    assert got == {i: (f"{prints[i]:016x}", u.find(i)) for i in texts}


@pytest.mark.parametrize("long_list", [16384, 3])
def test_simhash_links_of_crowded_prints(spark, long_list):
    """Prints around a few centres: lists are long, links many, components chained."""
    r = random.Random(2)
    prints = set()
    for c in (r.getrandbits(64) for _ in range(3)):
        for _ in range(120):
            x = c
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    u = Union(prints)
    for k, a in enumerate(prints):
        for b in prints[k + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                u.link(a, b)
    got = Union(prints)
    for a, b in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), long_list).collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
        got.link(a, b)
    assert all(got.find(p) == u.find(p) for p in prints)


def test_exact_spills(spark, texts):
    """A budget far under the data makes every partition split its rows into files."""
    rows = [(xxhash.xxh64_intdigest(t.encode()) >> 1, t.encode(), 1, i) for i, t in texts.items()]
    entries = [e for part in exact_dedup.grace(iter(rows), 20_000, fan_out=3) for e in part]
    want = defaultdict(list)
    for i, t in texts.items():
        want[t.encode()].append(i)
    assert {e[1]: (e[2], e[3]) for e in entries} == {t: (len(i), max(i)) for t, i in want.items()} and len(entries) == len(want)


def test_exact_collisions():
    """Equal hashes, different contents."""
    t = exact_dedup.ContentTable()
    for k in range(3000):
        t.add(7 if k % 2 else k, str(k % 100).encode(), 1, k)
    assert len([e for e in t.entries if e[0] == 7]) == 50


@pytest.mark.parametrize("limit", [4096, 2])
def test_paragraphs(spark, sf_dir, texts, limit):
    sets = {}
    for i, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), line).encode().split()
            if len(w) >= 5:
                sets[i, k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    holders = defaultdict(list)
    for p, s in sets.items():
        for g in s:
            holders[g].append(p)
    u = Union(sets)
    for p, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for q in holders[g]:
                shared[q] += 1
        for q, n in shared.items():
            if n / (len(s) + len(sets[q]) - n) >= 0.8:
                u.link(p, q)
    want = {i: [] for i in texts}
    for p in sorted(sets):
        if u.find(p) != p:
            want[p[0]].append(p[1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.removed for r in paragraph_dedup.near_paragraphs(docs, group_limit=limit, min_words=5).collect()}
    assert got == want


def test_paragraphs_of_few_words(spark, sf_dir, texts):
    """The query against brute force over all lines, short ones included."""
    sets = {}
    for i, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            if w := line.encode().lower().split():
                sets[i, k] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))}
    holders = defaultdict(list)
    for p, s in sets.items():
        for g in s:
            holders[g].append(p)
    u = Union(sets)
    for p, s in sets.items():
        shared = Counter(q for g in s for q in holders[g])
        for q, n in shared.items():
            if n / (len(s) + len(sets[q]) - n) >= 0.8:
                u.link(p, q)
    want = {i: ([], 0) for i in texts}
    for p in sorted(sets):
        gone, n = want[p[0]]
        want[p[0]] = (gone + [p[1]] * (u.find(p) != p), n + 1)
    got = {r.doc_id: (r.removed, r.n_paragraphs) for r in queries.op3_paragraphs(spark, sf_dir).collect()}
    assert got == want
    assert any(len(g) < 5 for p, s in sets.items() if u.find(p) != p for g in s)


def removed_by_brute_force(rows):
    """Per row of (id, text): the mask of the bytes that go."""
    least = {}
    for i, t in rows:
        raw = t.encode()
        for k in range(len(raw) - 49):
            g = raw[k : k + 50]
            least[g] = min(least.get(g, i), i)
    out = []
    for i, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), sha(np.frombuffer(raw, np.uint8)[~gone].tobytes())))
    return sorted(out)


def removed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs, texts=False, **options).collect())


def test_suffixes_compares_bytes(spark, monkeypatch):
    """Hashes that all collide remove nothing that isn't repeated; nor do strings built to collide under a chain of them."""
    rows = [(1, "the quick brown fox jumps over the lazy dog tonight and"), (2, ";JT928!4e|tj4:]Hr the lazy dog tonight and more and more of it")]
    rows += [(3, "x" * 49), (4, "x" * 60), (5, "y" + "x" * 55), (6, "the quick brown fox jumps over the lazy dog tonight an.")]
    assert removed(spark, rows) == removed_by_brute_force(rows)
    r = random.Random(8)
    runs = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(50, 90))) for _ in range(40)} | {b"ab" * 40, b"ab" * 41, b"b" + b"ab" * 30})
    owner = np.array([r.randint(0, 5) for _ in runs])
    ends = np.cumsum([0, *map(len, runs)])
    least = {}
    for s, o in zip(runs, owner, strict=True):
        for k in range(len(s) - 49):
            least[s[k : k + 50]] = min(least.get(s[k : k + 50], 9), o)
    want = {int(e) + k for s, o, e in zip(runs, owner, ends, strict=False) for k in range(len(s) - 49) if least[s[k : k + 50]] < o}
    raw = np.frombuffer(b"".join(runs) + suffix_dedup.PAD, np.uint8)
    assert set(suffix_dedup.ties(raw, ends, owner).tolist()) == want and want
    monkeypatch.setattr(suffix_dedup, "SORTED", 50)  # many blocks of leading bytes
    assert set(suffix_dedup.ties(raw, ends, owner).tolist()) == want
    monkeypatch.setattr(suffix_dedup, "string_keys", lambda eight, at, size: np.zeros(len(at), np.uint64))
    assert set(suffix_dedup.ties(raw, ends, owner).tolist()) == want


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 2_000, "crowded_bytes": 4_000}, {"crowded_bytes": 0}])
def test_suffixes_of_crowded_texts(spark, options):
    """Templates, periods, several texts of one id, repeated rows, pieces of long texts; every way of dealing agrees."""
    r = random.Random(9)
    template = " ".join(f"word{k}" for k in range(12))
    rows = [(i, f"{template} {r.choice('pqrs')} and {r.randint(0, 9)} then {template}") for i in range(60)]
    rows += [(7, "other text of seven: " + template * 2), (8, rows[8][1]), (100, "abc" * 400), (101, "abc" * 300 + "d" + "bca" * 50), (102, "z" * 3000), (90, "z" * 70)]
    assert removed(spark, rows, **options) == removed_by_brute_force(rows)


@pytest.mark.parametrize("buckets,crowded", [(1, []), (7, []), (7, [b"\x2a"]), (7, [b"\x7f"]), (7, [b"\x7f", b"\x2a"]), (7, [b"\x7f", b"\x7f"])])
def test_suffixes_in_pieces(monkeypatch, buckets, crowded):
    """The steps of one task each: texts cut into pieces, small flushes, crowded buckets."""
    r = random.Random(10)
    part = [" ".join(r.choice(["ab", "cde", "f", "ghijkl"]) for _ in range(30)) for _ in range(4)]
    rows = [(i, " ".join(r.choice(part)[r.randint(0, 9) :] for _ in range(r.randint(1, 9)))) for i in range(40)] + [(100, "abc" * 400), (101, "abc" * 300 + "d" + "bca" * 50)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    monkeypatch.setattr(suffix_dedup, "HELD", 2000)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([t.encode() for _, t in rows], pa.binary())], ["doc_id", "h", "text"])

    def by_key(batches):
        return sorted((tuple(x.values()) for b in batches for x in b.to_pylist()), key=lambda x: x[:2])

    def batch_of(found):
        return iter([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), suffix_dedup.PACKED.types, strict=True)], schema=suffix_dedup.PACKED)])

    dealt = by_key(suffix_dedup._deal(buckets, 3, [types.SimpleNamespace(value=c) for c in crowded])(iter([batch])))
    marks = by_key(suffix_dedup._sort_buckets(3)(batch_of(dealt)))
    placed = batch.append_column("block", pa.array([i % 3 for i, _ in rows], pa.int64()))
    both = sorted(marks + by_key(suffix_dedup._pack_texts(3)(iter([placed]))), key=lambda x: x[:2])
    got = sorted(tuple(x.values())[:5] for b in suffix_dedup._cut(False)(batch_of(both)) for x in b.to_pylist())
    assert got == removed_by_brute_force(rows)


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 50_000, "crowded_bytes": 100_000}])
def test_suffixes(spark, sf_dir, texts, options):
    seen, want = {}, {}
    for i in sorted(texts):
        raw = texts[i].encode()
        hit, own = np.zeros(len(raw) + 1, int), []
        for k in range(len(raw) - 49):
            g = raw[k : k + 50]
            if seen.get(g, i) < i:
                hit[k] += 1
                hit[k + 50] -= 1
            else:
                own.append(g)
        for g in own:
            seen.setdefault(g, i)
        gone = hit[:-1].cumsum() > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(raw), int(gone.sum()), spans, sha(np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, **options).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 0


def test_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    assert suffix_dedup.PERIOD - 1 + suffix_dedup.RANKED <= suffix_dedup.LENGTH


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(n))).collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, None: 5, "c": 400, "d": 3, "e": 100}
    order = sorted(x for x in sizes if x) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    want, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            want |= {s: left * weight[s] / w for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, docs long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(want)


def test_mixing(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert {r.doc_id: r["size"] for r in rows} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert all(r.taken <= 3 * r["size"] for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source, r.target] += r.taken
    assert all(abs(n - t) <= 0.5 for (_, t), n in taken.items())
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(5)).collect())
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_shard_counts(spark):
    """Totals are met, shards are full, a shard's counts are those of a multinomial draw, and another seed is another."""
    sources = spark.createDataFrame([(1, 100_000, 30_000), (2, 50_000, 100_000), (3, 7, 21), (4, 9_000, 27_000), (5, 10, 0)], "sid long, source_size long, take long")
    drawn = {}
    for seed in (0, 1):
        slots = mixing.draw(sources, seed, shard_slots=64, block_words=100).collect()
        words, places, uses = defaultdict(int), set(), Counter()
        for s in slots:
            words[s.sid] += s.words
            places.add((s.shard, s.slot))
            uses[s.sid, s.block] += 1
        assert words == {1: 30_000, 2: 100_000, 3: 21, 4: 27_000}
        assert len(places) == len(slots) and places == {(k // 64, k % 64) for k in range(len(slots))}
        assert max(n for (i, _), n in uses.items() if i == 2) == 2 and {n for (i, _), n in uses.items() if i == 4} == {3}
        drawn[seed] = {(s.shard, s.slot): (s.sid, s.block) for s in slots}
        counts, total = Counter((s.shard, s.sid) for s in slots), Counter(s.sid for s in slots)
        whole = range(len(slots) // 64)
        for i in (1, 2, 4):  # within six deviations of the mean, and as wide as the draw
            p = total[i] / len(slots)
            off = [(counts[k, i] - 64 * p) / (64 * p * (1 - p)) ** 0.5 for k in whole]
            assert max(map(abs, off)) < 6 and 0.3 < np.mean(np.square(off)) < 3
    same = sum(drawn[0][k] == drawn[1][k] for k in drawn[0])
    assert same < len(drawn[0]) / 5


def plain_mix(rows, seed, block_words, shard_slots):
    """The mix in plain Python: {doc: taken}, {(shard, slot): text}. ``rows``: (doc, source, words) in stream order."""

    def h(*key):
        out = 42
        for k in key:
            out = xxhash.xxh64_intdigest((k & (2**64 - 1)).to_bytes(8, "little") if not isinstance(k, np.int32) else int(k).to_bytes(4, "little", signed=True), out)
        return out - (1 << 64) if out >> 63 else out

    def permuted(x, n, *key):
        k = h(*key)
        for r in range(1, mixing.ROUNDS + 1):
            other = (h(k, np.int32(r)) % n - x) % n
            if h(k, np.int32(r), max(x, other)) % 2 == 0:
                x = other
        return x

    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    stream = {s: [w for _, t, ws in rows for w in ws if t == s] for s in sources}
    target, open_, left = {}, set(sources), float(sum(map(len, stream.values())))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * len(stream[s])}
        target |= {s: 3.0 * len(stream[s]) for s in over} if over else {s: level * weight[s] for s in open_}
        left -= sum(3 * len(stream[s]) for s in over)
        open_ = open_ - over if over else set()
    dealt = []
    for sid, s in enumerate(sources, 1):
        size, take = len(stream[s]), round(target[s])
        if size and take:
            blocks = -(-size // block_words)
            dealt += [(sid, s, size, blocks, take, k) for k in range(take // size * blocks + -(-(take % size) // block_words))]
    owner = {s: [d for d, t, ws in rows for _ in ws if t == s] for s in sources}
    taken, out = Counter(), {}
    for g in range(len(dealt)):
        sid, s, size, blocks, take, rank = dealt[permuted(g, len(dealt), np.int32(seed))]
        turn, at, full = rank // blocks, rank % blocks, size // block_words
        block = permuted(at, full, np.int32(seed), sid, turn) if at < full else at
        held = min(block_words, size - block * block_words)
        n = held if turn < take // size else min(held, take % size - at * block_words)
        span = slice(block * block_words, block * block_words + n)
        taken.update(owner[s][span])
        out[g // shard_slots, g % shard_slots] = (s, " ".join(stream[s][span]))
    return taken, out


def test_mix_is_the_plain_one(spark):
    r = random.Random(11)
    rows = [(i, r.choice(["a", "b", "b", "b", "c", None]), " ".join(f"w{i}x{k}" for k in range(r.choice([0, 1, 5, 40, 130])))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    m = mixing.Mix(docs, block_words=16, shard_slots=32, seed=3, rows_a_chunk=30)
    start = {x.doc_id: x.start for x in m.rows.collect()}
    stream = [(i, s, t.split()) for i, s, t in sorted(rows, key=lambda x: (start[x[0]], len(x[2])))]
    taken, shards = plain_mix(stream, 3, 16, 32)
    assert {x.doc_id: x.taken for x in m.taken().collect()} == {i: taken[i] for i, _, _ in rows}
    assert {(x.shard, x.slot): (x.source, x.text) for x in m.shards().collect()} == shards
    words = Counter(w for _, t in shards.values() for w in t.split())
    assert Counter(w for x in m.documents().collect() for w in x.text.split()) == words
    counts = Counter((k, s) for (k, _), (s, _) in shards.items())
    names = {x.sid: x.source for x in m.sources.collect()}
    assert {(x.shard, names[x.sid]): x.n for x in m.shard_counts().collect()} == counts


def test_lexicon(tmp_path):
    r = random.Random(4)
    words = sorted({bytes(r.choice(b"abcd ") for _ in range(r.randint(1, 7))) for _ in range(2000)})
    model = bpe.Model(queries.vocabulary_path())
    path = str(tmp_path / "lexicon")
    with open(path, "wb") as f:
        f.write(bpe.Lexicon.compile(words, model))
    lexicon = bpe.Lexicon(path)
    assert lexicon.find(words).tolist() == list(range(len(words)))
    others = [w + b"x" for w in words[:50]] + [b"", b"zzz"]
    assert (lexicon.find(others) == -1).all()
    assert all(lexicon.ids_of(i) == model.merge(w) for i, w in enumerate(words))
    assert model.merge_many(words) == [model.merge(w) for w in words]
    arcs = len(lexicon.key)
    trie = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert arcs < len(trie)  # suffixes are shared


def test_words_by_either_engine(texts):
    """ASCII texts, stretches of it in others, and the rest split into the same words."""
    import regex

    want = regex.compile(bpe.PATTERN).findall
    r = random.Random(12)
    pieces = ["ab", " ", "  ", "\n", "'s", "'ll", "x1", "don't", "é", "漢", "\u0085", "\x1c", "...", "²", " the quick brown fox jumps over the lazy dog and runs far away from it", "\t", "_", "😀", "I'VE"]
    fuzz = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(20_000)]
    for t in [*texts.values(), *fuzz]:
        assert bpe.split_words(t) == want(t)


def test_plain_engine_reads_the_basic_plane(monkeypatch):
    """Every character up to U+FFFF is split as by the vocabulary's expression, without the slower engine; those above
    still are, too."""
    import regex

    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000)]]
    draw = random.Random(11)
    draw.shuffle(every)
    texts = ["".join(c + draw.choice(("", "", " ", "  ", "e", "7", "'ll", " \n")) for c in every[lo : lo + 997]) for lo in range(0, len(every), 997)]
    texts += ["\ud800 a\udfff", "naïve cafés don't  ", "中文 ٤٥½ x²  y"]
    want = [regex.compile(bpe.PATTERN).findall(t) for t in texts]
    high = ["\U0001f600 \U00020000a \U0001d7d8 1", "café " + "plain words " * 20 + "\U00010400b"]
    assert [bpe.split_words(t) for t in high] == [regex.compile(bpe.PATTERN).findall(t) for t in high]
    monkeypatch.setattr(bpe, "_words", None)
    assert [bpe.split_words(t) for t in texts] == want


def test_bpe_is_the_library(spark, sf_dir, texts, tmp_path):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(queries.vocabulary_path())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe(spark, sf_dir).collect()}
    for i, t in texts.items():
        ids = ref.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(ref.decode(ids, skip_special_tokens=False)))
    r = random.Random(5)
    model = bpe.Model(queries.vocabulary_path())
    with open(tmp_path / "lexicon", "wb") as f:
        f.write(bpe.Lexicon.compile([b" the", b"he", b" "], model))
    enc = bpe.Encoder(model, bpe.Lexicon(str(tmp_path / "lexicon")))
    alphabet = list("abcABC  \n\t'’019é漢😀 \u0085\x1c.,!<|>") + ["<|endoftext|>", "'s", "  ", " the"]
    for _ in range(3000):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        assert enc.encode(s) == ref.encode(s, add_special_tokens=False).ids
        assert enc.decode(enc.encode(s)) == s
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    tok = bpe.Tokenizer(docs, queries.vocabulary_path())
    assert {r[0]: r[1] for r in tok.decode(tok.encode(docs)).collect()} == {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


def test_chat_layouts(spark):
    rows = [
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"id":3}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"instruction":"do","input":"","output":"done"}',
        '{"system":"s","prompt":"p","response":"r"}',
        '{"question":"q","answer":"a"}',
        "not json",
        None,
        '{"other":1}',
    ]
    t = spark.createDataFrame(list(enumerate(rows)), "conv_id long, j string")
    got = defaultdict(list)
    for r in chat.canonical_json(t, "j").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text, r.layout))
    assert got[0] == [("user", "hi", "messages"), ("assistant", "yo", "messages")]
    assert got[1] == [("user", "a", "conversations"), ("assistant", "b", "conversations")]
    assert got[2] == [("user", "do", "instruction"), ("assistant", "done", "instruction")]
    assert [x[0] for x in got[3]] == ["system", "user", "assistant"]
    assert got[4] == [("user", "q", "question"), ("assistant", "a", "question")]
    assert got[5] == got[6] == got[7] == [(None, None, None)]
    wide = spark.createDataFrame([(1, "do", "x", "done")], "conv_id long, instruction string, input string, output string")
    assert [tuple(r)[2:] for r in chat.canonical_rows(wide).orderBy("turn").collect()] == [("user", "do\n\nx"), ("assistant", "done")]


def test_chat_layouts_keep_every_turn(spark):
    """Null and missing fields, empty lists, parts, other fields beside a layout's."""
    rows = {
        '{"messages":[{"role":"assistant","content":null},{"role":"user","content":"hi"}]}': ("messages", [("assistant", ""), ("user", "hi")]),
        '{"messages":[{"role":"user"},{"content":"yo"},{"role":"gpt","content":7}]}': ("messages", [("user", ""), ("", "yo"), ("assistant", "7")]),
        '{"messages":[{"role":"user","content":[{"type":"text","text":"see"},{"type":"image","url":"u"},"this"]}]}': ("messages", [("user", "see\nthis")]),
        '{"messages":[]}': ("messages", [(None, None)]),
        '{"system":"be kind","messages":[{"role":"user","content":"hi"}]}': ("messages system", [("system", "be kind"), ("user", "hi")]),
        '{"system":null,"conversations":[{"from":"human","value":"a"}]}': ("conversations system", [("user", "a")]),
        '{"prompt":"p","response":"r","instruction":"i"}': ("prompt", [("user", "p"), ("assistant", "r")]),
        '{"prompt":"p","response":null}': ("prompt", [("user", "p"), ("assistant", "")]),
        '{"text":"x","role":"y","turn":1,"question":"q","answer":"a"}': ("question", [("user", "q"), ("assistant", "a")]),
        '{"instruction":"do","output":"done","system":"s"}': ("instruction only system", [("system", "s"), ("user", "do"), ("assistant", "done")]),
        '{"prompt":"p","messages":[{"role":"user","content":"hi"}]}': ("messages", [("user", "hi")]),
        '{"messages":"not a list"}': (None, [(None, None)]),
        '[1, 2]': (None, [(None, None)]),
    }
    t = spark.createDataFrame(list(enumerate(rows)), "conv_id long, j string").select("*", F.lit(0).alias("turn"), F.lit("c").alias("layout"), F.lit("m").alias("_messages"), F.lit("v").alias("_v"))
    got = defaultdict(list)
    for r in chat.canonical_json(t, "j").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.layout, r.role, r.text))
    for k, (layout, turns) in enumerate(rows.values()):
        assert got[k] == [(layout, *x) for x in turns], list(rows)[k]
    empty = spark.createDataFrame([], "conv_id long, j string")
    assert chat.canonical_json(empty, "j").count() == 0
    table = spark.createDataFrame([(1, "s", [("user", None), (None, "x")]), (2, None, None)], "conv_id long, system string, messages array<struct<role:string,content:string>>")
    assert sorted(tuple(r) for r in chat.canonical_rows(table).collect()) == [(1, 0, "system", "s"), (1, 1, "user", ""), (1, 2, "", "x")]


def test_chat_round_trip(spark):
    r = random.Random(6)
    alphabet = ["\\", "<|", "<\\|", "|", "<", "n", "\n", "<|im_end|>\n", "<|im_start|>", "é", "😀"]
    rows = [(c, k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 6))) if r.random() < 0.3 else r.choice(["user", "assistant"]), "".join(r.choice(alphabet) for _ in range(r.randint(0, 12)))) for c in range(60) for k in range(5)]
    got = chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role, text))
    assert {x.conv_id: [tuple(t) for t in x.turns] for x in got} == want
    assert {x.conv_id: x.losses for x in got} == {c: [t for r_, t in v if r_ == "assistant"] for c, v in want.items()}


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_patterns(texts):
    r = random.Random(7)
    alphabet = list("ab@@..--++  0123456789()%é\n") + ["@a.b", "+1 (555) 123-4567", "4111111111111111", "1.2.3.4", "255"]
    for t in [*texts.values(), *("".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(20_000))]:
        assert pii.base_spans(t) == base(t)


@pytest.mark.parametrize("round_terms", [100_000, 1])
def test_pii_terms(spark, round_terms):
    """A name that stands by one address in many texts gives it away; common words and single sightings don't."""
    rows = [(i, f"w{i}x and the Zorblax w{i}y ann@corp.org said w{i}z other w{i}q the") for i in range(12)]
    rows += [(100 + i, f"filler the and other said words number {i}") for i in range(300)] + [(500, "only zorblax here"), (501, "zed bob@corp.org once")]
    rows += [(600 + i, "copied hapax joe@corp.org text") for i in range(9)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), round_terms=round_terms).collect()}
    assert got[3].spans.startswith("term:") and got[500].sanitised == "only  here" and got[3].n_term == 1
    assert got[501].n_term == got[600].n_term == got[105].n_term == 0


def test_pii_whole_texts(spark):
    """Terms of entities named in one or two texts, at any distance, and of a signature that is always worded alike."""
    gap = " ".join(f"common{i % 50}" for i in range(2000))
    rows = [(5000 + i, f"{gap} plain text {i}") for i in range(2200)]
    rows += [(2000, f"Zorblax wrote {gap} to ann@corp.org"), (2001, f"Quix {gap} bob@corp.org once"), (2002, f"bob@corp.org twice {gap} Quix")]
    rows += [(3000 + i, f"plain text again {i}\nRegards, Mimsy Borogove joe@corp.org") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(rows)
    terms = {r.term: r.disclosure for r in pii.revealing_terms(docs).collect()}
    want = dict.fromkeys(["zorblax", "wrote", "to", "quix", "once", "twice", "again", "regards", "mimsy", "borogove"], 1.0)
    assert terms == want
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[2000].sanitised == f"  {gap}  [EMAIL]" and got[3007].sanitised == "plain text  7\n,   [EMAIL]"
    assert len(got) == n and sum(r.n_term for r in got.values()) == 3 + 2 + 2 + 20 * 4


@pytest.mark.parametrize("seed", range(3))
def test_pii_terms_brute(spark, seed):
    """The pruned count of terms against the definition."""
    r = random.Random(seed)
    texts = set()
    for i in range(2500):
        parts = [f"w{int(r.paretovariate(0.5))}" for _ in range(r.randint(1, 12))] + [f"e{int(r.paretovariate(0.7)) % 90}@corp.org" for _ in range(r.choice([0, 0, 0, 1, 2]))]
        r.shuffle(parts)
        texts.add(" ".join(parts))
    with_term, with_entity = defaultdict(set), defaultdict(set)
    for t in texts:
        for w in t.split():
            (with_entity if "@" in w else with_term)[w].add(t)
    n, want = len(texts), {}
    for w, a in with_term.items():
        for e in {e for t in a for e in t.split() if "@" in e}:
            b, ic = len(a & with_entity[e]), np.log(n / len(with_entity[e]))
            p, m = b / len(a), len(a)
            low = (p + 1 / (2 * m) - np.sqrt(p * (1 - p) / m + 1 / (4 * m * m))) / (1 + 1 / m)
            if 1 + np.log(low) / ic >= 0.9:
                want[w] = max(want.get(w, 0), 1 + np.log(p) / ic)
    rows = [(i, t) for i, t in enumerate([*texts, *r.sample(sorted(texts), 300)])]
    got = {r.term: r.disclosure for r in pii.revealing_terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want and got == pytest.approx(want)


def test_pii_query(spark, sf_dir, texts):
    """The registered query's counts, digests and spans, terms included, against the definitions."""
    kinds = ("email", "ip", "card", "phone", "term")
    found, with_term, with_entity = {}, defaultdict(set), defaultdict(set)
    for t in set(texts.values()):
        spans = base(t)
        words = [(m.start(), m.end(), m[0].lower()) for m in pii._WORD.finditer(t) if all(m.end() <= a or b <= m.start() for a, _, b in spans)]
        found[t] = spans, words
        for _, _, w in words:
            with_term[w].add(t)
        for a, k, b in spans:
            with_entity[k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b])].add(t)
    n, terms = len(found), set()
    for e in with_entity.values():
        for w in {w for t in e for _, _, w in found[t][1] if len(w) > 1 and not w.isdigit()}:
            m, p = len(with_term[w]), len(with_term[w] & e) / len(with_term[w])
            low = (p + 1 / (2 * m) - np.sqrt(p * (1 - p) / m + 1 / (4 * m * m))) / (1 + 1 / m)
            if 1 + np.log(low) / max(np.log(n / len(e)), 1e-9) >= 0.9:
                terms.add(w)
    for r in queries.op9_pii(spark, sf_dir).collect():
        spans, words = found[texts[r.doc_id]]
        spell = lambda x: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(x))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert r.base_sha256 == sha(spell(spans)) and r.spans == spell(spans + [(a, 4, b) for a, b, w in words if w in terms])


def test_pii_terms_of_any_script(spark):
    """Words are split and folded alike however many terms there are."""
    words = ["cafe\u0301ine", "\u0928\u092e\u0938\u094d\u0924\u0947", "xyz\u00b2", "\u0130stanbul", "\u039f\u0394\u039f\u03a3", "Stra\u00dfe"]
    rows = [(i, f"{' '.join(words)} u{i} ann@corp.org") for i in range(40)] + [(100 + i, f"other words number{i}") for i in range(1500)] + [(5000, " ".join(words)), (None, words[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (sorted(pii.find(docs, round_terms=n).collect(), key=lambda r: (r.doc_id is not None, r.doc_id)) for n in (100_000, 1))
    assert few == many
    last = few[-1]
    assert last.doc_id == 5000 and last.n_term == len(words) and few[0].n_term == 1
    assert few[0].sanitised == ""  # no mark stays behind


def test_pii_copies_hide_nothing(spark):
    """Copies of the texts with a term leave its disclosure as it is."""
    rows = [(i, f"w{i}x and the Zorblax w{i}y ann@corp.org said w{i}z") for i in range(12)]
    rows += [(100 + i, f"filler the and other said words number {i}") for i in range(300)]
    copied = rows + [(1000 + i, rows[i % 12][1]) for i in range(600)]
    for some in (rows, copied):
        terms = pii.revealing_terms(spark.createDataFrame(some, "doc_id long, text string")).collect()
        assert [(r.term, r.disclosure) for r in terms] == [("zorblax", 1.0)]


def test_trees_are_the_naive_ones():
    """Histogram fit and flattened walk against a plain recursive fit over the same cuts."""
    r = np.random.default_rng(3)
    x = r.normal(size=(240, 4))
    y = (x[:, 1] + x[:, 2] * x[:, 3] + r.normal(scale=0.3, size=240) > 0).astype(float)
    trees, depth, bins, rate, least, ridge = 6, 3, 8, 0.2, 10, 1.0
    model = quality.fit(x, y, trees=trees, depth=depth, bins=bins, rate=rate, leaf_rows=least, ridge=ridge)
    cuts = [sorted({sorted(c)[int(np.floor(q * (len(c) - 1)))] for q in np.linspace(0, 1, bins + 1)[1:-1]}) for c in x.T.tolist()]

    def grow(rows, g, h, left):
        total_g, total_h, best = sum(g[i] for i in rows), sum(h[i] for i in rows), (1e-9, None)
        for f in range(x.shape[1]) if left else ():
            for cut in cuts[f]:
                a = [i for i in rows if x[i, f] <= cut]
                if least <= len(a) <= len(rows) - least:
                    ga, ha = sum(g[i] for i in a), sum(h[i] for i in a)
                    gain = ga**2 / (ha + ridge) + (total_g - ga) ** 2 / (total_h - ha + ridge) - total_g**2 / (total_h + ridge)
                    if gain > best[0] + 1e-12:
                        best = gain, (f, cut)
        if best[1] is None:
            return -rate * total_g / (total_h + ridge)
        f, cut = best[1]
        return f, cut, grow([i for i in rows if x[i, f] <= cut], g, h, left - 1), grow([i for i in rows if x[i, f] > cut], g, h, left - 1)

    def walk(tree, row):
        while isinstance(tree, tuple):
            f, cut, low, high = tree
            tree = low if row[f] <= cut else high
        return tree

    margin = np.full(240, np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(list(range(240)), p - y, np.maximum(p * (1 - p), 1e-9), depth)
        margin += [walk(tree, row) for row in x]
    assert model.margin(x) == pytest.approx(margin, abs=1e-9)


def test_quality_held_out(spark, sf_dir):
    scored = queries.op10_quality(spark, sf_dir).toPandas().merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    kept = scored[scored.held_out]
    assert len(kept) and (kept.predicted == kept.quality).mean() >= 0.85
    x, y = np.random.default_rng(0).normal(size=(400, len(quality.NAMES))), None
    y = (x[:, 3] + 0.5 * x[:, 7] > 0).astype(float)
    model = quality.fit(x[:300], y[:300])
    assert ((model.probability(x[300:]) > 0.5) == y[300:]).mean() > 0.85
