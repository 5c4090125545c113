"""The pipeline's stages and its whole run against plain re-computations."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from quillon.llm import quality
from quillon.llm.common import materialize, read_table
from quillon.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)] * bool(w)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact dedup", "near dedup", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    stages = dict(corpus_pipeline.STAGES)

    good = materialize(stages["quality"](spark, docs, sf_dir))
    scored = quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels"))).collect()
    ids = {r.doc_id for r in good.collect()}
    assert ids == {r.doc_id for r in scored if r.predicted} and 0 < len(ids) < len(texts)

    single = materialize(stages["exact dedup"](spark, good, sf_dir))
    last = {}
    for i in sorted(ids):
        last[texts[i]] = i
    ids = {r.doc_id for r in single.collect()}
    assert ids == set(last.values())

    apart = materialize(stages["near dedup"](spark, single, sf_dir))
    prints, left, want = {i: print_of(texts[i]) for i in ids}, set(ids), set()
    while left:
        first = min(left)
        want.add(first)
        front = [first]
        left.discard(first)
        while front:
            p = prints[front.pop()]
            near = {j for j in left if (p ^ prints[j]).bit_count() <= 3}
            left -= near
            front += near
    ids = {r.doc_id for r in apart.collect()}
    assert ids == want

    mixed = materialize(stages["mixing"](spark, apart, sf_dir))
    assert mixed.columns == docs.columns
    got, source, taken = mixed.collect(), {r.doc_id: r.source for r in docs.collect()}, Counter()
    times = defaultdict(int)
    for r in got:
        w, own = WORD.findall(r.text), WORD.findall(texts[r.doc_id])
        assert r.text == texts[r.doc_id] or len(w) < len(own) and not Counter(w) - Counter(own)
        taken[source[r.doc_id]] += len(w)
        times[r.doc_id] += len(w)
    assert all(n <= 3 * len(WORD.findall(texts[i])) for i, n in times.items())
    sizes = Counter()
    for i in ids:
        sizes[source[i]] += len(WORD.findall(texts[i]))
    total, open_, target = sum(sizes.values()), set(sizes), {}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes))}
    while open_:
        level = total / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        total -= sum(3 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())

    ref = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for r in got:
        e = ref.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()] += 1
    out = stages["bpe"](spark, mixed, sf_dir).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out) == want

    whole = entry.queries()["pipeline"](spark, sf_dir).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, out))
