"""Passages that repeat inside lines, against every run of words."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
import xxhash

from quillon.llm import paragraph_dedup


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_passages_inside_lines(spark):
    """A passage of 51 words is found in both documents wherever its lines break; fewer than 40 words never are."""
    draw = random.Random(5)
    fresh = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    passage, short = fresh(51), fresh(39)
    broken = " ".join(passage[:20]) + "\n" + " ".join(passage[20:]).upper()
    texts = [" ".join([*fresh(300), *passage, *fresh(80)]), " ".join(fresh(17)) + " " + broken, " ".join([*fresh(90), *short]), " ".join([*short, *fresh(70)]), " ".join(fresh(400)), "", None]
    got = {r.doc_id: r for r in paragraph_dedup.near_paragraphs(docs_of(spark, texts)).collect()}
    assert [got[i].n_shared > 0 for i in range(7)] == [True, True, False, False, False, False, False]
    assert all(got[i].n_removed == 0 and got[i].class_id == i for i in range(7))


def test_passages_against_all_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    held = {n: defaultdict(set) for n in (40, 51)}
    for i, w in texts.items():
        for n, of in held.items():
            for k in range(len(w) - n + 1):
                of[tuple(w[k : k + n])].add(i)
    runs = {n: {i for s in of.values() if len(s) > 1 for i in s} for n, of in held.items()}
    got = {r.doc_id for r in paragraph_dedup.near_paragraphs(docs).where("n_shared > 0").collect()}
    assert runs[51] <= got <= runs[40] and runs[51]


def test_repeated_rows_share_nothing(spark):
    text = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string").repartition(2)
    assert [r.n_shared for r in paragraph_dedup.near_paragraphs(docs).collect()] == [0, 0]


@pytest.mark.parametrize("flush", [1, 50, 1_000_000])
def test_packed_pairs_meet(monkeypatch, flush):
    """Equal keys and strings meet across flushes and tasks, and those of a flush are sent on once."""
    monkeypatch.setattr(paragraph_dedup, "FLUSH", flush)
    draw = random.Random(3)
    words = [" ".join(f"w{k}" for k in range(i % 7 * 100, i % 7 * 100 + 60)) for i in range(40)] + [" ".join(f"v{draw.randrange(10**9)}" for _ in range(60)) for _ in range(9)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(0, 98, 2), pa.int64()), pa.array(words)], ["d", "text"])
    dealt = [b for lo in range(0, 49, 10) for b in paragraph_dedup._deal_passages(docs.slice(lo + k, 5) for k in (0, 5) if lo + k < 49)]
    got = pa.Table.from_batches(paragraph_dedup._shared(pa.Table.from_batches(dealt).sort_by("bucket").to_batches()))
    assert set(got.column("d").to_pylist()) == set(range(0, 80, 2))
    phs = [xxhash.xxh3_128_digest(bytes([i])) for i in range(60)]
    keys = [[i // 3 + 1, (i // 20 + 7) << 55, -i - 1] for i in range(60)]
    signed = pa.RecordBatch.from_arrays([pa.array(phs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["ph", "bands"])
    dealt = [b for lo in range(0, 60, 20) for b in paragraph_dedup._deal_keys(signed.slice(lo + k, 4) for k in range(0, 20, 4))]
    links = pa.Table.from_batches(paragraph_dedup._stars(pa.Table.from_batches(dealt).sort_by("bucket").to_batches()))
    name = {int.from_bytes(p[:6], "little"): i for i, p in enumerate(phs)}
    top = list(range(60))

    def find(i):
        return i if top[i] == i else find(top[i])

    for a, b in zip(*(c.to_pylist() for c in links.columns), strict=True):
        top[find(name[a])] = find(name[b])
    assert len({find(i) for i in range(60)}) == 1 and links.num_rows <= 120


def test_hashes_of_words():
    """Words are those of split, equal ones alike and others apart, whatever stands around them, in blocks or not."""
    draw = random.Random(8)
    words = [bytes(draw.choice(b"ab\xc3\xa9\x00-") for _ in range(draw.choice((1, 2, 5, 31, 32, 33, 90)))) for _ in range(3000)] + [b"x" * 300_000, b"x" * 299_999]
    draw.shuffle(words)
    text = b" " + b"".join(w + draw.choice((b" ", b"\n", b" \t\r", b"\x0b\x0c")) for w in words + words[::-1])
    hashes, start = paragraph_dedup.word_hashes(text)
    split = text.split()
    assert [text[s : s + len(w)] for s, w in zip(start.tolist(), split, strict=True)] == split
    assert len(set(zip(split, hashes.tolist(), strict=True))) == len(set(split)) == len(set(hashes.tolist()))
    assert [len(x) for x in paragraph_dedup.word_hashes(b" \n")] == [len(x) for x in paragraph_dedup.word_hashes(b"")] == [0, 0]


def test_no_stage_has_two_python_workers(spark, monkeypatch):
    """Each core holds one Python worker: a second one beside it took an executor over its memory."""
    frame, plans = type(spark.range(1)), []
    plain = frame.mapInArrow

    def noted(self, *args, **options):
        plans.append((out := plain(self, *args, **options))._jdf.queryExecution().analyzed().toString())
        return out

    monkeypatch.setattr(frame, "mapInArrow", noted)
    lines = [" ".join(f"w{j}" for j in range(4 * k, 4 * k + 24)) for k in range(60)]  # a group over the limit, too
    docs = spark.createDataFrame(list(enumerate([*lines, f"{lines[0]} more"])), "doc_id long, text string")
    assert [r.doc_id for r in paragraph_dedup.near_paragraphs(docs, group_limit=10).where("n_removed > 0").collect()] == [60]
    for plan in plans:
        ops = [x.strip(" +-:") for x in plan.splitlines()]
        maps = [x for x in ops if x.startswith(("MapInArrow", "Repartition", "Aggregate", "Join"))]
        assert not any(a.startswith("MapInArrow") and b.startswith("MapInArrow") for a, b in zip(maps, maps[1:], strict=False)), plan
    assert len(plans) >= 7
