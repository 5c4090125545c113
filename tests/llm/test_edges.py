"""Every operator on awkward tables: nulls, empty and long texts, repeated rows, ties, empty tables, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import bpe, bsi_topk, chat, exact_dedup, mixing, paragraph_dedup, pii, quality, simhash, suffix_dedup
from quillon.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 30_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf today", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf today", "en", "a", 1),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, "", "en", "b", 0),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG, "en", "c", len(LONG)),
    (7, LONG, "en", "c", len(LONG)),
    (8, "x" * 100_000, "en", "c", 100_000),
    (None, "nobody's text with a few words", "en", "a", 5),
    (None, None, None, None, None),
    (9, "café éè \x00 \x1c 漢字 😀 <|endoftext|> a@b.co +1 (555) 123-4567 or 4111 1111 1111 1111", "fr", "d", 3),
    (10, "  \t\n \r\n ", "en", "d", 3),
]
CLASH = ["h", "key", "fp", "component_id", "kept", "score", "runs", "got", "size", "start", "block", "_text", "sha", "word", "turn"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, DOCS).repartition(3)
    return plain.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def text_of(t):
    return t or ""


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_topk(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (7, [0.5, 0.25]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (100, [1.0]), (9, [float("inf"), 0.0]), (8, [-1.0, 2.0]), (None, [1.0, 1.0]), (7, [0.5, 0.25])]
    v = bsi_topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)), "vec_id", "embedding")
    got = [tuple(r) for r in bsi_topk.top_k(v, v.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()]
    s = 128 * 128 + 64 * 64
    assert got == [(0, 1, 7, s), (0, 2, 7, s), (0, 3, 50, s), (50, 1, 0, s), (50, 2, 7, s), (50, 3, 7, s)]
    empty = bsi_topk.quantise(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert bsi_topk.top_k(empty, empty).count() == 0
    big = spark.createDataFrame([(0, [1.0, 3.6e16]), (50, [0.5, 1.0])], "vec_id long, embedding array<double>").select("*", F.lit(1).alias("dim"), F.lit(2).alias("block"), F.lit(3).alias("queries"))
    with pytest.raises(Exception, match="too large a component"):
        v = bsi_topk.quantise(big, "vec_id", "embedding")
        bsi_topk.top_k(v, v).collect()
    far = big.withColumn("embedding", F.transform("embedding", lambda x: F.least(x, F.lit(5e6))))
    v = bsi_topk.quantise(far, "vec_id", "embedding")
    assert [tuple(r) for r in bsi_topk.top_k(v, v).orderBy("query_id").collect()] == [(0, 1, 50, 256 * 128 + 1_280_000_000 * 256), (50, 1, 0, 256 * 128 + 1_280_000_000 * 256)]


def test_simhash(docs, nothing):
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].fingerprint == "0" * 16 and by_id[4].component_id == by_id[5].component_id == by_id[3].component_id == by_id[10].component_id == 3
    assert by_id[2].component_id == 1 and by_id[7].component_id == 6
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id), key=int) == [1, 3, 6, 8, 9]
    assert simhash.near_groups(nothing).count() == 0 and simhash.dedup(nothing).count() == 0


UNIQUE = {k: " ".join(f"{k}{i * 7919 % 1000}" for i in range(60)) for k in "tuvwx"}
ONE_ID = [(1, UNIQUE["t"]), (5, UNIQUE["t"]), (5, UNIQUE["u"]), (7, UNIQUE["v"]), (7, UNIQUE["w"]), (7, UNIQUE["w"]), (8, UNIQUE["v"]), (None, UNIQUE["x"]), (None, UNIQUE["x"]), (None, UNIQUE["t"])]


def test_simhash_keeps_every_unique_text(spark):
    """An id with several texts: each text is judged by itself."""
    d = spark.createDataFrame(ONE_ID, "doc_id long, text string").select("*", F.lit(1).alias("_quillon_h0"), F.lit(2).alias("fp"))
    got = sorted(((r.doc_id or 0, r.text) for r in simhash.dedup(d).collect()))
    assert got == sorted([(1, UNIQUE["t"]), (5, UNIQUE["u"]), (7, UNIQUE["v"]), (7, UNIQUE["w"]), (0, UNIQUE["x"]), (0, UNIQUE["x"]), (0, UNIQUE["t"])])
    same = spark.createDataFrame([(3, UNIQUE["t"]), (3, UNIQUE["t"] + " " + UNIQUE["t"]), (4, UNIQUE["t"])], "doc_id long, text string")
    assert len({r.component_id for r in simhash.near_groups(same).collect()}) == 1
    assert [r.doc_id for r in simhash.dedup(same).collect()] == [3]


def test_paragraphs_of_one_id(spark):
    """Rows of one id, or without one, lose only their own repeated lines."""
    line = "a line of seven words that repeats"
    rows = [(5, f"{line}\nonly in the first text of five"), (5, f"second text of five is its own\n{line}"), (9, f"nine\n{line}\nnine more words of its own here"), (None, f"x\n{line}"), (None, "y stands alone here")]
    out = sorted(r.text for r in paragraph_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    gone = [t.replace(line, "").strip("\n") for _, t in rows]
    assert sum(line in t for t in out) == 1 and sorted(t.replace(line, "").strip("\n").replace("\n\n", "\n") for t in out) == sorted(g.replace("\n\n", "\n") for g in gone)


def test_exact(docs, nothing):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    empties = [r for r in got if r.text_sha256 == sha("")]
    assert len(empties) == 4 and {r.keep_id for r in empties} == {5} and {r.group_size for r in empties} == {4}
    assert [r.doc_id for r in empties if r.kept] == [5]
    sevens = [r for r in got if r.doc_id == 7]
    assert sorted(r.kept for r in sevens) == [False, True] and {r.group_size for r in sevens} == {3}
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0) for r in kept.collect())) == [0, 2, 5, 7, 8, 9, 10]
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.dedup(nothing).count() == 0


def test_paragraphs(docs, nothing):
    got = {r.doc_id: r for r in paragraph_dedup.near_paragraphs(docs).collect() if r.doc_id}
    assert got[1].n_removed == 0 and got[2].removed == [0] and got[2].classes[0].class_doc == 1
    assert got[3].n_paragraphs == got[4].n_paragraphs == got[10].n_paragraphs == 0
    assert got[7].n_removed == 1 and got[6].n_removed == 0
    out = paragraph_dedup.remove(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert {r.doc_id: r.text for r in out.collect()}[2] == ""
    assert paragraph_dedup.near_paragraphs(nothing).count() == 0


def test_suffixes(docs, nothing):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert by_id[1].n_removed == 0 and by_id[2].n_removed == by_id[2].n_bytes and by_id[2].n_spans == 1
    assert by_id[7].n_removed == len(LONG) and by_id[6].n_removed == 0 and by_id[8].n_removed == 0
    assert by_id[3].n_bytes == 0 and by_id[3].kept_sha256 == sha("")
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.taken <= 3 * r["size"] for r in got)
    taken = {}
    for r in got:
        taken.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(n - t) <= 1 for n, t in taken.values())
    mixed = mixing.Mix(docs).documents()
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in mixed.select("text").collect()) == sum(r.taken for r in got)
    assert mixing.mix(nothing).count() == 0 and mixing.Mix(nothing).documents().count() == 0


def test_bpe(docs, nothing):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(vocabulary_path())
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.Tokenizer(docs, vocabulary_path()).digest(docs).collect()}
    want = set()
    for i, t, *_ in ROWS:
        ids = ref.encode(text_of(t), add_special_tokens=False).ids
        want.add((i, sha(",".join(map(str, ids))), sha(ref.decode(ids, skip_special_tokens=False)), len(ids)))
    assert got == want
    assert bpe.Tokenizer(nothing, vocabulary_path()).digest(nothing).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, None, None, "first"), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 1, "assistant", "x"), (2, 0, "a\nb\\n", "<|im_start|>\\<|"), (2, 1, "assistant", "y" * 200_000)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit("c").alias("prompt"), F.lit(1).alias("n"), F.lit(2).alias("formatted"))
    read = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_rows(t))).collect()}
    assert [tuple(x) for x in read[1].turns] == [("", "first"), ("user", ""), ("user", "b"), ("user", "b")]
    assert [tuple(x) for x in read[2].turns] == [("a\nb\\n", "<|im_start|>\\<|"), ("assistant", "y" * 200_000)]
    assert read[None].losses == ["x"] and read[2].losses == ["y" * 200_000] and read[1].losses == []
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.read_back(chat.format_turns(chat.canonical_rows(empty)))).count() == 0


def test_pii(docs, nothing):
    got = pii.find(docs).collect()
    assert len(got) == len(ROWS)
    nine = next(r for r in got if r.doc_id == 9)
    assert (nine.n_email, nine.n_ip, nine.n_card, nine.n_phone) == (1, 0, 1, 1)
    assert "a@b.co" not in nine.sanitised and "[EMAIL]" in nine.sanitised
    assert pii.find(nothing).count() == 0


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (6, 0), (6, 0), (99, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    blank = quality.train(nothing, labels.limit(0))
    assert quality.score(nothing, blank).count() == 0 and {r.score for r in quality.score(docs, blank).collect()} == {0.5}


def test_pipeline_stages(spark, docs, nothing, sf_dir):
    for d in (docs, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, sf_dir)
            assert out.columns == d.columns, name
            assert out.count() <= 3 * len(ROWS)
        assert corpus_pipeline.STAGES[-1][1](spark, d, sf_dir).count() == d.count()
