"""Plans and bounds: what must hold at any size."""

import re

from pyspark.sql import functions as F

from quillon.llm import bsi_topk, chat, common, mixing, paragraph_dedup, quality, simhash


def plan(df):
    return df._jdf.queryExecution().toString()


def test_native_operators_have_no_python(spark, sf_dir):
    turns = chat.canonical_rows(common.read_table(spark, sf_dir, "conversations"))
    out = plan(chat.digest(chat.read_back(chat.format_turns(turns))))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", out)
    mixed = plan(mixing.Mix(common.read_table(spark, sf_dir, "documents")).documents())
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", mixed)


def test_no_cross_joins(spark, sf_dir):
    v = bsi_topk.quantise(common.read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    assert not re.search("CartesianProduct|BroadcastNestedLoop|HashJoin|SortMergeJoin", plan(bsi_topk.top_k(v, v.where("vec_id % 50 = 0"))))


def test_copies_cost_one_print(spark):
    """A text that most rows share is one posting, whatever the number of its copies."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("own words of row "), F.col("id").cast("string"))).otherwise(F.lit("the same words in every copy")).alias("text"))
    got = simhash.near_groups(docs).groupBy("component_id").count().orderBy(F.desc("count")).first()
    assert got["count"] >= 4500


def test_weak_collisions_stay_in_their_lists(spark):
    """A long chain of paragraphs of little similarity grows into one group, which is compared list by list."""
    lines = [" ".join(f"w{j}" for j in range(4 * k, 4 * k + 24)) for k in range(300)]
    lines += [f"{lines[k]} more" for k in range(0, 300, 50)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = docs.select("doc_id", simhash.text_hash("text").alias("h"), "text")
    signed = rows.mapInArrow(paragraph_dedup._sign(1), "doc_id long, h long, para int, ph binary, bands array<long>")
    distinct = common.materialize(signed.groupBy("ph").agg(F.min(F.struct("doc_id", "h", "para", "bands")).alias("at")))
    whole, parted = (paragraph_dedup.compared(rows, distinct, limit).groupBy("deal").count().agg(F.max("count")).first()[0] for limit in (4096, 20))
    assert whole > 100 and parted <= 40
    for limit in (4096, 20, 2):
        got = {r.doc_id for r in paragraph_dedup.near_paragraphs(docs, group_limit=limit).where("n_removed > 0").collect()}
        assert got == set(range(300, 306))


def test_label_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words "), F.repeat(F.lit("a b "), (F.col("id") % 5).cast("int"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 5 > 2).cast("int").alias("quality"))
    model = quality.train(docs, labels, max_rows=200, trees=20)
    scored = quality.score(docs, model).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in scored) > 0.9 * len(scored)


def test_drop_bits_never_change_a_result(spark, sf_dir):
    v = bsi_topk.quantise(common.read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    q = v.where("vec_id % 100 = 0")
    want = sorted(map(tuple, bsi_topk.top_k(v, q, k=7, drop_bits=0, block_rows=100, query_rows=3).collect()))
    for drop in (1, 3, 6):
        assert sorted(map(tuple, bsi_topk.top_k(v, q, k=7, drop_bits=drop, block_rows=300).collect())) == want
