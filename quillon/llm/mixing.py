"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in a pseudorandom order, are one stream of words that is packed into blocks of
``block_words`` (the last one may be short). A source's target is met by ``rank`` after ``rank``: every full turn takes
each block once, the last turn a part of the blocks, and the very last block is cut where the target is reached, so
a source's words equal its target to within rounding and no document is taken more often than the target's multiple
of its source.

The mix is laid out in shards of ``shard_slots`` slots. Each slot draws a number below the total of all slots, without
replacement, through a pseudorandom permutation (swap-or-not, keyed by the seed); the numbers are dealt to the sources
in proportion to their targets. So a shard's source counts are one multinomial draw, conditioned on the sources' totals:
unconditioned draws would miss a target of n blocks by the root of n, and exceed the cap. The number's place among its
source's is the slot's rank, and a permutation of that source's block numbers (keyed by source and turn) maps it to a
block, with which slots are joined by index. ``shards`` returns the mix as it is laid out; what is taken of each
document, and the documents themselves, are counted from the same slots.

Nothing is gathered in one task: a slot's number, source, rank and block are arithmetic on the slot itself, and streams
are numbered by sums over chunks of hashed ids, whose number grows with the rows, so a source with a third of all rows
is spread over as many chunks and slots as it needs. What runs in one task is the list of sources (some numbers each:
names, weights and targets depend on all before them) and, for each source, the list of its chunks' sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, release

ROUNDS = 24
WORD = r"[^\x20\x09-\x0D]+"
CAP = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0. Counts the starts of words: a split by one blank is cheap."""
    blanks = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(blanks, " "), "")).cast("long")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, exact for every n (swap-or-not: Hoang, Morris, Rogaway 2012)."""
    key = F.xxhash64(*key)

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap)


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), weights: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """(sid, source, source_size, docs, weight, target): words to take of each source, numbered in their order.

    ``sizes`` has (source, source_size, docs). Sources by code point, null last, weigh by ``cycle``, repeating, unless
    ``weights`` (source, weight > 0) is given. The sizes' total is shared by weight; a target stops at ``cap`` times
    its source's size and the excess goes to the rest by weight until none is above. In closed form: sources that
    reach their cap first (least cap for their weight) are filled first, and the rest share one level.
    """
    order = Window.partitionBy().orderBy(F.asc_nulls_last("source"))
    sizes = sizes.withColumn("sid", F.row_number().over(order).cast("long"))
    if weights is None:
        w = F.element_at(F.array(*map(F.lit, cycle)), ((F.col("sid") - 1) % len(cycle) + 1).cast("int"))
        rows = sizes.withColumn("weight", w.cast("double"))
    else:
        named = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double"))
        rows = sizes.join(named, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").na.fill(0.0, ["weight"])
    limit = F.col("source_size") * cap
    by_need = Window.partitionBy().orderBy((limit / F.nullif(F.col("weight"), F.lit(0.0))).asc_nulls_last(), F.asc_nulls_last("source"))
    everything, before = Window.partitionBy(), by_need.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("weight").over(everything))
    rows = rows.withColumn("_filled", F.coalesce(F.sum(F.when(F.col("weight") > 0, limit)).over(before), F.lit(0))).withColumn("_spent", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", F.when(F.col("weight") > 0, (F.col("_total") - F.col("_filled")) / (F.col("_weights") - F.col("_spent"))))
    stops = F.col("weight") * F.col("_level") <= limit
    rows = rows.withColumn("_n", F.row_number().over(by_need))
    rows = rows.withColumn("_at", F.min(F.when(stops, F.struct("_n", "_level"))).over(everything)["_level"])
    target = F.least(limit.cast("double"), F.col("weight") * F.coalesce("_at", F.lit(float("inf"))))
    return rows.select("sid", "source", "source_size", "docs", "weight", F.when(F.col("weight") > 0, target).otherwise(0.0).alias("target"))


def _streams(sized: DataFrame, rows_a_chunk: int) -> DataFrame:
    """``sized`` with start: the words of the source before the row, in the order of hashed ids."""
    chunks = max(1, -(-sized.count() // rows_a_chunk))
    sized = sized.withColumn("_h", F.xxhash64("doc_id", "key")).withColumn("_chunk", F.pmod("_h", F.lit(chunks)))
    totals = sized.groupBy("sid", "_chunk").agg(F.sum("size").alias("_words"))
    base = F.sum("_words").over(Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select(F.col("sid").alias("_sid"), F.col("_chunk").alias("_c"), F.coalesce(base, F.lit(0)).alias("_base"))
    own = Window.partitionBy("sid", "_chunk").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("_before", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = local.join(bases, (F.col("sid") == F.col("_sid")) & (F.col("_chunk") == F.col("_c")))
    return joined.withColumn("start", F.col("_base") + F.col("_before")).drop("_h", "_chunk", "_base", "_before", "_sid", "_c")


def numbered(sources: DataFrame, block_words: int) -> DataFrame:
    """(sid, size, blocks, full, turns, rest, slots, base): the slots of each source, and the first number dealt to it.

    ``sources`` has (sid, source_size, take). A source of s words has its full blocks permuted anew in each turn and
    its short block, if any, last; so the words of the first ranks are known without a look at the blocks.
    """
    size, take, b = F.col("source_size"), F.col("take"), block_words
    blocks, full = F.ceil(size / b).cast("long"), F.floor(size / b).cast("long")
    turns, rest = F.floor(take / size).cast("long"), take % size
    s = sources.where((size > 0) & (take > 0)).select("sid", size.alias("size"), blocks.alias("blocks"), full.alias("full"), turns.alias("turns"), rest.alias("rest"), (turns * blocks + F.ceil(rest / b)).cast("long").alias("slots"))
    before = Window.partitionBy().orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("base", F.coalesce(F.sum("slots").over(before), F.lit(0)).cast("long"))


def draw(sources: DataFrame, seed: int = 0, shard_slots: int = 1024, block_words: int = 256, task_slots: int = 20_000) -> DataFrame:
    """(shard, slot, sid, rank, turn, block, words): every slot of every output shard; ``sources`` as for ``numbered``."""
    spark, b = sources.sparkSession, block_words
    s = materialize(numbered(sources, block_words))
    n, total = s.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    # a number meets its source through equal bins, as many as sources, so that the numbers of a bin and the sources that
    # begin or end in it meet in about two pairs a number, whatever the sources' sizes
    width = max(1, -(-total // max(n, 1)))
    bins = s.select("*", F.explode(F.sequence(F.floor(F.col("base") / width).cast("long"), F.floor((F.col("base") + F.col("slots") - 1) / width).cast("long"))).alias("bin"))
    bins = F.broadcast(bins) if n <= 100_000 else bins  # two rows a source at most
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_slots))
    number = permuted(F.col("id"), F.lit(max(total, 1)).cast("long"), F.lit(seed))
    slots = spark.range(0, total, 1, parts).select(F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), (F.col("id") % shard_slots).alias("slot"), number.alias("number"))
    slots = slots.withColumn("bin", F.floor(F.col("number") / width).cast("long")).join(bins, "bin").where((F.col("number") >= F.col("base")) & (F.col("number") < F.col("base") + F.col("slots")))
    slots = slots.withColumn("rank", F.col("number") - F.col("base")).withColumn("turn", F.floor(F.col("rank") / F.col("blocks")).cast("long")).withColumn("at", F.col("rank") % F.col("blocks"))
    block = F.when(F.col("at") < F.col("full"), permuted(F.col("at"), F.greatest("full", F.lit(1)), F.lit(seed), F.col("sid"), F.col("turn"))).otherwise(F.col("at"))
    held = F.least(F.lit(b).cast("long"), F.col("size") - F.col("block") * b)
    words = F.when(F.col("turn") < F.col("turns"), held).otherwise(F.least(held, F.col("rest") - F.col("at") * b))
    return slots.withColumn("block", block).select("shard", "slot", "sid", "rank", "turn", "block", words.alias("words"))


class Mix:
    """The plan of one mix: its sources, its documents' places in the streams, its slots."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, seed: int = 0, block_words: int = 256, shard_slots: int = 1024, rows_a_chunk: int = 5_000):
        self.docs, self.id_col, self.text_col, self.source_col, self.block_words = docs, id_col, text_col, source_col, block_words
        self.key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), self.key.alias("key"))
        sized = materialize(rows)
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        self.sources = materialize(targets(sizes, weights=weights).withColumn("take", F.round("target").cast("long")))
        named = sized.join(self.sources.select(F.col("source").alias("_s"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        self.rows = materialize(_streams(named, rows_a_chunk))
        release(sized)
        self.slots = draw(self.sources, seed, shard_slots, block_words)

    def shard_counts(self) -> DataFrame:
        """(shard, sid, n): how many slots of each shard a source has drawn."""
        return self.slots.groupBy("shard", "sid").agg(F.count("*").alias("n"))

    def shards(self) -> DataFrame:
        """(shard, slot, source, block, n_words, text): the mix as it is laid out, each shard whole in one partition and in
        the order of its slots. A block's text is its words, one blank between."""
        rows = self.rows.where(F.col("size") > 0).select("sid", "start", F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("key").alias("_k"))
        words = F.regexp_extract_all(F.col(self.text_col).cast("string"), F.lit(WORD), F.lit(0))
        texts = self.docs.select(F.col(self.id_col).cast("long").alias("_id"), F.col(self.source_col).cast("string").alias("_source"), self.key.alias("_key"), words.alias("_words")).dropDuplicates(["_id", "_source", "_key"])
        joined = texts.join(rows, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")))
        b, end = self.block_words, F.col("start") + F.size("_words")
        parts = joined.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b).cast("long"), F.floor((end - 1) / b).cast("long"))))
        lo, hi = F.greatest(F.col("block") * b - F.col("start"), F.lit(0)), F.least((F.col("block") + 1) * b, end) - F.col("start")
        parts = parts.select("sid", "block", "start", F.slice("_words", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
        blocks = parts.groupBy("sid", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda x: x["part"])).alias("all"))
        named = self.sources.select("sid", "source")
        out = self.slots.join(blocks, ["sid", "block"]).join(named, "sid").select("shard", "slot", "source", "block", F.col("words").alias("n_words"), F.array_join(F.slice("all", F.lit(1), F.col("words").cast("int")), " ").alias("text"))
        return out.repartition("shard").sortWithinPartitions("shard", "slot")

    def pieces(self) -> DataFrame:
        """A row for each document and block that share words: block, and from and to within the block."""
        b, start, end = self.block_words, F.col("start"), F.col("start") + F.col("size")
        held = self.rows.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(start / b).cast("long"), F.floor((end - 1) / b).cast("long"))))
        return held.withColumn("lo", F.greatest(start - F.col("block") * b, F.lit(0).cast("long"))).withColumn("hi", F.least(end - F.col("block") * b, F.lit(b).cast("long")))

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken) for each row of the documents."""
        uses = self.slots.groupBy("sid", "block", "words").agg(F.count("*").alias("times"))
        shared = self.pieces().join(uses, ["sid", "block"]).withColumn("got", F.greatest(F.least("hi", "words") - F.col("lo"), F.lit(0).cast("long")) * F.col("times"))
        each = shared.groupBy("sid", "start", "size").agg(F.sum("got").alias("taken"))
        full = self.rows.where(F.col("size") > 0).join(each, ["sid", "start", "size"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
        return full.union(self.rows.where(F.col("size") == 0).select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long")))

    def documents(self) -> DataFrame:
        """The mix itself, with all columns of the documents: a row for each time that a document is taken, with its whole
        text, or with its taken words, one blank between, where blocks at its ends or a last cut leave some out.
        Documents of no words aren't taken. Texts of one id, source and words are the same text."""
        parts = self.pieces().join(self.slots.select("sid", "block", "turn", "words"), ["sid", "block"]).withColumn("hi", F.least("hi", "words")).where(F.col("hi") > F.col("lo"))
        at = F.col("block") * self.block_words - F.col("start")
        runs = parts.groupBy("sid", "start", "size", "doc_id", "key", "source", "turn").agg(F.sort_array(F.collect_list(F.struct((at + F.col("lo")).alias("lo"), (F.col("hi") - F.col("lo")).alias("n")))).alias("runs"), F.sum(F.col("hi") - F.col("lo")).alias("got"))
        runs = runs.select(F.col("doc_id").alias("_quillon_id"), F.col("source").alias("_quillon_source"), F.col("key").alias("_quillon_key"), F.col("size").alias("_quillon_size"), F.col("runs").alias("_quillon_runs"), F.col("got").alias("_quillon_got"))
        once = self.docs.withColumn("_quillon_own", self.key)
        on = F.col(self.id_col).cast("long").eqNullSafe(F.col("_quillon_id")) & F.col(self.source_col).cast("string").eqNullSafe(F.col("_quillon_source")) & (F.col("_quillon_own") == F.col("_quillon_key"))
        words = F.regexp_extract_all(F.col(self.text_col).cast("string"), F.lit(WORD), F.lit(0))
        cut = F.array_join(F.flatten(F.transform("_quillon_runs", lambda r: F.slice("_quillon_words", (r["lo"] + 1).cast("int"), r["n"].cast("int")))), " ")
        repeated = self.rows.groupBy("doc_id", "source", "key").count().where("count > 1")
        if not repeated.isEmpty():  # each repeated row has its own runs, so one of the texts is enough
            once = once.dropDuplicates([self.id_col, self.source_col, "_quillon_own"])
        joined = once.join(runs, on)
        kept = joined.withColumn("_quillon_words", F.when(F.col("_quillon_got") < F.col("_quillon_size"), words))
        text = F.when(F.col("_quillon_got") < F.col("_quillon_size"), cut).otherwise(F.col(self.text_col))
        return kept.select(*(text.alias(c) if c == self.text_col else F.col(c) for c in self.docs.columns))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of ``docs``.

    Null texts have no words; a null source is a source, last in order; repeated rows count each. No document is taken
    more than three times over. Runs of one seed agree. An empty table gives an empty result.
    """
    return Mix(docs, **options).taken().select("doc_id", "size", "source_size", "target", "taken", "source")
