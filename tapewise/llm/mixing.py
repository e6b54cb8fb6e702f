"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents one after another, are packed into blocks
of a fixed number of words.  A source gets a number of output slots that
follows its target; the slots are dealt to the output shards by keyed hash, so
that a shard's counts of each source are multinomial draws, given the totals.
Slot j of a source shows block perm(j mod blocks), where perm is a pseudorandom
permutation of the source's block numbers, another one for each pass over the
source (swap-or-not rounds: each is its own inverse, so that any number of
rounds is a bijection).  Slots and documents meet in a join by block number.

A source, null included, may hold most rows: documents are numbered within
buckets of a few thousand, and only sums of buckets are added up by source.
Rows that repeat each other are counted first and stand one after another.
Of sources there is one row each, sorted in one task for their weights; all
else is dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

BLOCK = 64
SHARD_SLOTS = 4096
BUCKET_ROWS = 512
ROUNDS = 8
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """source, source_size -> with weight and target.

    Sources in code point order, null last, weigh ``weights`` in turn and share all words; none gets
    more than ``cap`` times its size, and what is above is shared by the others by weight.  With
    sources by cap / weight, the first k are at their caps and the rest have the level
    (all words - caps of the first k) / (weights of the rest).
    One row for each source; a source without words has target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("weight", w).withColumn("most", F.lit(cap) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("all_words", F.sum("source_size").over(whole))
    out = out.withColumn("level", (F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    # the true level is the first one that its own source's cap does not undercut
    out = out.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return out.withColumn("target", target).select("source", "source_size", "weight", "target")


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """The place of ``index`` (0 to size - 1) in a permutation chosen by ``key``."""

    def swap_or_not(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, F.lit(0), *key), size) - x, size)
        return F.when(F.xxhash64(r, F.lit(1), F.greatest(x, partner), *key) % 2 == 0, partner).otherwise(x)

    # a fold, not a chain of columns: the optimiser would write out each round's value within the next
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap_or_not)


def offsets(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (source, bucket, size, copies, ...) with ``start``: the words of the source before each document."""
    words = F.col("size") * F.col("copies")
    sums = docs.groupBy("source", "bucket").agg(F.sum(words).alias("_sum"))
    # two steps, so that no task adds up more than a root of the buckets
    step = max(1, int(buckets**0.5))
    sums = sums.withColumn("_group", (F.col("bucket") / step).cast("long"))
    groups = sums.groupBy("source", "_group").agg(F.sum("_sum").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_base", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words")
    within = Window.partitionBy("source", "_group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_in", F.coalesce(F.sum("_sum").over(within), F.lit(0)))
    g, s = groups.alias("g"), sums.alias("s")
    base = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s._group") == F.col("g._group"))).select("s.source", "s.bucket", (F.col("_in") + F.col("_base")).alias("_before"))
    own = Window.partitionBy("source", "bucket").orderBy("doc_id", "_tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    d, b = docs.withColumn("_own", F.coalesce(F.sum(words).over(own), F.lit(0))).alias("d"), base.alias("b")
    joined = d.join(b, F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket")))
    return joined.select("d.*", (F.col("_own") + F.col("_before")).alias("start")).drop("_own")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, block: int = BLOCK, seed: int = 0, tie: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, slots) of the mix of ``docs`` (doc_id, source, text; other columns are ignored).

    documents: doc_id, source, size, source_size, target, taken (words of the document in the mix,
    repeats counted), start (its first word's place in the source), blocks.  One row for each row of
    ``docs``.  A null text has size 0; null sources are one source; rows with equal ids are separate
    documents; an empty table gives empty results.
    slots: shard, source, slot, block, epoch: what each slot of the mix shows.
    The same rows, parameters and seed give the same mix, however they are partitioned.  ``tie`` (long;
    a hash of the text unless given) tells rows of one id apart: rows equal in it are interchangeable.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), (F.xxhash64("text") if tie is None else tie).alias("_tie"))
    spark = docs.sparkSession
    # texts are read once: what follows uses the stored sizes several times
    sized = store(sized)
    copies = sized.groupBy("doc_id", "source", "size", "_tie").agg(F.count("*").alias("copies"))
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    copies = copies.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(buckets)))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    # a slot shows source_size / blocks words on average; a target at its cap is cap times all blocks
    slots_of = F.when(F.col("source_size") > 0, F.least(F.floor(F.lit(cap) * F.col("blocks")), F.round(F.col("target") * F.col("blocks") / F.col("source_size")))).otherwise(0).cast("long")
    sources = sources.withColumn("n_slots", slots_of).withColumn("all_slots", F.sum("n_slots").over(Window.partitionBy()))
    placed = offsets(copies, buckets)
    placed = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = placed.withColumn("start", F.col("start") + F.col("_copy") * F.col("size")).drop("_copy", "copies")
    p, s = placed.alias("p"), sources.alias("s")
    placed = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.*", "source_size", "target", "blocks")
    # slots: ranges of a source's slots first, so that a source of any size is spread over tasks
    span = 1 << 14
    ranges = sources.filter("n_slots > 0").withColumn("_range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / span))))
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = ranges.repartition(width, "source", "_range")
    slots = ranges.withColumn("slot", F.explode(F.sequence(F.col("_range") * span, F.least(F.col("n_slots"), (F.col("_range") + 1) * span) - 1)))
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
    slots = slots.withColumn("block", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("epoch"), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()))
    shards = F.greatest(F.lit(1), F.ceil(F.col("all_slots") / SHARD_SLOTS)).cast("long")
    slots = slots.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "source", F.col("source").isNull(), "slot"), shards))
    slots = slots.select("shard", "source", "slot", "block", "epoch")
    return placed, slots


def taken(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """``placed`` with ``taken``: the words of each document in the blocks that slots show."""
    shown = slots.groupBy("source", "block").agg(F.count("*").alias("_times"))
    parts = placed.filter("size > 0").select("source", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    parts = parts.withColumn("_words", end - F.greatest(F.col("start"), F.col("block") * block))
    # both sides grow with the corpus, which the planner cannot see behind the exploded slots
    a, b = parts.alias("a"), shown.hint("merge").alias("b")
    met = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block")))
    # a document is its first word's place in its source: no two with words share one
    sums = met.groupBy("a.source", "a.start").agg(F.sum(F.col("_words") * F.col("_times")).cast("long").alias("taken"))
    d, t = placed.alias("d"), sums.hint("merge").alias("t")
    out = d.join(t, F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.start") == F.col("t.start")) & (F.col("d.size") > 0), "left")
    return out.select("d.*", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as rows with the columns of ``docs`` (doc_id, text, source, ... n_chars).

    One row for each document and pass over its source in which the mix shows any of its words: the
    text as it is where all its blocks are shown, else the words of the shown blocks, joined by one
    space; n_chars, if there, follows the text.  Documents without words (null texts too), and those that
    no slot shows, are left out.  Null ids and null sources stay; repeated rows are separate documents;
    rows that differ in any column keep their own; further columns may have any names; an empty table
    gives an empty table.
    """
    fields = [f"`{c}`" for c in docs.columns]
    # all columns but the text travel as one, so that no name clashes
    rows = docs.select(F.struct(*fields).alias("_row"), *[F.col(c) for c in ("doc_id", "source", "text")], F.xxhash64(*[f"`{f.name}`" for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]).alias("_tie"))
    placed, slots = mix(rows, weights, cap, block, seed, F.col("_tie"))
    parts = placed.filter("size > 0").select("doc_id", "_tie", "source", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    a, b = parts.alias("a"), slots.select("source", "block", "epoch").hint("merge").alias("b")
    met = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block")))
    # a document's blocks are as many as its words allow, whatever the source's size
    shown = met.groupBy("doc_id", "_tie", "a.source", "start", "size", "epoch").agg(F.array_sort(F.collect_list("a.block")).alias("_shown"))
    all_blocks = F.floor((F.col("start") + F.col("size") - 1) / block) - F.floor(F.col("start") / block) + 1
    shown = shown.withColumn("_whole", F.size("_shown") == all_blocks)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("_k1"), F.col("doc_id").isNull().alias("_k2"), F.col("_tie").alias("_k3")]
    texts = rows.select("_row", "text", *key).dropDuplicates(["_k1", "_k2", "_k3"])
    both = texts.join(shown.select(*key, F.col("start").alias("_start"), F.col("size").alias("_size"), "_shown", "_whole").hint("merge"), ["_k1", "_k2", "_k3"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    low = lambda x: F.greatest(x * block - F.col("_start"), F.lit(0))
    high = lambda x: F.least((x + 1) * block - F.col("_start"), F.col("_size"))
    cut = F.array_join(F.flatten(F.transform("_shown", lambda x: F.slice(F.col("_words"), (low(x) + 1).cast("int"), (high(x) - low(x)).cast("int")))), " ")
    both = both.withColumn("_words", F.when(~F.col("_whole"), words)).withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(cut))
    of = {"text": F.col("text"), **({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return both.select(*[of.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
