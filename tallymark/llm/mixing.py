"""Mixing sources to target weights by a low-discrepancy schedule.

A golden-ratio sequence of points is mapped through the cumulative target shares to give each
schedule slot a source; slots are ranked within their source; and the slot of rank *r* takes the
source's *r*-th block of equally many words from its documents in shuffled order, the last one cut to the target. A source that
is taken more than once starts its shuffled stream again (another epoch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, pack_columns, table, unpack_columns

#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Each shuffled source is numbered in this many ranges of its shuffle key, so that no source is one task.
SHARDS = 1024
#: Cells of the unit interval by which points find their source.
CELLS = 4096
#: Slots of the schedule that are ranked together.
SEGMENT = 1024


#: Copies of one row that are numbered together.
TWINS = 1024


def word_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``; a null text has size 0."""
    return docs.select("doc_id", "source", _size().alias("size"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """``source, source_size, target`` for each source of ``sizes(source, size)``.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share ``share`` times
    all words. No target is above ``repeats`` times its source's size; what exceeds that is shared
    by weight among the others until none is above. That fixed point is a water level: the
    largest, over the sources sorted by cap / weight, of what is left divided by the weight left.
    Works on one row a source.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = per.withColumn("before", F.sum("cap").over(by_ratio) - F.col("cap")).withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    per = per.withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("left")).over(everything))
    return per.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def schedule(goals: DataFrame, block_words: int) -> DataFrame:
    """``slot, source, rank``: one row for each block of the mix; in order of slot, then source, they are the mix.

    ``goals(source, target)``. Point *i* is the fractional part of (i + 1/2) times the golden
    ratio; it falls into one source's interval of the cumulative shares. The rank counts a
    source's earlier slots; it is numbered by segments of the schedule, so no source is one task.

    A source has as many blocks as its target needs, the last one cut to it. The points give that number but for a
    few slots, so slots beyond it go, and blocks that no point gave a slot stand where their rank would be in an even spread;
    a source whose target is less than one block has its block all the same.
    """
    spark = goals.sparkSession
    w = Window.orderBy(F.col("source").asc_nulls_last())
    shares = goals.filter("target > 0").withColumn("hi", F.sum("target").over(w)).withColumn("total", F.sum("target").over(Window.partitionBy()))
    shares = shares.select("source", "total", F.ceil(F.round("target") / block_words).alias("quota"), (F.col("hi") / F.col("total")).alias("hi"), ((F.col("hi") - F.col("target")) / F.col("total")).alias("lo"))
    found = shares.agg(F.max("total"), F.count("*")).first()
    slots, parts = -int(-(found[0] or 0.0) // block_words), max(CELLS, found[1])
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * parts), F.least(F.floor(F.col("hi") * parts), F.lit(parts - 1)))))
    # the last source's interval is closed, so that rounding leaves no point without a source
    cells = cells.withColumn("hi", F.when(F.col("hi") >= 1 - 1e-12, F.lit(2.0)).otherwise(F.col("hi")))
    points = spark.range(slots).withColumnRenamed("id", "slot")
    points = points.withColumn("at", (F.col("slot") + 0.5) * GOLDEN).withColumn("at", F.col("at") - F.floor("at")).withColumn("cell", F.floor(F.col("at") * parts))
    hits = points.join(cells, "cell").filter("at >= lo and at < hi").select("slot", "source", "quota", F.expr(f"slot div {SEGMENT}").alias("segment"))
    counts = hits.groupBy("source", "segment").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("segment")) - F.col("n")).withColumnRenamed("source", "s").withColumnRenamed("segment", "g").drop("n")
    local = hits.withColumn("i", F.row_number().over(Window.partitionBy("source", "segment").orderBy("slot")))
    ranked = local.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("segment") == F.col("g"))).withColumn("rank", F.col("before") + F.col("i") - 1)
    given = hits.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    short = shares.join(given, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).filter("n < quota")
    extra = short.withColumn("rank", F.explode(F.sequence("n", F.col("quota") - 1)))
    return ranked.filter("rank < quota").select("slot", "source", "rank").unionByName(extra.select(F.floor((F.col("rank") + 0.5) / F.col("quota") * slots).alias("slot"), "source", "rank"))


def extents(items: DataFrame, seed: int) -> DataFrame:
    """Adds ``first``: how many words of its source come before an item in the source's shuffled order.

    ``items(key, doc_id, source, size, copies)``: ``copies`` equal rows of ``size`` words. Order: a seeded 64-bit hash of the key,
    then the key, doc_id and size. Sums run within ranges of the hash and over the ranges' totals, so a source of a third of all
    rows is spread over many tasks.
    """
    keyed = items.withColumn("order", F.xxhash64(F.lit(seed), "key")).withColumn("shard", F.shiftrightunsigned("order", 64 - SHARDS.bit_length() + 1)).withColumn("words", F.col("size") * F.col("copies"))
    inner = Window.partitionBy("source", "shard").orderBy("order", "key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = keyed.groupBy("source", "shard").agg(F.sum("words").alias("n"))
    totals = totals.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("shard")) - F.col("n")).select(F.col("source").alias("s"), F.col("shard").alias("g"), "before")
    local = keyed.withColumn("upto", F.sum("words").over(inner))
    return local.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("g"))).withColumn("first", F.col("before") + F.col("upto") - F.col("words")).drop("s", "g", "before", "upto", "order", "shard", "words")


def twins(items: DataFrame) -> DataFrame:
    """One row for each of ``copies``, numbered by ``twin``; many are made in steps, so no array grows with them."""
    some = items.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {TWINS}"))))
    return some.withColumn("twin", F.explode(F.sequence(F.col("step") * TWINS, F.least(F.col("copies"), (F.col("step") + 1) * TWINS) - 1))).drop("step", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, slots: int = 65536, max_block: int = 4096, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, source, text[, key])``: ``(documents, pieces)``.

    ``documents``: ``key, twin, doc_id, source, size, source_size, target, taken``, one row for each input
    row. ``pieces``: ``slot, key, twin, doc_id, source, size, epoch, from_word, to_word``: what each slot of the
    schedule takes of which document; by slot, then source, they are the mixed corpus.

    ``key`` names a row by its content (default: a hash of doc_id, source and text), and ``twin`` numbers rows of equal content, so the
    mix does not depend on how the table is split. A block has as many words as split the mix into ``slots``, within 1 and
    ``max_block``; a source's last block is cut to its target, so at every size a source's taken words are its target, rounded.
    Null texts and texts without words have size 0 and are taken 0 times; a null source is a source;
    repeated rows are documents of their own; an empty table gives empty results; other columns are ignored.
    """
    key = F.col("key") if "key" in docs.columns else F.xxhash64("doc_id", "source", "text")
    items = cut(docs.select(key.alias("key"), "doc_id", "source", _size().alias("size")).groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("copies")))
    goals = cut(targets(items.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, share, repeats))
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, min(max_block, int(total // slots)))
    goal = goals.withColumnRenamed("source", "s")
    placed = twins(extents(items.filter("size > 0"), seed)).withColumn("first", F.col("first") + F.col("twin") * F.col("size")).join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("lo", F.col("first") + F.col("epoch") * F.col("source_size"))
    passes = passes.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.round("target").cast("long"))).filter("lo < hi")
    passes = passes.withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    plan = schedule(goals, block).withColumnRenamed("source", "s").withColumnRenamed("rank", "r")
    pieces = passes.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r"))).select(
        "slot", "key", "twin", "doc_id", "source", "size", "epoch",
        (F.greatest("lo", F.col("rank") * block) - F.col("lo")).alias("from_word"),
        (F.least("hi", (F.col("rank") + 1) * block) - F.col("lo")).alias("to_word"),
    )
    names = ["key", "doc_id", "source", "size", "twin"]
    taken = pieces.groupBy(*[F.col(c).alias(f"_{c}") for c in names]).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    documents = twins(items).join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s").join(taken, same, "left")
    return documents.select("key", "twin", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")), pieces


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed corpus as documents, with all columns of ``docs`` (none of them a map).

    A document comes once for each epoch that takes words of it. Where the mix ends inside a
    document, that copy holds the words taken, joined by spaces; ``n_chars`` follows the text.
    Texts are shuffled once, to meet their placements; of rows that are equal in all columns one stands for all.
    """
    packed = pack_columns(docs).withColumn("key", F.xxhash64("doc_id", "text", "rest"))
    _, pieces = mix(packed.select("doc_id", "text", F.col("rest.source").alias("source"), "key"))
    copies = pieces.groupBy("key", "doc_id", "size", "twin", "epoch").agg(F.min("from_word").alias("a"), F.max("to_word").alias("b"))
    copies = copies.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), "size", "a", "b")
    whole = packed.groupBy("key", "doc_id").agg(F.first("text").alias("text"), F.first("rest").alias("rest"))
    joined = whole.join(copies, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")), " ")
    taken = joined.withColumn("text", F.when(F.col("b") - F.col("a") < F.col("size"), part).otherwise(F.col("text")))
    return unpack_columns(taken, docs.columns, counted=True)
