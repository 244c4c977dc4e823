"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Targets: sources share the total by weight; none may exceed `max_repeats` times its size, and what a capped source
leaves is shared again among the others by weight.  With sources ordered by cap over weight the capped ones come
first, so prefix sums give the level at which no source is above its cap.

Schedule: the van der Corput points of 2**slot_bits slots are bit-reversed slot numbers.  Mapped through the
cumulative targets each falls into one source, so every stretch of the schedule holds the sources in proportion.
A source's slots, ranked by slot number, are its blocks of equal numbers of tokens, laid end to end over its
documents in a shuffled order, again and again until its target is met.  A document takes what its blocks cover, and its
first slot, the rank of that block and the offset in it tell where in the mix its words come: blocks in order of
slot, and the documents of a block in order of offset, are the mix (`sequence` lists it, a row for each piece).

Scale: the schedule has 2**slot_bits rows whatever the data, and one row for each source.  Documents are narrow rows
(id, size, source, shuffle key).  Positions come from two-level sums over `buckets` ranges of the shuffle key, so
a source with a third of all rows spreads over all tasks.  Texts are read once: the narrow rows and the schedule are
written to the shared folder, and every later step starts from them.  The shuffle key is a digest of the id, so reruns agree.

Defined results: null and empty texts have size 0 and take nothing; null is a source of its own, after all others;
a total of 0 gives targets of 0.  Rows with equal ids are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornlake.llm.shared import prepare, settled

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> also weight, target.  One row for each source, of which there may be many."""
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(n)) + 1).cast("int")).cast("long")
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("place", F.row_number().over(in_order))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("caps", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    # If this source and all after it were free, a unit of weight would get this much.
    level = (F.col("total") - F.col("caps")) / (F.col("all_weight") - F.col("gone"))
    return (
        ranked.withColumn("level", level)
        .withColumn("free_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("ratio") < F.col("free_level"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("free_level")))
        .select("source", "source_size", "weight", "target")
    )


def schedule(goals: DataFrame, *, slot_bits: int = 16, group_bits: int = 8) -> DataFrame:
    """source, slot (its place in the mix), rank (from 0 among the source's), from_word, to_word (on the source's line)."""
    slots = 1 << slot_bits
    running = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = (
        goals.filter(F.col("target") > 0)
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("upto", F.sum("target").over(running))
        .withColumn("all", F.sum("target").over(Window.partitionBy()))
        .withColumn("cell_end", F.least(F.ceil(F.col("upto") / F.col("all") * slots), F.lit(slots)))
        .withColumn("cell", F.coalesce(F.lag("cell_end").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0)))
    )
    cells = shares.select("source", "budget", F.expr("explode(if(cell_end > cell, sequence(cell, cell_end - 1), array(-1L)))").alias("cell"))
    # Slot i has the point that i's bits in reverse give: cell c = reverse(i), so i = reverse(c).  A source too small for a point comes last.
    reverse = F.reverse(F.lpad(F.bin("cell"), slot_bits, "0"))
    placed = cells.withColumn("slot", F.when(F.col("cell") < 0, F.lit(slots)).otherwise(F.conv(reverse, 2, 10).cast("long"))).withColumn("part", F.shiftright("slot", slot_bits - group_bits))
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part")
    bases = counts.withColumn("base", F.sum("n").over(before) - F.col("n")).withColumn("slots", F.sum("n").over(Window.partitionBy("source")))
    bases = bases.select(F.col("source").alias("source_"), F.col("part").alias("part_"), "base", "slots")
    ranked = (
        placed.withColumn("in_part", F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1)
        .join(bases, F.col("source").eqNullSafe(F.col("source_")) & (F.col("part") == F.col("part_")))
        .withColumn("rank", F.col("base") + F.col("in_part"))
        .withColumn("block", F.ceil(F.col("budget") / F.col("slots")))
    )
    to = F.least((F.col("rank") + 1) * F.col("block"), F.col("budget"))
    return ranked.select("source", "slot", "rank", "block", (F.col("rank") * F.col("block")).alias("from_word"), to.alias("to_word")).filter("to_word > from_word")


def positions(docs: DataFrame, per_source: DataFrame, *, buckets: int = 256) -> DataFrame:
    """Adds `start`, the document's first word on its source's line: sizes summed in the order of (key, doc_id, size).

    What `per_source` has of a source comes along with the sums of its buckets, so that documents are joined by
    source and bucket only and a large source spreads.
    """
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    hashed = docs.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    bases = sums.withColumn("base", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")).drop("bucket_size")
    bases = bases.join(per_source.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    bases = bases.withColumnRenamed("source", "source_").withColumnRenamed("bucket", "bucket_")
    inside = hashed.withColumn("within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    return (
        inside.join(bases, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
        .withColumn("start", F.col("base") + F.col("within"))
        .drop("source_", "bucket_", "base", "within", "bucket")
    )


def _laid_out(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, max_repeats: int, weights: tuple[int, ...], slot_bits: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Every document with its place on its source's line, and the pieces of the mix: row, slot, rank, offset, words."""
    prepare(docs.sparkSession)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
    )
    # Every row stands for itself, so that rows with equal ids stay apart; the count is per file split and stable on a rerun.
    narrow = settled(narrow.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, max_repeats=max_repeats, weights=weights)
    slots = settled(schedule(goals, slot_bits=slot_bits), "slots")
    lines = slots.groupBy("source").agg(F.first("block").alias("block"), F.max("to_word").alias("line"))
    per_source = goals.join(lines.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "left").select(
        "source", "source_size", "target", "block", F.coalesce("line", F.lit(0)).alias("line")
    )
    placed = positions(narrow, per_source, buckets=buckets)
    # The n-th time round, a document covers [start + n * source_size, + size) of its source's line, up to the line's end.
    rounds = F.expr(f"filter(sequence(0L, {max_repeats}L), n -> size > 0 and start + n * source_size < line)")
    touched = (
        placed.filter(F.col("size") > 0)
        .select("row", "source", "size", "start", "source_size", "block", "line", F.explode(rounds).alias("n"))
        .withColumn("a", F.col("start") + F.col("n") * F.col("source_size"))
        .withColumn("b", F.least(F.col("a") + F.col("size"), F.col("line")))
        .withColumn("rank", F.explode(F.expr("sequence(a div block, (b - 1) div block)")))
        .select("row", F.col("source").alias("of"), F.col("rank").alias("at"), "a", "b")
    )
    begin = F.greatest("a", "from_word")
    pieces = touched.join(slots, F.col("of").eqNullSafe(F.col("source")) & (F.col("at") == F.col("rank"))).select(
        "row", "slot", "rank", (begin - F.col("from_word")).alias("offset"), (begin - F.col("a")).alias("first_word"), (F.least("b", "to_word") - begin).alias("words")
    )
    return placed, pieces


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3), slot_bits: int = 16, buckets: int = 256) -> DataFrame:
    """id, size, source_size, target, taken of every document, in words, and first_slot, first_rank, first_offset of its first piece (null if none)."""
    placed, pieces = _laid_out(docs, id_col=id_col, text_col=text_col, source_col=source_col, max_repeats=max_repeats, weights=weights, slot_bits=slot_bits, buckets=buckets)
    taken = pieces.groupBy(F.col("row").alias("row_")).agg(F.sum("words").alias("taken"), F.min(F.struct("slot", "rank", "offset")).alias("first"))
    return placed.join(taken, F.col("row") == F.col("row_"), "left").select(
        F.col("doc_id").alias(id_col),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.col("first.slot").alias("first_slot"),
        F.col("first.rank").alias("first_rank"),
        F.col("first.offset").alias("first_offset"),
    )


def sequence(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3), slot_bits: int = 16, buckets: int = 256) -> DataFrame:
    """The mix itself, a row for each piece, in order of slot and offset: slot, offset, id, source, first_word (in the document), words.

    A document's piece is that many of its words from `first_word` on.
    """
    placed, pieces = _laid_out(docs, id_col=id_col, text_col=text_col, source_col=source_col, max_repeats=max_repeats, weights=weights, slot_bits=slot_bits, buckets=buckets)
    named = placed.select(F.col("row").alias("row_"), F.col("doc_id").alias(id_col), F.col("source").alias(source_col))
    return pieces.join(named, F.col("row") == F.col("row_")).select("slot", "offset", id_col, source_col, "first_word", "words").orderBy("slot", "offset")
