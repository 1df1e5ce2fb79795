"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in a seeded random order, form one stream that is cut into equal blocks (to a word)
of at most ``BLOCK`` words. A source wants as many slots as its blocks make up its target. Slot i of the mix has a golden-ratio point
in [0, 1), which falls into the interval of one source among the cumulative shares of slots; the slots of a source are ranked, and
rank r reads block r modulo the number of its blocks. So every source is spread evenly over the mix, is read from start
to end before it repeats, and no document is read more than ``REPEATS`` times. A source gets its slots but for a few,
of ``FINE`` or more in all but the smallest sources, so its words come near the target.

Scale: slots, blocks and documents are rows; ranks and stream positions come from counts per bounded
bucket plus a sort inside it; a source with a third of all rows has as many buckets as it needs.

Edge cases: a null source is a source of its own, last in order; null and empty texts have size 0 and are
never taken; repeated rows are separate documents (equal ids take equal positions by content hash); an empty
table gives an empty result; columns other than doc_id, text, source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import aside, n_words
from tagloom.operators.ranking import row_number_in_blocks
from tagloom.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Words of a block at most; smaller sources have smaller blocks, down to single words, so that they have some ``FINE`` of them.
BLOCK, FINE = 64, 4096
BUCKET_ROWS = 4096
CELLS = 1024
#: Golden-ratio points as exact integers: i * GOLDEN modulo 2^31; GOLDEN is odd and next to 2^31 * 0.618034.
GOLDEN, POINT_BITS = 1327217885, 31


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` with weight and target: shares of the weights, cut at ``REPEATS``
    times the size, the excess going to the others by weight.

    Sources in order of size / weight fill up first, so one sorted pass over the sources
    finds the level that the rest reach. The number of sources is that of a catalogue, not of rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    at = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (at % len(WEIGHTS) + 1).cast("int"))
    cap = REPEATS * F.col("source_size")
    filling = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", weight)
        .withColumn("_ratio", cap / F.col("weight"))
        .withColumn("_total", SHARE * F.sum("source_size").over(everything))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # full: even with all that is left, this source would pass its cap
        .withColumn("_level", F.greatest(F.col("_left"), F.lit(0.0)) / F.col("_weight"))
        .withColumn("_open", F.when(F.col("_level") < F.col("_ratio"), F.col("_level")))
        .withColumn("_final", F.first("_open", ignorenulls=True).over(
            filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("_final") * F.col("weight"), cap.cast("double"))))
        .select("source", "source_size", "weight", "target")
    )


def streams(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, n (rows of the source) and start: the first word's place in its source's stream."""
    rows = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")
    )
    rows = stage(rows)
    count = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    # the high 30 bits of the hash, in order, cut into equal ranges
    high = F.shiftright("h", 34) + F.lit(1 << 29)
    rows = (
        rows.withColumn("_s", F.struct("source"))
        .join(count.select(F.struct("source").alias("_s"), "n", "source_size"), "_s")
        .withColumn("_bucket", F.shiftright(high * buckets, 30))
        .repartition("_s", "_bucket")  # a layout by source alone would put a hot source into one task
    )
    inside = Window.partitionBy("_s", "_bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_s", "_bucket").agg(F.sum("size").alias("_size"))
        .select("_s", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    return (
        rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["_s", "_bucket"])
        .select("doc_id", "source", "size", "source_size", (F.col("_in") + F.col("_before")).alias("start"))
    )


def point(slot: Column) -> Column:
    span = 1 << POINT_BITS
    return ((slot % span) * GOLDEN) % span / F.lit(float(span))


def blocks(plan: DataFrame) -> DataFrame:
    """``plan`` with the equal blocks of each source: n_blocks, the words ``base`` of a block, one more in the first ``longer`` blocks,
    and ``slots``, the blocks that make up the target."""
    size = F.col("source_size")
    return (
        plan.withColumn("n_blocks", F.ceil(size / F.greatest(F.least(F.ceil(size / FINE), F.lit(BLOCK)), F.lit(1))))
        .withColumn("base", F.expr("source_size div nullif(n_blocks, 0)"))
        .withColumn("longer", size - F.col("base") * F.col("n_blocks"))
        .withColumn("slots", F.when(size > 0, F.col("target") * F.col("n_blocks") / size).otherwise(0.0))
    )


def schedule(plan: DataFrame) -> DataFrame:
    """(slot, source, rank): which source each slot of the mix reads, and the how-manieth of its slots it is."""
    spark = plan.sparkSession
    up_to = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    shares = (
        plan.withColumn("_high", F.sum("slots").over(up_to))
        .withColumn("_all", F.sum("slots").over(Window.partitionBy()))
        .where("slots > 0")
        .select("source", ((F.col("_high") - F.col("slots")) / F.col("_all")).alias("low"),
                (F.col("_high") / F.col("_all")).alias("high"))
    )
    slots = round(plan.agg(F.sum("slots")).first()[0] or 0)
    # an interval meets few of the equal cells, so points find it by an equality join
    first, last = F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    cells = shares.withColumn("cell", F.explode(F.sequence(first, last)))
    at = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("p"))
    placed = (
        at.withColumn("cell", F.floor(F.col("p") * CELLS)).join(cells, "cell")
        .where("p >= low AND p < high").select("slot", "source")
    )
    return row_number_in_blocks(placed, ["source"], "slot", "rank").withColumn("rank", F.col("rank") - 1)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of the document that the mix reads)."""
    rows = stage(streams(docs))
    plan = stage(blocks(targets(rows.groupBy("source").agg(F.max("source_size").alias("source_size")))))
    layout = plan.select(F.struct("source").alias("_s"), "n_blocks", "base", "longer")
    reads = (
        schedule(plan).withColumn("_s", F.struct("source"))
        .join(layout.select("_s", "n_blocks"), "_s")
        .where(F.col("rank") < REPEATS * F.col("n_blocks"))
        .groupBy("_s", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))
    )
    end = F.col("start") + F.col("size")
    pieces = (
        rows.where("size > 0").select("*", F.struct("source").alias("_s"), F.monotonically_increasing_id().alias("_row"))
    )
    pieces = stage(pieces)
    # the blocks of base + 1 words end at the word longer * (base + 1)
    of = "if({0} < longer * (base + 1), {0} div (base + 1), longer + ({0} - longer * (base + 1)) div base)"
    touched = pieces.join(layout, "_s").withColumn(
        "block", F.explode(F.sequence(F.expr(of.format("start")), F.expr(of.format("(start + size - 1)"))))
    )
    begin, after = (F.expr(f"{b} * base + least({b}, longer)") for b in ("block", "(block + 1)"))
    part = F.least(end, after) - F.greatest(F.col("start"), begin)
    taken = (
        touched.join(reads, ["_s", "block"])
        .groupBy("_row").agg(F.sum(part * F.col("times")).alias("taken"))
    )
    empty = rows.where("size = 0").select("doc_id", "source", "size", "source_size", F.lit(0).cast("long").alias("taken"))
    full = (
        pieces.join(taken, "_row", "left")
        .select("doc_id", "source", "size", "source_size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        .unionByName(empty)
        .withColumn("_s", F.struct("source"))
    )
    return full.join(plan.select(F.struct("source").alias("_s"), "target"), "_s").select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def repeat(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each repeated ``taken / size`` times, rounded; rows never taken go.

    Rows that share a doc_id share the mean of their takings.
    """
    return aside(docs, ("doc_id", "text", "source"), _repeat)


def _repeat(docs: DataFrame) -> DataFrame:
    times = F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int")
    copies = mix(docs).groupBy(F.struct("doc_id").alias("_id")).agg(times.alias("_times")).where("_times > 0")
    return (
        docs.withColumn("_id", F.struct("doc_id")).join(copies, "_id")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(*docs.columns)
    )
