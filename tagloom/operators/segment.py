"""Hold-out split and the balanced training set of every tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import cleaning
from tagloom.operators.ranking import row_number_in_blocks
from tagloom.operators.sharding import task_count
from tagloom.operators.tags import question_tag

HOLDOUT_SHARE = 0.1
RANGE_ROWS = 2_048
TAGS_PER_DEAL = 32


def with_split(questions: DataFrame, share: float = HOLDOUT_SHARE) -> DataFrame:
    """WIN-2, AGG-14: the last ``floor(share * n)`` questions of each file are held out."""
    partitions = task_count(questions.sparkSession, questions.count())
    ranked = row_number_in_blocks(questions, ["src_file"], "pos", "_rn", total="_n", partitions=partitions)
    cut = F.col("_n") - F.floor(F.col("_n") * F.lit(share))
    split = F.when(F.col("_rn") <= cut, "train").otherwise("holdout")
    return ranked.withColumn("split", split).drop("_rn", "_n")


def indexed(split: DataFrame) -> DataFrame:
    return split.where(F.col("split") == "train").drop("split")


def holdout(split: DataFrame) -> DataFrame:
    return split.where(F.col("split") == "holdout").drop("split")


def holdout_rows(split: DataFrame) -> DataFrame:
    """SNK-3's rows: id, content, tags."""
    return holdout(split).select(
        "q_id", cleaning.content(F.col("title"), F.col("body")).alias("content"), "tags"
    )


def positives(bridge: DataFrame, tags: DataFrame) -> DataFrame:
    """FLT-7, JON-1: every (listed tag, question carrying it)."""
    return bridge.join(tags.select("tag"), "tag").select("tag", "q_id")


def negatives(questions: DataFrame, pos: DataFrame, max_neg: DataFrame | None = None) -> DataFrame:
    """FLT-8, JON-2, WIN-1, SET-5: per tag, the first k questions in id order without the tag,
    k being its number of positives.

    No question x tag product is formed: at most k questions are skipped before the k-th
    non-member, so these lie among the first 2k ids. Ids are ranked once; a tag meets
    only the rank ranges up to 2k (an equi-join on the range number). All tags reach the first ranges, so the tags of a
    range are dealt into deals of about ``TAGS_PER_DEAL``, and its ids are copied once per deal.
    """
    wanted = max_neg if max_neg is not None else pos.groupBy("tag").agg(F.count(F.lit(1)).alias("k"))
    ranked = row_number_in_blocks(questions.select("q_id"), [], "q_id", "q_rank").select(
        "q_id", "q_rank", F.expr(f"(q_rank - 1) div {RANGE_ROWS}").alias("_range")
    )
    reach = wanted.where("k > 0").select(
        "tag", "k",
        F.explode(F.sequence(F.lit(0), F.expr(f"cast((2 * k - 1) div {RANGE_ROWS} as int)"))).alias("_r"),
    ).select("tag", "k", F.col("_r").cast("bigint").alias("_range"))
    deals = reach.groupBy("_range").agg(F.ceil(F.count(F.lit(1)) / TAGS_PER_DEAL).alias("_deals"))
    dealt = reach.join(deals, "_range").select(
        "tag", "k", "_range", F.pmod(F.xxhash64("tag"), F.col("_deals")).alias("_deal")
    )
    copies = ranked.join(deals, "_range").withColumn(
        "_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_deals") - 1))
    ).drop("_deals")
    near = copies.join(dealt, ["_range", "_deal"]).where(F.col("q_rank") <= 2 * F.col("k"))
    free = near.join(pos, ["tag", "q_id"], "left_anti").select("tag", "q_id", "q_rank", "k")
    first = row_number_in_blocks(free, ["tag"], "q_rank", "_rn")
    return first.where(F.col("_rn") <= F.col("k")).select("tag", "q_id")


def training_pairs(questions: DataFrame, tags: DataFrame) -> DataFrame:
    """SET-2: positives and negatives of all tags, (tag, label, q_id)."""
    pos = positives(question_tag(questions), tags)
    neg = negatives(questions, pos)
    return pos.select("tag", F.lit(1).alias("label"), "q_id").unionByName(
        neg.select("tag", F.lit(0).alias("label"), "q_id")
    )


def training_rows(pairs: DataFrame, questions: DataFrame, append_label_text: bool = False) -> DataFrame:
    """SNK-4's rows: pairs with their text and label text.

    ``append_label_text`` reproduces the behaviour of the original readers, which made the
    label text part of the document (PRJ-16).
    """
    text = questions.select("q_id", cleaning.content(F.col("title"), F.col("body")).alias("content"))
    rows = pairs.join(text, "q_id").withColumn(
        "label_text", cleaning.label_text(F.col("tag"), F.col("label"))
    )
    if append_label_text:
        rows = rows.withColumn("content", F.concat_ws(" ", "content", "label_text"))
    return rows.select("tag", "label", "q_id", "content", "label_text")


def segment_counts(pairs: DataFrame) -> DataFrame:
    """AGG-13."""
    return pairs.groupBy("tag", "label").agg(F.count(F.lit(1)).alias("n_docs"))
