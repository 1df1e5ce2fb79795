"""Tags: popularity, whitelist, the question-tag bridge and the subset test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import cleaning


def question_tag(questions: DataFrame) -> DataFrame:
    """PRJ-12, PRJ-13, SNK-5: one row per (question, lower-cased tag)."""
    return questions.select("q_id", F.explode(cleaning.lower_tags("tags")).alias("tag"))


def question_tag_wide(questions: DataFrame, width: int | None = None) -> DataFrame:
    """PRJ-13: the tags as columns, in tag order; a row projection, no pivot. Without ``width`` there are as many columns
    as the question with most tags needs; a width that would drop a tag fails."""
    if width is None:
        width = max(1, questions.agg(F.max(F.size(cleaning.lower_tags("tags")))).first()[0] or 1)
    tags = F.array_sort(cleaning.lower_tags("tags"))
    tags = F.when(F.size(tags) <= width, tags).when(F.size(tags) > width, F.raise_error(F.lit(f"more than {width} tags")))
    return questions.select(
        "q_id", *[F.get(tags, F.lit(i)).alias(f"q_tag_{i + 1}") for i in range(width)]
    )


def tag_counts(bridge: DataFrame) -> DataFrame:
    """AGG-2: popularity per tag, pre-aggregated before the shuffle."""
    return bridge.groupBy("tag").agg(F.count(F.lit(1)).alias("cnt"))


def popular_tags(counts: DataFrame, min_count: int | Column = 2000) -> DataFrame:
    """FLT-1: strictly more than ``min_count``."""
    return counts.where(F.col("cnt") > min_count)


def share_of(questions: DataFrame, share: int) -> Column:
    """A popularity threshold relative to the corpus: one question in ``share``."""
    return questions.agg(F.count(F.lit(1)) / F.lit(share)).scalar()


def accepted_questions(questions: DataFrame, tags: DataFrame) -> DataFrame:
    """FLT-4, JON-4, SET-4: questions all of whose tags are listed; no tags at all passes.

    Tags are compared as stored. The distinct tags of the corpus are matched first, so the
    list of *foreign* tags is what meets the bridge; a hot listed tag never becomes a join key
    with matches. Both joins are semi/anti joins that AQE can split or broadcast by real size.
    """
    bridge = questions.select("q_id", F.explode("tags").alias("tag"))
    foreign = bridge.select("tag").distinct().join(tags.select("tag"), "tag", "left_anti")
    offending = bridge.join(foreign, "tag", "left_semi").select("q_id").distinct()
    return questions.join(offending, "q_id", "left_anti")


def lookup(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """FLT-9, JON-3, SRT-5: fetch questions by id, all ids in one join; unknown ids drop out."""
    return questions.join(ids.select("q_id").distinct(), "q_id", "left_semi")
