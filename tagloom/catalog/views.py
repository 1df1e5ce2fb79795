"""Stand-in views: the benchmark tables seen as a question corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import cleaning
from tagloom.operators import tags as T

POPULAR_SHARE = 20  # a popular tag is on more than one question in 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a question: first line = title, rest = body; language, source and
    labels are its tags; its source is the file it came from."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    title = F.substring_index("text", "\n", 1)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("q_id"),
        title.alias("title"),
        F.substring(F.col("text"), F.length(title) + 2, F.length("text")).alias("body"),
        F.array_compact(
            F.array(
                "lang", "source",
                F.when(F.col("quality") == 1, "quality"),
                F.when(F.col("toxic") == 1, "toxic"),
            )
        ).alias("tags"),
        F.col("source").alias("src_file"),
        F.col("doc_id").alias("pos"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and content of the questions, without the labels, which are no part of a text: no text meets them in a join."""
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("q_id"),
        cleaning.content(title, F.substring(F.col("text"), F.length(title) + 2, F.length("text"))).alias("content"),
    )


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, n): ids that are labelled more than once, whose question so occurs ``n`` times among ``questions``."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("q_id")).agg(F.count(F.lit(1)).alias("n"))
    return labels.where("n > 1 AND q_id IS NOT NULL")


def topic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions without the source among their tags."""
    return questions(spark, sf_dir).withColumn("tags", F.array_remove("tags", F.col("src_file")))


def with_content(q: DataFrame) -> DataFrame:
    return q.withColumn("content", cleaning.content(F.col("title"), F.col("body")))


def popular(q: DataFrame, share: int = POPULAR_SHARE) -> DataFrame:
    return T.popular_tags(T.tag_counts(T.question_tag(q)), T.share_of(q, share))
