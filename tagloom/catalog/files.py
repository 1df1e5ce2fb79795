"""Registered queries that go through files: the commands from a dump to recommendations, and the sources and sinks they do not use.

Each run has a folder of its own in the shared folder. The commands see the benchmark tables as a posts dump and a tag count file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.catalog import views as V
from tagloom.catalog.queries import embedding_assign, post_lines, r6
from tagloom.functions import cleaning
from tagloom.operators import clusters, segment
from tagloom.operators import tags as T
from tagloom.plans import commands
from tagloom.session import shared_dir
from tagloom.sources import readers, writers

MIN_COUNT = 9  # a listed tag is on more questions than this
UNLISTED = "src7"  # a tag that the count file does not know, so that its questions are left out
CLUSTERS, ROUNDS = 4, 3


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _tag_file(spark, d, root: str, tag: Column) -> str:
    counts = T.tag_counts(T.question_tag(V.questions(spark, d))).where(F.col("tag") != UNLISTED)
    counts.select(F.crc32(F.encode("tag", "UTF-8")).alias("tag_id"), tag.alias("tag"), "cnt").write.csv(f"{root}/counts")
    return f"{root}/counts"


def _indexed_root(spark, d, fmt: str = "parquet") -> str:
    """A root folder after the first three commands."""
    root = _folder(spark)
    commands.popular_tags(spark, root, _tag_file(spark, d, root, F.col("tag")), MIN_COUNT)
    post_lines(spark, d).write.text(f"{root}/posts")
    commands.clean_posts(spark, root, f"{root}/posts", fmt)
    commands.build_questions(spark, root, fmt)
    return root


def _trained_root(spark, d) -> str:
    root = _indexed_root(spark, d)
    commands.segment_tags(spark, root)
    return root


def tag_file_round_trip(spark, d):
    """SRC-1, SRC-2, SRC-3, SNK-1: the whitelist from a count file in upper case, as written and lower-cased, with the number of lines that the command reports."""
    root = _folder(spark)
    n = commands.popular_tags(spark, root, _tag_file(spark, d, root, F.upper("tag")), MIN_COUNT)
    written = readers.read_tags(spark, f"{root}/tags").select("tag")
    lower = readers.read_tags(spark, f"{root}/tags", lower=True).select("tag")
    return written.unionByName(lower).withColumn("n_written", F.lit(n).cast("long"))


def command_index(spark, d):
    """API-1 to API-3 over XML files of cleaned questions: what is indexed and what is held out."""
    root = _indexed_root(spark, d, "xml")
    columns = ["q_id", "content", cleaning.joined_tags(F.col("tags")).alias("tags")]
    index = spark.read.parquet(f"{root}/index/questions").select(*columns, F.lit("train").alias("split"))
    return index.unionByName(spark.read.parquet(f"{root}/holdout").select(*columns, F.lit("holdout").alias("split")))


def command_training_set(spark, d):
    """API-4: the training set as its reader returns it."""
    return readers.read_train(spark, f"{_trained_root(spark, d)}/train").select("tag", "label", "q_id")


def command_models(spark, d):
    """API-5: the stored models."""
    root = _trained_root(spark, d)
    commands.train_tag_models(spark, root)
    return readers.read_model(spark, f"{root}/models/weights").select("tag", "term", r6("w").alias("w"), r6("idf").alias("idf"))


def command_report(spark, d):
    """API-6: the accuracy report as its file holds it."""
    report = commands.evaluate_tag_models(spark, _trained_root(spark, d))
    return report.select(F.col("TagName").alias("tag"), r6("Accuracy").alias("accuracy"))


def command_recommend(spark, d):
    """API-7, SRT-2: the best ten of all listed tags, of which there are more than twenty, of the held-out questions."""
    root = _trained_root(spark, d)
    commands.train_tag_models(spark, root)
    questions = spark.read.parquet(f"{root}/holdout").select("q_id", "content")
    return commands.recommend(spark, root, questions).select("q_id", "rank", "tag", r6("score").alias("score"))


def _clustered_root(spark, d) -> str:
    root = _trained_root(spark, d)
    commands.cluster_questions(spark, root, CLUSTERS, max_iter=ROUNDS, runs=1)
    commands.cluster_tags(spark, root)
    return root


def command_clusters(spark, d):
    """API-8: the stored centroids, with the document frequencies stored beside them."""
    centroids, idf = readers.read_clusters(spark, f"{_clustered_root(spark, d)}/clusters")
    return centroids.join(idf, "term").select("cluster_id", "term", r6("v").alias("v"), "df")


def command_cluster_tags(spark, d):
    """API-9: the tags of each cluster as its reader returns them."""
    return readers.read_cluster_tags(spark, f"{_clustered_root(spark, d)}/cluster_tags").select("cluster_id", "tag")


def command_recommend_routed(spark, d):
    """API-10: the best five tags of the cluster of each held-out question; clusters have more tags than that."""
    root = _clustered_root(spark, d)
    commands.train_tag_models(spark, root)
    questions = spark.read.parquet(f"{root}/holdout").select("q_id", "content")
    return commands.recommend_routed(spark, root, questions).select(
        "q_id", "cluster_id", "rank", "tag", r6("score").alias("score")
    )


def question_xml_files(spark, d):
    """SRC-5, SRC-6, SNK-2: questions as XML files of at most 100 records, read again."""
    path = _folder(spark)
    q = V.questions(spark, d).select(
        "q_id", F.trim("title").alias("title"), F.trim(cleaning.clean_body(F.col("body"))).alias("body"), "tags",
        F.size("tags").alias("answer_count"), F.length("body").alias("view_count"),
    )
    writers.write_questions(q, path, "xml", max_records=100)
    return readers.read_question_xml(spark, path).select(
        F.col("q_id").cast("long").alias("q_id"), "title", "body", cleaning.joined_tags(F.col("tags")).alias("tags"),
        "answer_count", "view_count",
    )


def holdout_file(spark, d):
    """SNK-3: the held-out questions as tab-separated text, read again."""
    path = _folder(spark)
    writers.write_holdout(segment.holdout_rows(segment.with_split(V.questions(spark, d))), path, "tsv")
    return readers.read_holdout_tsv(spark, path).select("q_id", "content", cleaning.joined_tags(F.col("tags")).alias("tags"))


def cluster_assign_file(spark, d):
    """SRC-9, SNK-8, PRJ-18: nearest centroids as text lines, read again."""
    path = _folder(spark)
    writers.write_cluster_assign(embedding_assign(spark, d), path, "text")
    return readers.read_cluster_assign_text(spark, path).select("q_id", "cluster_id")


def cluster_tag_files(spark, d):
    """SRC-10, SNK-9: the tags of the documents that bear the numbers of a cluster's vectors."""
    path = _folder(spark)
    found = clusters.cluster_tags(embedding_assign(spark, d), T.question_tag(V.questions(spark, d)))
    writers.write_cluster_tags(found, path)
    return readers.read_cluster_tags(spark, path).select("cluster_id", "tag")


QUERIES = {
    f.__name__: f
    for f in (
        tag_file_round_trip, command_index, command_training_set, command_models, command_report, command_recommend,
        command_clusters, command_cluster_tags, command_recommend_routed, question_xml_files, holdout_file,
        cluster_assign_file, cluster_tag_files,
    )
}
