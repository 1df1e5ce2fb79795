"""Every registered query: (spark, sf_dir) -> DataFrame over the whole benchmark tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import schemas
from tagloom.catalog import views as V
from tagloom.functions import cleaning, porter
from tagloom.functions import text as X
from tagloom.operators import clusters, features, posts, scoring, segment, svm, terms
from tagloom.operators import tags as T
from tagloom.session import filed, shared_dir, stage
from tagloom.streaming import recommend as stream

CHUNK = 400  # records per chunk in `chunk_ids`, so that every scale has several chunks


def r6(c):
    return F.round(c, 6)


# --- tags and cleaning ------------------------------------------------------------------


def tag_popularity(spark: SparkSession, d: str) -> DataFrame:
    return V.popular(V.questions(spark, d)).select("tag", "cnt")


def popular_tag_total(spark, d):
    return V.popular(V.questions(spark, d)).agg(F.count(F.lit(1)).alias("n_tags"))


def clean_title(spark, d):
    return V.table(spark, d, "pages").select(
        "page_id", cleaning.flatten_record(cleaning.clean_title(F.col("html"))).alias("title")
    )


def clean_body(spark, d):
    return V.table(spark, d, "pages").select(
        "page_id", cleaning.flatten_record(cleaning.clean_body(F.col("html"))).alias("body")
    )


def parse_tags(spark, d):
    """Labelled documents give the raw form of a tag string, the others its escaped form."""
    docs = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    plain = F.concat(F.lit("<"), "lang", F.lit("><"), "source", F.lit("><"), "lang", F.lit(">"))
    escaped = F.concat(F.lit("&lt;"), "lang", F.lit("&gt;&lt;"), F.upper("source"), F.lit("&gt;"))
    raw = F.when(F.col("quality").isNotNull(), plain).otherwise(escaped)
    tags = cleaning.lower_tags(cleaning.split_tags(cleaning.tag_list(raw)))
    return docs.select(
        "doc_id", cleaning.tag_list(raw).alias("tag_list"), cleaning.joined_tags(tags).alias("tags")
    )


def _escape(c):
    """Text as an XML attribute value."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                        ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def post_lines(spark, d) -> DataFrame:
    """Documents and benchmark items as the lines of a posts dump: (value)."""
    q = V.questions(spark, d)
    tags = F.concat(F.lit("<"), F.array_join("tags", "><"), F.lit(">"))
    row = F.concat(
        F.lit('  <row Id="'), F.col("q_id").cast("string"), F.lit('" PostTypeId="1" Title="'),
        _escape(F.col("title")), F.lit('" Body="'), _escape(F.col("body")), F.lit('" Tags="'),
        _escape(tags), F.lit('" AnswerCount="'), F.size("tags").cast("string"),
        F.lit('" ViewCount="'), F.length("body").cast("string"), F.lit('" />'),
    )
    answers = V.table(spark, d, "benchmark").select(
        F.concat(F.lit('  <row Id="'), F.col("item_id").cast("string"),
                 F.lit('" PostTypeId="2" Body="'), _escape(F.col("text")), F.lit('" />')).alias("value")
    )
    return q.select(row.alias("value")).unionByName(answers)


def xml_posts_round_trip(spark, d):
    """The lines of a posts dump, parsed and cleaned again."""
    cleaned = posts.clean_posts(posts.parse_post_lines(post_lines(spark, d)))
    return cleaned.select(
        "q_id", "title", "body", cleaning.joined_tags(F.col("tags")).alias("tags"),
        "answer_count", "view_count",
    )


def whitelist_subset(spark, d):
    q = V.topic_questions(spark, d)
    return T.accepted_questions(q, V.popular(q, share=10)).select(
        "q_id", cleaning.joined_tags(F.col("tags")).alias("tags")
    )


# --- questions --------------------------------------------------------------------------


def question_content(spark, d):
    return V.with_content(V.questions(spark, d)).select(
        "q_id", "content", cleaning.joined_tags(F.col("tags")).alias("tags")
    )


def question_tag_bridge(spark, d):
    return T.question_tag(V.questions(spark, d))


def question_tag_wide(spark, d):
    return T.question_tag_wide(V.questions(spark, d), 5)


def chunk_ids(spark, d):
    return posts.with_chunk(V.questions(spark, d), CHUNK).select("q_id", "chunk_id")


def file_sizes(spark, d):
    split = segment.with_split(V.questions(spark, d))
    return split.groupBy("src_file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "holdout").alias("n_holdout")
    )


def holdout_split(spark, d):
    return segment.with_split(V.questions(spark, d)).select("q_id", "src_file", "split")


def holdout_rows(spark, d):
    return segment.holdout_rows(segment.with_split(V.questions(spark, d))).select(
        "q_id", "content", cleaning.joined_tags(F.col("tags")).alias("tags")
    )


def point_lookup(spark, d):
    ids = V.table(spark, d, "labels").select(F.col("doc_id").alias("q_id"))
    return T.lookup(V.questions(spark, d), ids).select("q_id", "title")


# --- segmentation -----------------------------------------------------------------------


def _indexed(spark, d) -> DataFrame:
    return segment.indexed(segment.with_split(V.questions(spark, d)))


def _index(spark, d) -> DataFrame:
    """Ids and tags of the indexed questions; the original wrote its index to disk here."""
    return stage(_indexed(spark, d).select("q_id", "tags"))


def _popular(spark, d) -> DataFrame:
    """The whitelist, another file of the original."""
    return stage(V.popular(V.questions(spark, d)))


def _holdout(spark, d) -> DataFrame:
    """The held-out questions, a file of the original too."""
    return stage(segment.holdout_rows(segment.with_split(V.questions(spark, d))))


def _pairs(spark, d) -> DataFrame:
    """The training set, written to files by the original as well."""
    return stage(segment.training_pairs(_index(spark, d), _popular(spark, d)))


def positives(spark, d):
    return segment.positives(T.question_tag(_indexed(spark, d)), V.popular(V.questions(spark, d)))


def negatives(spark, d):
    index = _index(spark, d)
    return segment.negatives(index, segment.positives(T.question_tag(index), _popular(spark, d)))


def segment_counts(spark, d):
    return segment.segment_counts(segment.training_pairs(_index(spark, d), _popular(spark, d)))


def training_rows(spark, d):
    pairs = segment.training_pairs(_index(spark, d), _popular(spark, d))
    return segment.training_rows(pairs, V.questions(spark, d))


def training_rows_with_label_text(spark, d):
    pairs = segment.training_pairs(_index(spark, d), _popular(spark, d))
    return segment.training_rows(pairs, V.questions(spark, d), append_label_text=True)


# --- text -------------------------------------------------------------------------------


def tokens_plain(spark, d):
    q = V.with_content(V.questions(spark, d))
    t = X.term_array(F.col("content"), X.PLAIN)
    return q.select("q_id", F.size(t).alias("n_terms"), F.array_join(t, " ").alias("terms"))


def tokens_stem(spark, d):
    """The stem of every distinct word of the corpus."""
    q = V.with_content(V.questions(spark, d))
    words = q.select(F.explode(X.raw_tokens(F.col("content"), X.STEM)).alias("term")).distinct()
    return porter.with_stem(words, "term", "stem").select("term", "stem")


def term_counts_plain(spark, d):
    return terms.document_terms(V.with_content(V.questions(spark, d)), X.PLAIN)


def postings(spark, d):
    """The index holds the questions that are not held out, analysed with stemming."""
    return terms.postings(terms.document_terms(V.with_content(_indexed(spark, d)), X.STEM))


# --- features ---------------------------------------------------------------------------


def _documents(spark, d, profile: X.Profile) -> DataFrame:
    return terms.repeated(terms.compact_terms(V.contents(spark, d), profile), V.repeats(spark, d))


def _weighted(spark, d) -> features.Weighted:
    return features.weigh(_pairs(spark, d), _documents(spark, d, X.PLAIN))


def _sharded_terms(spark, d) -> DataFrame:
    plain = terms.document_terms(V.with_content(V.questions(spark, d)), X.PLAIN)
    return features.tag_terms(features.in_shards(_pairs(spark, d)), plain)


def vocabulary(spark, d):
    return terms.vocabulary(_sharded_terms(spark, d))


def doc_frequency(spark, d):
    return features.document_frequency(features.shard_frequency(_sharded_terms(spark, d)))


def idf(spark, d):
    return _weighted(spark, d).idf.select("tag", "term", "df", r6("idf").alias("idf"))


def tfidf_per_tag(spark, d):
    return _weighted(spark, d).features.select("tag", "q_id", "term", r6("x").alias("x"))


def _corpus(spark, d) -> features.Weighted:
    """Clustering sees each question with a popular tag once, stemmed."""
    members = stage(features.corpus_pairs(positives(spark, d)))
    return features.weigh(members, _documents(spark, d, X.STEM), docs_per_shard=clusters.DOCS_PER_SHARD)


def tfidf_global(spark, d):
    return _corpus(spark, d).features.select("q_id", "term", r6("x").alias("x"))


# --- classifiers ------------------------------------------------------------------------


def _model(spark, d) -> DataFrame:
    w = _weighted(spark, d)
    return filed(svm.model_table(svm.train(w, last=True), w.idf))


def svm_weights(spark, d):
    return svm.train(_weighted(spark, d), last=True).select("tag", "term", r6("w").alias("w"))


def svm_margins(spark, d):
    w = _weighted(spark, d)
    return svm.margins(w, svm.train(w)).select("tag", "q_id", "label", r6("margin").alias("margin"))


def recommend_top10(spark, d):
    return scoring.recommend(_holdout(spark, d), _model(spark, d)).select(
        "q_id", "rank", "tag", r6("score").alias("score")
    )


def split_80_20(spark, d):
    return V.questions(spark, d).select("q_id", svm.in_train_split().alias("in_train"))


def accuracy_report(spark, d):
    return svm.evaluate(_weighted(spark, d)).select(
        "tag", r6("accuracy").alias("accuracy"), "n_test"
    )


# --- clusters ---------------------------------------------------------------------------


def _label_centroids(spark, d):
    """First centroids of the embeddings: the mean vector of each label."""
    e = V.table(spark, d, "embeddings")
    rows = clusters.dense_rows(e, "vec_id", "embedding")
    groups = e.select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("q_id"))
    return rows, e.select(F.col("vec_id").alias("q_id")), clusters.mean_vectors(rows, groups)


def embedding_assign(spark, d):
    rows, ids, centroids = _label_centroids(spark, d)
    return clusters.assign(rows, ids, centroids).select("q_id", "cluster_id")


def embedding_lloyd_step(spark, d):
    return clusters.lloyd_step(*_label_centroids(spark, d)).select(
        "cluster_id", F.col("term").alias("dim"), r6("v").alias("v")
    )


def kmeans_fit(spark, d):
    """Sizes of the clusters of a whole fit to the texts: the cheapest of three starts, each until its centroids rest."""
    w = _corpus(spark, d)
    packed = features.compact_vectors(w).persist()
    centroids = clusters.fit(packed, w.members, k=6)
    return clusters.cluster_sizes(clusters.assign(packed, w.members, centroids))


def kmeans_start(spark, d):
    """The first centroids that oversampling finds."""
    w = _corpus(spark, d)
    packed = features.compact_vectors(w).persist()
    return clusters.seeds(packed, w.members, 6, 1).select("cluster_id", "term", r6("v").alias("v"))


def _text_centroids(spark, d, packed: DataFrame) -> DataFrame:
    """First centroids of the texts: the mean vector of each popular tag's questions."""
    pos = positives(spark, d)
    numbered = scoring.number_tags(pos.select("tag").distinct())
    groups = pos.join(numbered, "tag").select((F.col("tag_no") - 1).alias("cluster_id"), "q_id")
    return stage(clusters.mean_vectors(packed, groups))


def _clustered(spark, d):
    corpus = _corpus(spark, d)
    packed = features.compact_vectors(corpus).persist()
    packed.count()  # where it lies is known only once it is there
    centroids = _text_centroids(spark, d, packed)
    placed = stage(clusters.assign(packed, corpus.members, centroids))
    packed.unpersist()
    return corpus, centroids, placed


def kmeans_assign(spark, d):
    return _clustered(spark, d)[2].select("q_id", "cluster_id")


def lloyd_step(spark, d):
    corpus = _corpus(spark, d)
    packed = features.compact_vectors(corpus).persist()
    packed.count()
    centroids = _text_centroids(spark, d, packed)
    return clusters.lloyd_step(packed, corpus.members, centroids).select(
        "cluster_id", "term", r6("v").alias("v")
    )


def cluster_members(spark, d):
    return clusters.cluster_sizes(_clustered(spark, d)[2])


def cluster_tag_set(spark, d):
    return clusters.cluster_tags(_clustered(spark, d)[2], T.question_tag(_index(spark, d)))


def recommend_routed_top5(spark, d):
    corpus, centroids, placed = _clustered(spark, d)
    tags = stage(clusters.cluster_tags(placed, T.question_tag(_index(spark, d))))
    return scoring.recommend_routed(
        _holdout(spark, d), _model(spark, d), centroids, corpus.idf, tags
    ).select("q_id", "cluster_id", "rank", "tag", r6("score").alias("score"))


def stream_recommend(spark, d):
    """The held-out questions as a stream of files, scored batch by batch."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    model = _model(spark, d)
    _holdout(spark, d).select("q_id", "content").write.parquet(f"{base}/in")
    stream.start(
        stream.question_stream(spark, f"{base}/in"),
        lambda batch: scoring.recommend(batch, model),
        f"{base}/out", f"{base}/progress", available_now=True,
    ).awaitTermination()
    scored = spark.read.schema(schemas.RECOMMENDATION).parquet(f"{base}/out")
    return scored.select("q_id", "rank", "tag", r6("score").alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        tag_popularity, popular_tag_total, clean_title, clean_body, parse_tags,
        xml_posts_round_trip, whitelist_subset, question_content, question_tag_bridge,
        question_tag_wide, chunk_ids, file_sizes, holdout_split, holdout_rows, point_lookup,
        positives, negatives, segment_counts, training_rows, training_rows_with_label_text,
        tokens_plain, tokens_stem, term_counts_plain, postings, vocabulary, doc_frequency, idf,
        tfidf_per_tag, tfidf_global, svm_weights, svm_margins, recommend_top10, split_80_20,
        accuracy_report, embedding_assign, embedding_lloyd_step, kmeans_assign, lloyd_step,
        cluster_members, cluster_tag_set, recommend_routed_top5, kmeans_start, kmeans_fit, stream_recommend,
    )
}
