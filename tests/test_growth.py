"""More documents give more tasks, not larger ones."""

import pytest
from pyspark.sql import functions as F

from tagloom.functions.text import PLAIN, STEM
from tagloom.operators import clusters, features, scoring, segment, svm, terms
from tagloom.operators.sharding import DOCS_PER_TASK
from tagloom.session import shuffle_partitions


def test_term_rows_and_texts_are_dealt_by_the_number_of_documents(spark):
    want = shuffle_partitions(spark) + 2
    q = spark.range(want * DOCS_PER_TASK).select(
        F.col("id").alias("q_id"), F.col("id").alias("pos"), F.lit("some words").alias("content"), F.lit("f").alias("src_file")
    )
    counted = terms.document_terms(q)
    assert counted.rdd.getNumPartitions() == want
    pairs = q.select(F.lit("t").alias("tag"), F.lit(1).alias("label"), "q_id")
    weighted = features.weigh(pairs, counted)
    assert weighted.partitions == want and weighted.features.rdd.getNumPartitions() == want
    assert segment.with_split(q).rdd.getNumPartitions() == want
    weighted.release()


def test_svm_in_rounds_equals_in_task_with_repeated_documents(spark):
    pairs = [("a", q % 2, q) for q in range(12)] + [("a", 1, 1), ("a", 0, 2), ("b", 1, 3), ("b", 0, 4)]
    counts = [(q, f"w{(q * q + k) % 5}", 1 + k) for q in range(12) for k in range(3)]
    w = features.weigh(
        spark.createDataFrame(pairs, "tag string, label int, q_id long"),
        spark.createDataFrame(counts, "q_id long, term string, tf long").groupBy("q_id", "term").agg(F.sum("tf").alias("tf")),
        min_df=1, docs_per_shard=3,
    )
    in_task = {(r.tag, r.term): r.w for r in svm.train(w).collect()}
    spread = {(r.tag, r.term): r.w for r in svm.train(w, entries_per_task=0).collect()}
    assert in_task.keys() == spread.keys() and any(in_task.values())
    assert all(spread[k] == pytest.approx(v, abs=1e-9) for k, v in in_task.items())


def test_training_moves_one_row_per_member_and_trains_over_several_units(spark):
    pairs = [("a", q % 2, q) for q in range(40)] + [("a", 1, 1)]
    counts = [(q, f"w{(q * q + k) % 7}", 1 + k) for q in range(40) for k in range(4)]
    w = features.weigh(
        spark.createDataFrame(pairs, "tag string, label int, q_id long"),
        spark.createDataFrame(counts, "q_id long, term string, tf long"), min_df=1, docs_per_shard=2,
    )
    assert w.documents.count() == len(pairs)
    assert w.documents.select(F.expr(f"shard div {svm.SHARDS_PER_UNIT}")).distinct().count() > 1
    assert w.features.count() == len(pairs) * 4
    spread = svm.train(w, entries_per_task=0)
    weights = {r.term: r.w for r in spread.collect()}
    in_task = {r.term: r.w for r in svm.train(w).collect()}
    assert weights == pytest.approx(in_task, abs=1e-9) and any(weights.values())
    want = {}
    for r in w.features.collect():
        want[r.q_id] = want.get(r.q_id, 0.0) + r.x * weights[r.term]
    got = svm.margins(w, spread).collect()
    assert len(got) == len(pairs)
    assert all(r.margin == pytest.approx(want[r.q_id], abs=1e-9) for r in got)
    w.release()


def test_kmeans_places_the_terms_of_its_shards_once(spark, monkeypatch):
    rows = [("*", q % 3, q, f"w{q % 2}{k}", 1.0 + k) for q in range(12) for k in range(2)]
    feats = spark.createDataFrame(rows, "tag string, shard int, q_id long, term string, x double")
    docs, calls, held = spark.range(12).withColumnRenamed("id", "q_id"), [], clusters.held_terms
    monkeypatch.setattr(clusters, "held_terms", lambda packed: calls.append(1) or held(packed))
    packed = clusters.pack(feats).persist()
    centroids = clusters.fit(packed, docs, 2, max_iter=2, runs=1)
    assert calls == [1]
    assert packed.is_cached  # the caller's to release
    found = {r.q_id: r.cluster_id for r in clusters.assign(packed, docs, centroids).collect()}
    assert all(found[q] == found[q % 2] for q in found) and len(set(found.values())) == 2
    packed.unpersist()


def test_packed_vectors_equal_the_term_rows_without_sorting_these(spark):
    pairs = spark.createDataFrame([("*", q) for q in range(30)] + [("*", 99)], "tag string, q_id long")
    counts = [(q, f"w{(q * q + k) % 7}", 1 + k) for q in range(30) for k in range(4)] + [(0, "rare", 1), (99, "rare", 2)]
    w = features.weigh(pairs, spark.createDataFrame(counts, "q_id long, term string, tf long"), min_df=3, docs_per_shard=4)
    packed = features.vectors(w)
    assert packed.rdd.getNumPartitions() == w.partitions
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "CollectList" not in plan
    got = {(r.tag, r.shard, r.q_id, t): x for r in packed.collect() for t, x in zip(r.terms, r.xs, strict=True)}
    want = {(r.tag, r.shard, r.q_id, r.term): r.x for r in w.features.collect()}
    assert want and got == pytest.approx(want, abs=1e-12)
    assert all(r.terms for r in packed.collect())  # a document without kept terms has no row
    # means of groups that overlap, name a document twice, or know no cluster
    groups = spark.createDataFrame(
        [(q % 3, q) for q in range(30)] + [(1, 0), (1, 0), (2, 99), (None, 4)], "cluster_id int, q_id long"
    )
    means = [
        {(r.cluster_id, r.term): r.v for r in clusters.mean_vectors(f, groups).collect()} for f in (packed, w.features)
    ]
    assert means[0] == pytest.approx(means[1], abs=1e-12)
    w.release()


def test_packed_terms_are_the_counted_words_and_no_word_is_a_row(spark):
    docs = spark.createDataFrame(
        [(1, "Red red fox of Über-Straße x9y"), (2, None), (3, ""), (4, "of a"), (5, "red"), (5, "Fox red"), (None, "lost word")],
        "q_id long, content string",
    )
    for profile in (PLAIN, STEM):
        packed = terms.packed_terms(docs, profile)
        got = sorted((str(r.q_id), t, n) for r in packed.collect() for t, n in zip(r.terms, r.tfs, strict=True))
        assert got == sorted((str(r.q_id), r.term, r.tf) for r in terms.document_terms(docs, profile).collect())
        assert all(r.terms for r in packed.collect())
    plain = terms.packed_terms(docs)
    assert "Generate" not in plain._jdf.queryExecution().optimizedPlan().toString()
    pairs = spark.createDataFrame([("a", 1, 1), ("a", 0, 5), ("a", 0, 2)], "tag string, label int, q_id long")
    both = [features.weigh(pairs, t, min_df=1) for t in (plain, terms.document_terms(docs))]
    x = [{(r.q_id, r.term): r.x for r in w.features.collect()} for w in both]
    assert x[0] and x[0] == pytest.approx(x[1], abs=1e-12)
    for w in both:
        w.release()


def test_vectors_of_unseen_questions_are_made_once_and_released(spark, monkeypatch):
    q = spark.createDataFrame([(1, "red red fox"), (2, "blue"), (3, "nothing known"), (4, None)], "q_id long, content string")
    centroids = spark.createDataFrame([(0, "red", 2.0), (1, "blue", 1.0)], "cluster_id int, term string, v double")
    idf = spark.createDataFrame([("red", 2.0), ("blue", 2.0)], "term string, idf double")
    plans, stage = [], scoring.stage
    monkeypatch.setattr(scoring, "stage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    placed = scoring.place_unseen(q, centroids, idf, PLAIN)
    assert len(plans) == 1 and "InMemoryRelation" in plans[0]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    assert {r.q_id: r.cluster_id for r in placed.collect()} == {1: 0, 2: 1, 3: 1, 4: 1}


def test_compressed_documents_and_numbers_come_back():
    import numpy as np
    import pyarrow as pa

    words = pa.array(["red", "straße", "", "fox", "red"])
    packed = terms.encoded(np.array([2, 0, 3]), words, [np.array([1, 2, 3, 70_000, 5]), np.arange(5)], 9)
    sizes, found, numbers, total = terms.decoded(pa.chunked_array([packed]), 2)
    assert sizes.tolist() == [2, 0, 3] and found.to_pylist() == words.to_pylist() and total.tolist() == [9, 9, 9]
    assert [n.tolist() for n in numbers] == [[1, 2, 3, 70_000, 5], [0, 1, 2, 3, 4]]
    for kind in (np.int32, np.int64, np.float64):
        values = np.array([3, 0, 70_000, -2], kind)
        assert terms.array_of(terms.squeezed(values), kind).tolist() == values.tolist()
    hashes = terms.term_hashes(pa.array(["x", "red", "der", "red", ""]).slice(1))
    assert hashes[0] == hashes[2] and len(set(hashes.tolist())) == 3
    assert terms.array_of(terms.squeezed(np.zeros(0)), np.float64).tolist() == []


def test_rare_terms_are_dropped_before_a_document_is_copied_to_its_tags(spark):
    """F3 to F20: copies of whole texts' words filled the disks."""
    counts = [(q, t, 1 + q) for q in range(6) for t in ("all", f"own{q}", "half" if q % 2 else "rest")]
    docs = terms.compact(spark.createDataFrame(counts, "q_id long, term string, tf long"))
    kept = terms.without_rare(docs, 4).mapInArrow(terms._unpacked, "q_id long, terms array<string>, tfs array<bigint>")
    assert sorted((r.q_id, r.terms, r.tfs) for r in kept.collect()) == [(q, ["all"], [1 + q]) for q in range(6)]
    assert terms.without_rare(docs, 1) is docs
    # a member that occurs twice counts twice: three documents are six
    pairs = spark.createDataFrame([("a", q % 2, q) for q in range(6)] * 2, "tag string, label int, q_id long")
    w = features.weigh(pairs, docs)
    assert {r.term: r.df for r in w.idf.collect()} == {"all": 12, "half": 6, "rest": 6}
    held = w.documents.select("doc").collect()
    assert len(held) == 12 and max(len(r.doc) for r in held) < 120
    w.release()


def test_texts_are_counted_where_they_are_read(spark, tmp_path):
    """a text was shuffled to meet labels that are no part of it, and again to be counted."""
    from tagloom.catalog import queries as Q
    from tagloom.catalog import views as V

    rows = [(q, f"title {q % 3}\nred fox in snow", "en", "s", 9) for q in range(8)] + [(3, "title\nblue sea", "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (3, 1, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for profile in (PLAIN, STEM):
        got = Q._documents(spark, str(tmp_path), profile)
        kept = got.mapInArrow(terms._unpacked, "q_id long, terms array<string>, tfs array<bigint>").collect()
        want = terms.document_terms(V.with_content(V.questions(spark, str(tmp_path))), profile).collect()
        assert sorted((r.q_id, t, n) for r in kept for t, n in zip(r.terms, r.tfs, strict=True)) == sorted(map(tuple, want))
    plan = terms.compact_terms(V.contents(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and not any("text" in part or "content" in part for part in plan.split("Exchange")[0].splitlines())


def test_training_gives_the_same_weights_when_documents_are_released(spark):
    pairs = spark.createDataFrame([("a", q % 2, q) for q in range(20)], "tag string, label int, q_id long")
    counts = spark.createDataFrame([(q, f"w{(q * q + k) % 7}", 1 + k) for q in range(20) for k in range(4)], "q_id long, term string, tf long")
    w = features.weigh(pairs, counts, min_df=1, docs_per_shard=6)
    kept = {r.term: r.w for r in svm.train(w).collect()}
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert {r.term: r.w for r in svm.train(w, last=True).collect()} == kept and any(kept.values())
    assert spark.sparkContext._jsc.getPersistentRDDs().size() < held
