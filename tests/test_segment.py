import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.operators import segment
from tagloom.operators import tags as T
from tagloom.operators.ranking import row_number_in_blocks, top_k


def test_popular_is_strict(spark):
    counts = spark.createDataFrame([("a", 2000), ("b", 2001)], "tag string, cnt long")
    assert rows(T.popular_tags(counts).select("tag")) == [("b",)]


def test_accepted_questions(spark):
    q = spark.createDataFrame(
        [(1, ["a", "b"]), (2, ["a", "x"]), (3, []), (4, ["x"]), (5, ["b"])], "q_id long, tags array<string>"
    )
    tags = spark.createDataFrame([("a",), ("b",)], "tag string")
    assert rows(T.accepted_questions(q, tags).select("q_id")) == [(1,), (3,), (5,)]


def test_bridge_lowers_and_wide(spark):
    q = spark.createDataFrame([(1, ["Java", "java", "C#"])], "q_id long, tags array<string>")
    assert rows(T.question_tag(q)) == [(1, "c#"), (1, "java")]
    assert rows(T.question_tag_wide(q, 5)) == [(1, "c#", "java", None, None, None)]
    assert rows(T.question_tag_wide(q)) == [(1, "c#", "java")]
    with pytest.raises(Exception, match="more than 1 tags"):
        T.question_tag_wide(q, 1).collect()


def test_negatives_of_many_tags_over_the_same_ids(spark):
    tags = [f"t{k:03d}" for k in range(300)]
    q = spark.createDataFrame([(i, [tags[i % 300]]) for i in range(900)], "q_id long, tags array<string>")
    pos = T.question_tag(q).select("tag", "q_id")
    got = defaultdict(list)
    for r in segment.negatives(q, pos).collect():
        got[r.tag].append(r.q_id)
    for k, tag in enumerate(tags):
        assert sorted(got[tag]) == [i for i in range(900) if i % 300 != k][:3]


def test_lookup(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "q_id long, title string")
    ids = spark.createDataFrame([(2,), (2,), (9,)], "q_id long")
    assert rows(T.lookup(q, ids)) == [(2, "b")]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_row_numbers_equal_a_window(spark, block):
    rng = random.Random(block)
    data = [(g, o) for g in ("a", "b", None) for o in rng.sample(range(-50, 50), 20)]
    df = spark.createDataFrame(data, "g string, o long")
    w = Window.partitionBy("g").orderBy("o")
    want = df.select("g", "o", F.row_number().over(w), F.count("*").over(Window.partitionBy("g")))
    got = row_number_in_blocks(df, ["g"], "o", "rn", total="n", block_rows=block)
    assert rows(got.select("g", "o", "rn", "n")) == rows(want)


@pytest.mark.parametrize("n, held", [(9, 0), (10, 1), (19, 1), (20, 2), (30, 3)])
def test_holdout_size(spark, n, held):
    q = spark.range(n).select(F.col("id").alias("q_id"), F.lit("f").alias("src_file"), F.col("id").alias("pos"))
    split = segment.with_split(q)
    assert rows(segment.holdout(split).select("q_id")) == [(i,) for i in range(n - held, n)]
    assert segment.indexed(split).count() == n - held


@pytest.mark.parametrize("seed", [1, 2])
def test_training_pairs_against_brute_force(spark, seed, monkeypatch):
    """One tag is on two thirds of all questions: fewer negatives than asked for."""
    monkeypatch.setattr(segment, "RANGE_ROWS", 4)
    rng = random.Random(seed)
    ids = rng.sample(range(1000), 60)
    tags = {i: [t for t, p in (("hot", 0.67), ("mid", 0.3), ("rare", 0.05)) if rng.random() < p] for i in ids}
    q = spark.createDataFrame(list(tags.items()), "q_id long, tags array<string>")
    listed = spark.createDataFrame([("hot",), ("mid",), ("rare",), ("absent",)], "tag string")
    want = []
    for tag in ("hot", "mid", "rare"):
        pos = [i for i in sorted(ids) if tag in tags[i]]
        neg = [i for i in sorted(ids) if tag not in tags[i]][: len(pos)]
        want += [(tag, 1, i) for i in pos] + [(tag, 0, i) for i in neg]
    assert rows(segment.training_pairs(q, listed)) == sorted(want, key=repr)
    counts = defaultdict(int)
    for tag, label, _ in want:
        counts[tag, label] += 1
    got = segment.segment_counts(segment.training_pairs(q, listed))
    assert {(t, l): n for t, l, n in rows(got)} == dict(counts)


def test_label_text_can_join_the_content(spark):
    pairs = spark.createDataFrame([("a", 0, 1)], "tag string, label int, q_id long")
    q = spark.createDataFrame([(1, "t", "b")], "q_id long, title string, body string")
    assert rows(segment.training_rows(pairs, q)) == [("a", 0, 1, "t b", "NOT_a")]
    assert rows(segment.training_rows(pairs, q, True)) == [("a", 0, 1, "t b NOT_a", "NOT_a")]


def test_top_k(spark):
    df = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("q", "c", -1.0), ("q", "d", 0.0)], "q string, tag string, score double")
    got = top_k(df, ["q"], [F.desc("score"), F.asc("tag")], 3).orderBy("rank").collect()
    assert [r.tag for r in got] == ["a", "b", "d"]
