from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagloom.functions import porter, stopwords
from tagloom.functions import text as X
from tagloom.operators import terms

STEMS = """
caresses caress ponies poni cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall
hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit
digitizer digit vietnamization vietnam feudalism feudal hopefulness hope sensibiliti sensibl
triplicate triplic formative form electrical electr goodness good revival reviv adjustment
adjust adoption adopt effective effect probate probat rate rate cease ceas controll control
roll roll because becaus this thi was wa does doe yes ye have have ies i by by
""".split()


def test_golden_stems(spark):
    want = dict(zip(STEMS[::2], STEMS[1::2]))
    df = spark.createDataFrame([(w,) for w in want], "term string")
    got = {r.term: r.stem for r in porter.with_stem(df, "term", "stem").collect()}
    assert got == want


def test_stem_filter_stays_above_the_steps(spark):
    df = spark.createDataFrame([("running",)], "term string")
    stems = porter.with_stem(df, "term", "stem").where(F.col("stem") != "x").groupBy("stem").count()
    assert rows(stems) == [("run", 1)]


def test_lengths_case_and_stopwords(spark):
    long, too_long = "a" * 100, "b" * 101
    text = f"ab Abc abc4def Don't THE straße {long} {too_long} naïve-café x"
    df = spark.createDataFrame([(1, text)], "q_id long, content string")
    want = ["abc", "abc", "def", "don", "straße", long, "naïve", "café"]
    got = df.select(X.term_array(F.col("content"), X.PLAIN).alias("t")).first().t
    assert got == want
    counts = {r.term: r.tf for r in terms.document_terms(df, X.PLAIN).collect()}
    assert counts == Counter(want)


def test_stem_profile_keeps_short_words_and_stems_before_stopping(spark):
    df = spark.createDataFrame([(1, "this t running runs")], "q_id long, content string")
    got = {r.term: r.tf for r in terms.document_terms(df, X.STEM).collect()}
    assert got == {"thi": 1, "t": 1, "run": 2}


def test_custom_stopwords(spark):
    df = spark.createDataFrame([(1, "spark the flink")], "q_id long, content string")
    own = X.PLAIN.with_stopwords(["Flink"])
    assert {r.term for r in terms.document_terms(df, own).collect()} == {"spark", "the"}


def test_custom_pattern_drops_digits_and_dots(spark):
    df = spark.createDataFrame([(1, "v1.2 alpha node.js beta")], "q_id long, content string")
    words = X.Profile("words", pattern=r"\S+", min_len=3)
    assert {r.term for r in terms.document_terms(df, words).collect()} == {"alpha", "beta"}


def test_long_letter_runs_leave_their_rest(spark):
    df = spark.createDataFrame([(1, "a" * 300 + " word")], "q_id long, content string")
    assert df.select(X.term_array(F.col("content"), X.PLAIN).alias("t")).first().t == ["a" * 45, "word"]


def test_apostrophe_words_of_a_list_stay(spark):
    assert X.PLAIN.with_stopwords(["Don't", "the"]).stopwords == ("don't", "the")
    assert len(set(stopwords.DEFAULT)) == len(stopwords.DEFAULT)


def test_vocabulary_with_one_hot_prefix(spark):
    pairs = [("t", f"pre{k:04d}") for k in range(3000)]
    got = rows(terms.vocabulary(spark.createDataFrame(pairs, "tag string, term string")))
    assert got == [("t", f"pre{k:04d}", k) for k in range(3000)]


@pytest.mark.parametrize("tag_terms, want", [
    ([("t", "bb"), ("t", "aab"), ("t", "aac"), ("t", "bb"), ("u", "z")],
     [("t", "aab", 0), ("t", "aac", 1), ("t", "bb", 2), ("u", "z", 0)]),
])
def test_vocabulary(spark, tag_terms, want):
    df = spark.createDataFrame(tag_terms, "tag string, term string")
    assert rows(terms.vocabulary(df)) == want
