import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagloom.functions import cleaning
from tagloom.operators import posts


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("raw, clean", [
    ("a <h1> b", "a <h1> b"),
    ('x <a href="u">y</a>', 'x <a href="u">y '),
    ("a <b> c</b> <>", "a   c   "),
])
def test_title(spark, raw, clean):
    assert one(spark, cleaning.clean_title, raw) == clean


@pytest.mark.parametrize("raw, clean", [
    ("<p>one\ntwo</p>\r\n<p>three</p>", "onetwothree"),
    ("if a < b and c > d then", "if a  d then"),
    ("<code>List&lt;String&gt; x;</code>", "ListString x;"),
    ('<a href="u?a=1&b=2">k</a>', '<a href="u?a=1&b=2">k'),
    ("&lt;/div&gt;", "div"),
])
def test_body(spark, raw, clean):
    assert one(spark, cleaning.clean_body, raw) == clean


@pytest.mark.parametrize("raw, listed, tags", [
    ("<java><c#>", "java,c#,", ["java", "c#"]),
    ("&lt;java&gt;&lt;c#&gt;", "java,c#,", ["java", "c#"]),
    ("<a><a>", "a,a,", ["a"]),
    ("", "", []),
    (None, "", []),
])
def test_tags(spark, raw, listed, tags):
    assert one(spark, cleaning.tag_list, raw) == listed
    assert one(spark, lambda c: cleaning.split_tags(cleaning.tag_list(c)), raw) == tags


def test_posts_file(spark):
    lines = [
        '<?xml version="1.0" encoding="utf-8"?>',
        "<posts>",
        '  <row Id="1" PostTypeId="1" Title="How to &lt;b&gt; parse" '
        'Body="&lt;p&gt;a &amp;lt;T&amp;gt; b&lt;/p&gt;&#xA;c" '
        'Tags="&lt;java&gt;&lt;c#&gt;" AnswerCount="3" ViewCount="10" />',
        '  <row Id="2" PostTypeId="2" Body="x" />',
        "</posts>",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = posts.clean_posts(posts.parse_post_lines(df)).collect()
    assert [tuple(r) for r in got] == [(1, "How to   parse", "a T bc", ["java", "c#"], 3, 10)]


@pytest.mark.parametrize("bad", ["  <row Id=\"x\" PostTypeId=\"1\" />", "  <row Id=\"1\" PostTypeId=", "no element"])
def test_broken_posts_fail(spark, bad):
    df = spark.createDataFrame([(bad,)], "value string")
    with pytest.raises(Exception, match="(?i)malformed|parse|cast|xml"):
        posts.parse_post_lines(df).collect()


def test_outer_spaces_stay_and_posts_are_parsed_once(spark):
    df = spark.createDataFrame([('<row Id="1" PostTypeId="1" Title="  a " Body="b" />',)], "value string")
    cleaned = posts.clean_posts(posts.parse_post_lines(df))
    assert cleaned.first().title == "  a "
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1


def test_content_and_labels(spark):
    df = spark.createDataFrame([(None, "b"), ("t", None), ("t", "b")], "t string, b string")
    assert [r[0] for r in df.select(cleaning.content(F.col("t"), F.col("b"))).collect()] == ["b", "t", "t b"]
    df = spark.createDataFrame([("c#", 1), ("c#", 0)], "tag string, label int")
    got = rows(df.select(cleaning.label_text(F.col("tag"), F.col("label"))))
    assert got == [("NOT_c#",), ("c#",)]


def test_chunks(spark):
    df = spark.range(10, 20).withColumnRenamed("id", "q_id")
    got = rows(posts.with_chunk(df, 4))
    assert got == [(10 + i, i // 4) for i in range(10)]
