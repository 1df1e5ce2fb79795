"""Registered queries against their SQL on the smallest tables; and what their plans look like."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tagloom.catalog.files import QUERIES as FILE_QUERIES
from tagloom.catalog.oracles import ORACLES
from tagloom.catalog.queries import QUERIES as TABLE_QUERIES

QUERIES = {**TABLE_QUERIES, **FILE_QUERIES}

SF = os.environ.get("TAGLOOM_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
SLOW = {"stream_recommend", "svm_margins", "lloyd_step", "cluster_members",
        "cluster_tag_set", "training_rows_with_label_text", "idf"}  # same code as their neighbours


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(row):
    return tuple(None if v is None else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v) for v in row)


def test_every_query_has_a_counterpart():
    assert QUERIES.items() <= contract.queries().items() and ORACLES.items() <= contract.oracle_sql().items()
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})")
    assert sorted(want.columns) == cols
    assert sorted(map(plain, df.select(cols).collect()), key=repr) == sorted(map(plain, want.fetchall()), key=repr)
    spark.catalog.clearCache()


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["clean_body", "tokens_plain", "postings", "tfidf_per_tag", "negatives"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups|CartesianProduct", plan)


def test_pages_scan_reads_two_columns(spark):
    plan = QUERIES["clean_title"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_features_are_shuffled_once(spark):
    """Above the cached, placed term rows only the small copies of the idf rows are exchanged."""
    from tagloom.catalog import queries as Q

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        w = Q._weighted(spark, SF)
        w.features.collect()
        plan = w.features._jdf.queryExecution().executedPlan()
        features = w.features.agg(F.count("x"))
        features.collect()
        plan = features._jdf.queryExecution().executedPlan().toString()
        final = plan[: plan.index("== Initial Plan ==")]
        above = final[: final.index("TableCacheQueryStage")]
        moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", above)
        assert not any("q_id" in keys or "term" in keys for keys in moved), moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.catalog.clearCache()
