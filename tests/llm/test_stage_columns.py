"""Pipeline stages pass on columns whose names the operators use themselves; lines of nine letters make few pairs."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import llm_cases as cases  # noqa: E402

from tagloom.llm import lines, mixing, ngram_join, quality  # noqa: E402

NAMES = ("_id", "_at", "_copy", "_times", "_kept", "_S", "rows")


@pytest.mark.parametrize("stage", [quality.keep, ngram_join.dedup, mixing.repeat])
def test_stages_pass_on_underscore_columns(spark, stage):
    docs = cases.docs(spark).select("doc_id", "text", "lang", "source", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES])
    out = stage(docs)
    assert out.columns == docs.columns and out.schema["_id"].dataType.simpleString() == "string"
    got = out.collect()
    assert got and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in got for n in NAMES)


def test_lines_of_nine_letters_make_few_pairs(spark):
    rng = random.Random(3)
    nine = sorted({"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(2000)})
    docs = spark.createDataFrame([(k, "\n".join(nine[k::4])) for k in range(4)], "doc_id long, text string")
    classes = lines.line_rows(docs).selectExpr("key AS node", "1L AS times", "size", "least", "halves")
    buckets = lines.shared_keys(classes).groupBy("bucket").count()
    # of two million; keys of half a line are four letters of ten
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in buckets.collect()) < 2000
    assert {r.n_removed for r in lines.query(docs).collect()} == {0}
