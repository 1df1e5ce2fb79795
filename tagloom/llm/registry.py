"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tagloom.llm import (
    fingerprint, language, licenses, lines, mixing, ngram_join, packing, phrase_index, quality, repeats, spelling, toxicity, vector_codes,
)
from tagloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": _on("documents", quality.verdicts),
    "op2_license_scans": lambda spark, d: licenses.query(table(spark, d, "pages"), table(spark, d, "documents")),
    "op3_ngram_join": _on("documents", ngram_join.join),
    "op4_repeats": _on("documents", repeats.query),
    "op5_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_packing": _on("documents", packing.pack),
    "op7_line_dedup": _on("documents", lines.query),
    "op8_mixing": _on("documents", mixing.mix),
    "op9_fingerprints": _on("documents", fingerprint.fingerprints),
    "op10_language": _on("documents", language.query),
    "op11_phrase_index": lambda spark, d: phrase_index.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op12_vector_codes": _on("embeddings", vector_codes.query),
    "op13_spelling": _on("documents", spelling.query),
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
