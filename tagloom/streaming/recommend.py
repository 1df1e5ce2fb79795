"""STR-1: score questions as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

QUESTION_STREAM = "q_id BIGINT, content STRING"


def question_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New Parquet files in ``folder`` as a stream of questions."""
    reader = spark.readStream.schema(QUESTION_STREAM)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def start(
    questions: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    progress: str,
    available_now: bool = False,
    every: str = "10 seconds",
) -> StreamingQuery:
    """Run ``score`` (a partial of ``recommend`` or ``recommend_routed``) on every micro-batch.

    A batch is written to its own ``batch=<id>`` directory in overwrite mode, so a batch that is
    run again after a failure replaces its first output and no row appears twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = questions.writeStream.foreachBatch(write).option("checkpointLocation", progress)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
