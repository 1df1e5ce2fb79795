"""Joining a large, clustered table with a keyed table without moving the large one.

A hot key (a term in a third of all documents, a tag on a third of all questions) is
split by cutting the large side into *shards* of bounded size. The small side is copied to
exactly the shards that need a key, so what crosses the network is one row per distinct
(shard, key) and not one row per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import shuffle_partitions


#: Documents whose term rows one task holds at a time.
DOCS_PER_TASK = 2_048


def task_count(spark: SparkSession, docs: int, docs_per_task: int = DOCS_PER_TASK) -> int:
    """Partitions for the term rows of ``docs`` documents: more documents give more tasks, not larger ones."""
    return max(shuffle_partitions(spark), math.ceil(docs / docs_per_task))


def hash_shard(key: str, shards: Column | int) -> Column:
    count = F.lit(shards) if isinstance(shards, int) else shards
    return F.pmod(F.xxhash64(key), count.cast("bigint")).cast("int")


def default_shards(df: DataFrame) -> int:
    """Grows with the cluster, by its shuffle partition count, and with the rows."""
    return 2 * task_count(df.sparkSession, df.count(), 2 * DOCS_PER_TASK)


def keep_clustering(spark: SparkSession) -> None:
    """Let a join use tables that already lie on a part of its keys, here the shard columns.

    By default Spark spreads both sides again on all join keys, as a guard against skew; shards
    are bounded, so they need no guard, and the large side is spared a shuffle.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def join_in_shards(
    rows: DataFrame,
    values: DataFrame,
    shard: Sequence[str],
    key: Sequence[str],
    need: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Join ``rows`` (already clustered on ``shard``) with ``values`` on ``key``.

    ``values`` must not hold the shard columns unless they are part of ``key``. ``need`` is the
    distinct (shard, key) of ``rows``, if the caller has it. ``partitions``: how many ``rows`` lie in,
    if not the session's number of shuffle partitions.
    """
    keep_clustering(rows.sparkSession)
    if need is None:
        need = rows.select(*shard, *[k for k in key if k not in shard]).distinct()
    # the copies of one partition are distinct keys of its rows, far fewer than the rows, so
    # they are hashed and the rows need no sort
    lie = [partitions] if partitions else []
    if partitions:
        need = need.repartition(partitions, *key)
    copies = need.join(values, list(key)).repartition(*lie, *shard).hint("shuffle_hash")
    return rows.join(copies, list(dict.fromkeys([*shard, *key])))
