"""Connected groups of nodes that share buckets, without the pairs of a large bucket.

``grouped`` first compares every node with one leader of each of its buckets, which joins a family of near
copies by as many pairs as it has members. Only then are nodes of one bucket that are still in
different groups compared: those outside the bucket's largest group, with the rest. Every pair that shares
a bucket is so either compared, or already in one group: the groups are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import among, components, mask_of
from tagloom.session import stage

Verify = Callable[[DataFrame], DataFrame]


def shared(rows: DataFrame) -> DataFrame:
    """The distinct rows of ``rows(bucket, node, ...)`` in buckets with two nodes or more, as files.

    Buckets are counted by narrow rows first. A mask of bounded size then drops most rows of the others before the join shuffles
    them, which drops what the mask lets through.
    """
    ends = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    # a plan of its own, so that the join can split a hot bucket
    often = stage(ends.where("least <> most").select("bucket"))
    return stage(among(rows, mask_of(often, "bucket"), "bucket").join(often, "bucket").distinct())


def grouped(multi: DataFrame, verify: Verify, fits: str = "true", payload: list[str] | None = None) -> DataFrame:
    """(node, root) of all groups of two nodes or more.

    ``multi``: what ``shared`` returns of ``rows(bucket, node, times)`` with columns ``payload`` of the node.
    ``verify``: distinct (a, b) -> those that are linked. ``fits``: an SQL condition on the payload columns of a pair,
    named x_<column> and y_<column>, that every linked pair meets in one of its buckets.

    The leader is the node that occurs most often, which is the likely origin of a family of near copies and so nearest to all of it.
    """
    payload = payload or []
    lead = multi.groupBy("bucket").agg(F.max(F.struct("times", "node", *payload)).alias("x"))
    lead = stage(lead.select("bucket", *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("node", *payload)]))
    first = multi.select("bucket", *[F.col(c).alias(f"y_{c}") for c in ("node", *payload)]).join(lead, "bucket")
    first = first.where("x_node <> y_node").where(fits)
    first = stage(first.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())
    links = stage(verify(first))
    group = stage(components(links))
    placed = (
        multi.join(group, "node", "left")
        .select("bucket", "node", *payload, F.coalesce("root", "node").alias("root"))
    )
    placed = stage(placed)
    per = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = (
        per.groupBy("bucket")
        .agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("groups"))
        .where("groups > 1").select("bucket", F.col("most.root").alias("most"))
    )
    rows = stage(placed.join(open_, "bucket"))
    x = rows.select("bucket", "most", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", *payload)])
    y = rows.select("bucket", *[F.col(c).alias(f"y_{c}") for c in ("node", "root", *payload)])
    # a pair of two outsiders is made once, by its smaller node
    pairs = (
        x.where("x_root <> most").join(y, "bucket")
        .where("x_root <> y_root AND (y_root = most OR x_node < y_node)").where(fits)
        .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    more = stage(verify(stage(pairs)))
    if more.isEmpty():
        return group
    return components(group.toDF("a", "b").union(more.select("a", "b")))
