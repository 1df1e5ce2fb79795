"""Row numbers and top-k without an unbounded group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


def row_number_in_blocks(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    out: str = "rn",
    total: str | None = None,
    block: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """1-based position of ``order`` inside ``group``, in two passes.

    ``order`` is unique inside a group. Rows are cut into blocks that follow the order (for
    an integer: ranges of ``block_rows`` values, so a block cannot hold more rows than that;
    other types pass ``block``). Only block *counts* are added up per group; the sort happens
    per (group, block). A group holding a third of all rows is thus spread over many tasks.
    ``partitions``: in how many to sort, for rows that carry texts.
    """
    if block is None:
        block = F.expr(f"`{order}` div {block_rows}")
    # a struct key: a missing group value is a group of its own and survives the join
    rows = df.withColumn("_key", F.struct(*[F.col(g) for g in group], block.alias("_blk")))
    placed = rows.repartition(partitions, "_key") if partitions else rows
    whole = Window.partitionBy(*([F.col(f"_key.{g}") for g in group] or [F.lit(0)]))
    before = whole.orderBy("_key._blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_key",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
            F.sum("_n").over(whole).alias("_total"),
        )
    )
    inside = Window.partitionBy("_key").orderBy(order)
    joined = placed.join(offsets, "_key").withColumn(
        out, F.row_number().over(inside) + F.col("_off")
    )
    if total:
        joined = joined.withColumn(total, F.col("_total"))
    return joined.drop("_key", "_off", "_total")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """SRT-2, WIN-5: the first ``k`` rows of each group.

    Spark cuts each map side to ``k`` rows per group before the exchange (window group limit).
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
