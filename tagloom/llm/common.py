"""What several operators share: words, global row numbers, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.session import shared_dir, stage

SPACE = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def filed(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared folder, whose size is known when a join is planned, so that a small side needs no shuffle of the large one."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def aside(docs: DataFrame, own: Sequence[str], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` on ``docs`` with all columns but ``own`` under names of no meaning, and the old names again on what it returns."""
    plain = docs.toDF(*[c if c in own else f"other_{i}" for i, c in enumerate(docs.columns)])
    return operator(plain).toDF(*docs.columns)


def part_hash(*columns: str, salt: int = 0) -> Column:
    return F.xxhash64(*columns, F.lit(salt))


class WordHashes:
    """64-bit hashes of words, remembered up to a bounded number of words."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in set(found) if w not in known]
        if len(known) + len(new) > self.limit:
            known.clear()
            new = set(found)
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that are scanned at a time, so that the arrays of a scan stay small.
SCAN_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Rolling:
    """Hashes of any run of a byte array, or of an array of 64-bit hashes, from prefix sums modulo 2^64."""

    values = mix(np.arange(1, 257, dtype=np.uint64))
    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling.up) < n:
            size = max(n, SCAN_BYTES * 2)
            one = np.ones(1, np.uint64)
            Rolling.up = np.cumprod(np.concatenate([one, np.full(size, BASE)]), dtype=np.uint64)
            Rolling.down = np.cumprod(np.concatenate([one, np.full(size, INVERSE)]), dtype=np.uint64)
        self.sums = np.zeros(n, np.uint64)
        values = Rolling.values[data] if data.dtype == np.uint8 else data
        np.cumsum(values * Rolling.up[: n - 1], dtype=np.uint64, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Rolling.down[start]

    def windows(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * Rolling.down[:n])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


def batched(sizes: list[int], limit: int) -> Iterator[slice]:
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > limit:
            yield slice(start, k)
            start, held = k, 0
        held += n
    if sizes:
        yield slice(start, len(sizes))


SLICE_ROWS = 500


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what Python makes of their texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of every text, ASCII letters lower-cased. White space is ASCII, so words are found in
    the UTF-8 bytes, many texts at a time."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for part in batched([len(t) for t in raw], SCAN_BYTES):
        # a space after every text ends its last word
        data, first, size = joined([t + b" " for t in raw[part]])
        rolling = Rolling(LOWER[data])
        edge = np.diff(IS_SPACE[data].astype(np.int8), prepend=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start) and len(end) and end[0] < start[0]:
            end = end[1:]
        found = mix(rolling.raw(start, end) + mix((end - start).astype(np.uint64)))
        yield from np.split(found, np.searchsorted(start, (first + size)[:-1]))


MASK_BITS = 24


def mask_of(rows: DataFrame, key: str) -> np.ndarray:
    """A Bloom mask of a column of hashes: 2^24 bits whatever the number of rows, or-ed before the shuffle."""
    low = F.lit((1 << MASK_BITS) - 1)
    bit = F.explode(F.array(F.col(key).bitwiseAND(low), F.shiftrightunsigned(F.col(key), MASK_BITS).bitwiseAND(low)))
    words = (
        rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 31))")).alias("x")).toArrow()
    )
    # columns, not a Python object for each of up to 2^19 rows
    out = np.zeros(1 << (MASK_BITS - 5), np.uint32)
    out[words["w"].to_numpy().astype(np.int64)] = words["x"].to_numpy().astype(np.uint32)
    return out


def in_mask(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for shift in (0, MASK_BITS):
        bit = (keys.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << MASK_BITS) - 1)
        hit &= (mask[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return hit


def among(rows: DataFrame, mask: np.ndarray, key: str) -> DataFrame:
    """The rows whose ``key`` is in the mask, and a few others: narrows texts before a join shuffles them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(key)
            keys = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array(in_mask(mask, keys)))

    return rows.mapInArrow(read, rows.schema)


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """``df`` with a gapless number from 0 in the order of the columns ``order``.

    Rows are range-partitioned and sorted once; partitions are numbered by their counts, so no
    task sees more than its range. The sorted rows are kept as files: range bounds are drawn
    anew whenever a plan runs, and a number must not change between its two uses.
    """
    placed = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.withColumn("_part", part)
        .join(sizes, "_part")
        .withColumn(out, inside + F.col("_before"))
        .drop("_at", "_part", "_before")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), root the smallest node, for every node but the roots.

    Alternates the large-star and small-star steps, each a grouped minimum whose
    partial aggregation happens before the shuffle, so a hub costs no task more than its share. Each round
    is written to the shared folder.
    """
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )
    while True:
        # large star: larger neighbours of a node join its smallest neighbour
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # few edges start at a node now, hubs are at their ends, so one layout serves the sum and the join
        large = large.where("v <> u").repartition("v")
        # small star: smaller neighbours and the node itself join the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
            .union(low.select("v", F.col("m").alias("u")))
            .distinct()
        )
        now = stage(small)
        # done when all is stars: no centre hangs on another, no node on two centres
        roles = now.select(F.col("v").alias("node"), F.lit(1).alias("leaf")).union(now.select("u", F.lit(0)))
        mixed = roles.groupBy("node").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("least"))
        if mixed.where("n > 1 OR (n = 1 AND least = 0)").isEmpty():
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
