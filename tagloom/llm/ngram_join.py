"""N-gram Jaccard join over a prefix tree.

A text is the set of its hashed ``SIZE``-word shingles (ASCII letters lower-cased; a shorter text is one shingle). All sets
follow one global order: shingles by the power of two of the number of documents that have them, as far as it is known, then by hash. Two sets
with a Jaccard similarity of at least ``PERCENT`` % then share one of their first (100 - PERCENT) % + 1
shingles, so sets meet in the buckets of those. What is known of the numbers changes the work, never the result.

Pairs are verified per probe set: its partners' ordered sets form a trie, walked depth first, so that partners with a
common start share the partial overlap up to where they part; a branch ends as soon as the overlap plus the
shorter of the remaining lengths cannot reach the bound. Every linked pair of different sets is checked exactly, or
lies in a group that is joined already (``buckets.grouped``); equal sets are one class from the start.

Scale: numbers of documents are kept in a table of 2^``RANK_BITS`` bytes whatever the corpus, so that a shingle of a few dozen documents
comes after rare ones in a large corpus too, and buckets stay small; only the first shingles are shuffled; counts per cell of hash space tell most false partners apart, and whole sets travel only for the others; a family of
near copies is checked in blocks, so that each set travels few times.

Edge cases: null texts and texts without a word are empty sets, linked with nothing (component_id = doc_id); repeated rows
get equal results; a null doc_id is skipped when the smallest id is taken; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.buckets import grouped, shared
from tagloom.llm.common import aside, components, in_mask, mask_of, mix, small, word_hashes
from tagloom.session import stage

SIZE, PERCENT = 4, 85
RANK_BITS = 22
TRIE_SETS = 128
CELLS = 128
COUNTED = 1 << 22  # shingles that are counted at a time


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for h in word_hashes([t or "" for t in texts]):
        n = max(1, len(h) - size + 1) if len(h) else 0
        out = np.full(n, min(len(h), size), np.uint64)
        for k in range(min(len(h), size)):
            out = mix(out ^ h[k : k + n]) + np.uint64(k + 1)
        yield np.unique(out)


def profile(found: np.ndarray) -> bytes:
    """How many of the shingles fall into each of ``CELLS`` cells, at most 255 each."""
    return np.minimum(np.bincount(found & np.uint64(CELLS - 1), minlength=CELLS), 255).astype(np.uint8).tobytes()


def ordered(found: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """``found`` (sorted) by rank, then by hash."""
    return found[np.argsort(ranks[found >> np.uint64(64 - RANK_BITS)], kind="stable")]


def prefix_length(n: int, percent: int) -> int:
    """A set of n shingles shares at least ceil(n * percent / 100) of them with any set it is linked to."""
    return n - -(-n * percent // 100) + 1


def shingle_ranks(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """The rank of each cell of hash space: the highest power of two of the documents that have one of its shingles, 0 below 3, as far as a shingle
    occurs twice or more within the parts it is counted in."""

    def counts(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        often = times >= 2
        return pa.RecordBatch.from_arrays(
            [pa.array(found[often].view(np.int64)), pa.array(times[often], pa.int64())], names=["token", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in small(batches):
            for found in shingle_sets(batch.column(0).to_pylist(), size):
                held.append(found)
                total += len(found)
            if total > COUNTED:
                yield counts(held)
                held, total = [], 0
        yield counts(held)

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    cell = F.shiftrightunsigned("token", 64 - RANK_BITS).cast("int").alias("cell")
    known = rows.where("n > 2").groupBy(cell).agg(F.max(F.floor(F.log2("n")).cast("byte")).alias("rank")).toArrow()
    out = np.zeros(1 << RANK_BITS, np.uint8)
    out[known["cell"].to_numpy()] = known["rank"].to_numpy()
    return out


def signed_sets(docs: DataFrame, ranks: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, n, set_id (hash of the whole set, null if empty) and prefix (null where the task has shown the set before)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = set()
        for batch in small(batches):
            sizes, ids, prefixes, profiles = [], [], [], []
            for found in shingle_sets(batch.column(1).to_pylist(), size):
                profiles.append(profile(found) if len(found) else None)
                sizes.append(len(found))
                own = xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None
                ids.append(own)
                fresh = own is not None and own not in shown
                prefixes.append(ordered(found, ranks)[: prefix_length(len(found), percent)].view(np.int64) if fresh else None)
                if len(shown) < 1_000_000:
                    shown.add(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(profiles, pa.binary())],
                names=["doc_id", "n", "set_id", "prefix", "profile"],
            )

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {id_type}, n long, set_id long, prefix array<long>, profile binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, ranks: np.ndarray, size: int) -> DataFrame:
    """(node, items): the ordered sets of ``wanted(node, k)``, k the hash of a doc_id that has it; items are big-endian.

    Texts are not shuffled: a mask of bounded size tells which of them to read, the join drops what it lets through.
    """
    mask = mask_of(wanted, "k")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            batch = batch.filter(pa.array(in_mask(mask, batch.column(0).to_numpy())))
            sets = [ordered(x, ranks) for x in shingle_sets(batch.column(1).to_pylist(), size)]
            ids = [xxhash.xxh3_64_intdigest(np.sort(x).tobytes()) - (1 << 63) for x in sets]
            items = [x.astype(">u8").tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(items, pa.binary())], names=["k", "node", "items"])

    rows = docs.select(F.xxhash64("doc_id").alias("k"), "text").mapInArrow(read, "k long, node long, items binary")
    return rows.join(wanted, ["k", "node"], "left_semi").dropDuplicates(["node"]).select("node", "items")


def walk(probe: np.ndarray, partners: list[tuple[int, np.ndarray]], percent: int) -> list[int]:
    """Which partners (id, ordered set) are linked to ``probe``.

    Sorted partners are the leaves of a trie from left to right; ``overlap[d]`` is the partial overlap of the path to the
    current leaf at depth d, so a leaf starts where it parts from the one before.
    """
    probe = np.sort(probe)
    linked: list[int] = []
    last, overlap, dead = np.zeros(0, np.uint64), np.zeros(1, np.int64), -1
    for node, items in sorted(partners, key=lambda p: p[1].astype(">u8").tobytes()):
        m = min(len(items), len(last))
        apart = np.flatnonzero(items[:m] != last[:m])
        depth = int(apart[0]) if len(apart) else m
        n, both = len(items), len(items) + len(probe)
        # 100 * o >= percent * (both - o)
        need = -(-percent * both // (100 + percent))
        depth = min(depth, len(overlap) - 1)
        path = overlap[: depth + 1]
        while True:
            done, known = len(path) - 1, int(path[-1])
            if known + min(n - done, len(probe) - known) < need:
                break
            if done == n:
                linked.append(node)
                break
            step = items[done : done + 128]
            at = np.minimum(np.searchsorted(probe, step), len(probe) - 1)
            path = np.concatenate([path, known + np.cumsum(probe[at] == step)])
        last, overlap = items[: len(path) - 1], path
    return linked


def possible(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs whose profiles allow the overlap that a link needs: two sets share at most the smaller count of every
    cell (a full cell counts as any number)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CELLS) for k in (2, 3))
            n, m = (batch.column(k).to_numpy() for k in (4, 5))
            most = np.minimum(x, y)
            most = np.where((most == 255).any(1), np.minimum(n, m), most.sum(1, dtype=np.int64))
            keep = (100 + percent) * most >= percent * (n + m)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    left = profiles.select(F.col("node").alias("a"), F.col("profile").alias("x"), F.col("n").alias("n_a"))
    right = profiles.select(F.col("node").alias("b"), F.col("profile").alias("y"), F.col("n").alias("n_b"))
    near = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    both = pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "x", "y", "n_a", "n_b")
    return both.mapInArrow(read, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked.

    A set travels once to each group of pairs that it is in, not once per pair: families (components of the pairs) of up to
    ``TRIE_SETS`` sets stay together, several small ones in a group; a larger family is cut into blocks, and a
    pair is checked where its two blocks meet.
    """
    family = components(pairs)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    placed = ends.join(family, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    sizes = stage(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    spread = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // TRIE_SETS)
    blocks = F.ceil(F.col("n") / TRIE_SETS)
    own = F.when(F.col("n") > TRIE_SETS, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(spread)))
    placed = stage(placed.join(sizes, "root").select("node", own.alias("family"), F.pmod(F.xxhash64("node"), blocks).alias("block")))
    left, right = placed.toDF("a", "family", "block_a"), placed.select("node", "block").toDF("b", "block_b")
    group = ["family", "low", "high"]
    dealt = stage(pairs.join(left, "a").join(right, "b").select(
        "family", F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high"), "a", "b"))
    members = dealt.select(*group, F.col("a").alias("node")).union(dealt.select(*group, F.col("b").alias("node"))).distinct()
    rows = members.join(sets, "node").select(*group, F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "items")
    rows = rows.union(dealt.select(*group, "a", "b", F.lit(None).cast("binary").alias("items")))

    def check(group: pd.DataFrame) -> pd.DataFrame:
        held = {a: np.frombuffer(x, ">u8").astype(np.uint64) for a, x in zip(group["a"], group["items"]) if x is not None}
        partners: dict[int, list] = {}
        for a, b, x in zip(group["a"], group["b"], group["items"]):
            if x is None:
                partners.setdefault(a, []).append((b, held[b]))
        found = [(a, b) for a, others in partners.items() for b in walk(held[a], others, percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return rows.groupBy(*group).applyInPandas(check, "a long, b long")


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_id (class of equal sets, null if empty) and component_id of every row."""
    docs = docs.select("doc_id", "text")
    ranks = shingle_ranks(docs, size)
    rows = stage(signed_sets(docs, ranks, size, percent))
    least = rows.groupBy(F.col("set_id").alias("node")).agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times"))
    least = stage(least.where("node IS NOT NULL"))
    # a set that occurs once has one row of its shingles; of the others every task has shown one
    often = least.where("times > 1").select(F.col("node").alias("set_id"), "times")
    prefixes = rows.where("prefix IS NOT NULL").join(often, "set_id", "left").select(
        F.posexplode("prefix").alias("pos", "bucket"), F.col("set_id").alias("node"), F.coalesce("times", F.lit(1)).alias("times"), "n")
    multi = shared(prefixes)
    profiles = rows.where("prefix IS NOT NULL").select(F.col("set_id").alias("node"), "profile", "n")
    profiles = stage(profiles.join(multi.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))

    def verify(pairs: DataFrame) -> DataFrame:
        near = stage(possible(pairs, profiles, percent))
        ends = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
        wanted = stage(least.join(ends, "node", "left_semi").select("node", F.xxhash64("doc_id").alias("k")))
        return verified(near, stage(whole_sets(docs, wanted, ranks, size)), percent)

    # nothing before the first shared shingle is shared, so what follows it must hold the whole overlap
    similar = f"{100 + percent} * least(x_n - x_pos, y_n - y_pos) >= {percent} * (x_n + y_n)"
    group = stage(grouped(multi, verify, similar, ["n", "pos"]))
    roots = least.join(group, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    heads = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = roots.join(heads, "root").select(F.col("node").alias("set_id"), "component_id")
    return rows.join(names, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "set_id", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand first in their component. Rows that share a doc_id are one document: the one whose
    text hashes least stays."""
    return aside(docs, ("doc_id", "text"), lambda rows: _dedup(rows, size, percent))


def _dedup(docs: DataFrame, size: int, percent: int) -> DataFrame:
    found = stage(join(docs, size, percent))
    first = found.where("set_id IS NULL OR doc_id <=> component_id")
    stay = docs.withColumn("_id", F.struct("doc_id")).join(first.select(F.struct("doc_id").alias("_id")).distinct(), "_id", "left_semi")
    if not found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        alike = Window.partitionBy("_id").orderBy(F.xxhash64("text"))
        stay = stay.withColumn("_at", F.row_number().over(alike)).where("_at = 1")
    return stay.select(*docs.columns)
