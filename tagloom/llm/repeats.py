"""Exact repeats by merging Burrows-Wheeler transforms.

Every byte under a string of ``LENGTH`` bytes that starts in two places of the corpus is removed.

1. *Where to look.* Each start of such a string belongs to the least hashed ``GRAM``-byte gram of the string, its anchor;
   equal strings have equal anchors. Starts in a row with one anchor make a *context*: the bytes from
   the first start to the end of the last string. Anchors that occur once end here; so do contexts that
   occur twice as a whole, since all their strings repeat.
2. *Merging.* The contexts that are left are the shards. A context is read as strings of ``SYMBOL``-byte symbols, one per byte phase, and
   its transform comes from sorting its own few suffixes. The transforms of all contexts that share anchors are
   merged by iterative interleave refinement: the interleave sorted by the first k symbols gives, by one stable
   counting sort of the symbols that precede, the interleave sorted by the first k + 1. Two neighbours that part in round
   k have a common prefix of k - 1 symbols; the intervals that are still whole after LENGTH / SYMBOL
   rounds are the repeated strings. No round compares or sorts suffixes of different shards.
3. Repeated starts become spans, spans are cut from the texts.

An anchor with more than ``GROUP`` different contexts is not merged in one task; the hashes of its contexts' strings are
counted by a plain aggregation, as exact as the merge.

Hashes of grams, contexts and strings have 64 bits. Edge cases: null texts are empty; matches never cross texts; texts shorter than
``LENGTH`` bytes lose nothing; runs of one character are one anchor chain like any text; rows equal in doc_id and text
repeat each other and lose all repeated bytes; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SCAN_BYTES, among, batched, joined, mask_of, mix, small, Rolling
from tagloom.session import stage

LENGTH, GRAM, SYMBOL = 200, 80, 8
GROUP = 512
MERGE_BYTES = 60_000


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every run of ``width`` values."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts of the texts ``data[first : first + size]``: text number, start in the text, number of starts,
    hashes of the anchor (h) and of the whole context (dig)."""
    empty = {k: np.zeros(0, np.int64) for k in ("text", "lo", "n", "h", "dig")}
    room = np.maximum(0, size - LENGTH + 1)
    if len(data) < LENGTH or not room.any():
        return empty
    rolling = Rolling(data)
    grams = rolling.windows(GRAM)
    low = np.uint64(0xFFFFFFFF)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_least(packed, LENGTH - GRAM + 1) & low).astype(np.int64)
    text = np.repeat(np.arange(len(size)), room)
    start = np.arange(len(text)) - np.repeat(np.cumsum(room) - room, room) + np.repeat(first, room)
    anchor = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    lo, anchor, text = start[at], anchor[at], text[at]
    off = anchor - lo
    whole = mix(rolling.raw(lo, lo + n + LENGTH - 1) + mix((n << 16 | off).astype(np.uint64)))
    return {"text": text, "lo": lo - first[text], "n": n, "h": grams[anchor].view(np.int64), "dig": whole.view(np.int64)}


def stable_order(x: np.ndarray, top: int) -> np.ndarray:
    """Stable sort of small integers, 16 bits at a time (numpy sorts those by counting)."""
    if top < 1 << 16:
        return np.argsort(x.astype(np.uint16), kind="stable")
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]


def shard_rows(strings: list[bytes]) -> tuple[np.ndarray, ...]:
    """All suffixes of all contexts, each context's in its own sorted order: shard, start (-1: the
    end of a phase's string), symbol before it, and the number of shards' rows."""
    shard, start, symbol, before, follow = [], [], [], [], []
    base = 0
    for k, x in enumerate(strings):
        for phase in range(SYMBOL):
            m = (len(x) - phase) // SYMBOL
            own = np.frombuffer(x, ">u8", m, phase).astype(np.uint64)
            symbol.append(own)
            shard.append(np.full(m + 1, k))
            start.append(np.append(phase + SYMBOL * np.arange(m), -1))
            before.append(np.concatenate([[-1], base + np.arange(m)]))
            follow.append(m)
            base += m
    ids = np.unique(np.concatenate(symbol), return_inverse=True)[1] + 1
    before = np.concatenate(before)
    prior = np.where(before < 0, 0, ids[np.maximum(before, 0)])
    # the first symbols of every suffix, 0 past its end
    lengths = np.array(follow)
    place = np.concatenate([np.arange(m + 1) for m in follow])
    string = np.repeat(np.arange(len(lengths)), lengths + 1)
    offset = (np.cumsum(lengths) - lengths)[string]

    def nth(j: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        p = place[rows] + j
        inside = p < lengths[string[rows]]
        return np.where(inside, ids[np.where(inside, offset[rows] + p, 0)], 0)

    shard, start = np.concatenate(shard), np.concatenate(start)
    top = int(ids.max()) + 1

    def sort(depth: int) -> np.ndarray:
        order = np.arange(len(shard))
        for j in range(depth - 1, -1, -1):
            order = order[stable_order(nth(j)[order], top)]
        return order[stable_order(shard[order], len(strings))]

    order = sort(3)
    firsts = [nth(j)[order] for j in range(3)]
    tied = (shard[order][1:] == shard[order][:-1]) & (firsts[0][1:] > 0)
    for f in firsts:
        tied &= f[1:] == f[:-1]
    if tied.any():
        order = sort(LENGTH // SYMBOL)
    return shard[order], start[order], prior[order], top


def repeated_starts(strings: list[bytes]) -> list[np.ndarray]:
    """For every context the sorted starts of strings that occur twice or more among all contexts."""
    shard, start, prior, top = shard_rows(strings)
    n, shards = len(shard), len(strings)
    # rows lie shard by shard, each shard's transform is the run of its `prior`
    source, block, now = shard.copy(), np.zeros(n, np.int64), prior
    for _ in range(LENGTH // SYMBOL):
        order = stable_order(now, top)
        symbol, source, old = now[order], source[order], block[order]
        part = np.zeros(n, np.int64)
        part[1:] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        block = np.cumsum(part)
        now = np.empty_like(prior)
        now[stable_order(source, shards)] = prior
        if block[-1] == n - 1:
            break
    at = np.empty(n, np.int64)  # interleaved row -> row of its shard
    at[stable_order(source, shards)] = np.arange(n)
    size = np.array([len(x) for x in strings])
    who, where = shard[at], start[at]
    real = (where >= 0) & (where + LENGTH <= size[who])
    often = np.bincount(block[real], minlength=n)
    hit = real & (often[block] > 1)
    who, where = who[hit], where[hit]
    order = np.lexsort((where, who))
    return np.split(where[order], np.searchsorted(who[order], np.arange(1, shards)))


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every run of consecutive numbers."""
    gap = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], gap + 1]).astype(int)], starts[np.append(gap, len(starts) - 1).astype(int)]


def sliced(data: bytes) -> Iterator[tuple[int, bytes]]:
    """A text as pieces of bounded size with their places; every string of ``LENGTH`` bytes starts in one of them."""
    for at in range(0, max(1, len(data) - LENGTH + 1), SCAN_BYTES):
        yield at, data[at : at + SCAN_BYTES + LENGTH - 1]


def anchored(docs: DataFrame) -> DataFrame:
    """(h, dig, r, lo, n) of every context of ``docs(r, text)``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            r = batch.column(0).to_numpy()
            pieces = [(i, *p) for i, t in enumerate(batch.column(1)) for p in sliced(t.as_py().encode("utf-8", "surrogatepass"))]
            for part in batched([len(p[2]) for p in pieces], SCAN_BYTES):
                c = contexts(*joined([p[2] for p in pieces[part]]))
                row, skipped = (np.array([p[k] for p in pieces[part]])[c["text"]] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (c["h"], c["dig"], r[row], (c["lo"] + skipped).astype(np.int32), c["n"].astype(np.int32))],
                    names=["h", "dig", "r", "lo", "n"],
                )

    return docs.mapInArrow(read, "h long, dig long, r long, lo int, n int")


def cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(h, r, lo, n, open)`` with the context's bytes."""
    lists = wanted.groupBy("r").agg(F.collect_list(F.struct("h", "lo", "n", "open")).alias("w"))
    likely = among(docs, mask_of(wanted, "r"), "r").dropDuplicates(["r"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[], [], [], [], []]
            for r, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    values = (w["h"], r.as_py(), w["lo"], w["open"], data[w["lo"] : w["lo"] + w["n"] + LENGTH - 1])
                    for column, value in zip(out, values):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["h", "r", "lo", "open", "bytes"])

    rows = likely.join(lists, "r").select("r", "text", "w")
    return rows.mapInArrow(read, "h long, r long, lo int, open boolean, bytes binary")


def merged(cut: DataFrame) -> DataFrame:
    """(r, first, last): runs of repeated starts in the open contexts; anchors are merged whole, several at a time."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for (_, r, lo, open_, _), starts in zip(held, repeated_starts([x[4] for x in held])):
            if open_ and len(starts):
                a, b = runs(starts)
                out[0] += [r] * len(a)
                out[1] += (a + lo).tolist()
                out[2] += (b + lo).tolist()
        types = [pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["r", "first", "last"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in small(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[-1][0] and weight > MERGE_BYTES:
                    yield solve(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[4])
        if held:
            yield solve(held)

    rows = cut.repartition("h").sortWithinPartitions("h").select("h", "r", "lo", "open", "bytes")
    return rows.mapInArrow(read, "r long, first int, last int")


def counted(cut: DataFrame) -> DataFrame:
    """The same by counting the hashes of all strings of the contexts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            opened = [np.zeros(0, bool)]
            for r, lo, open_, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                found = Rolling(np.frombuffer(data, np.uint8)).windows(LENGTH).view(np.int64)
                for column, value in zip(out, (found, np.full(len(found), r), lo + np.arange(len(found)))):
                    column.append(value)
                opened.append(np.full(len(found), open_))
            key, r, at = (np.concatenate(c) for c in out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(r), pa.array(at.astype(np.int32)), pa.array(np.concatenate(opened))],
                names=["key", "r", "first", "open"],
            )

    rows = cut.select("r", "lo", "open", "bytes").mapInArrow(read, "key long, r long, first int, open boolean")
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    return rows.where("open").join(often, "key", "left_semi").select("r", "first", F.col("first").alias("last"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(r, first, last): runs of starts of repeated strings in ``docs(r, text)``; runs may touch or overlap."""
    rows = anchored(docs)
    shared = rows.groupBy("h").agg(
        F.count(F.lit(1)).alias("times"), F.min("dig").alias("least"), F.max("dig").alias("most")
    ).where("times > 1").select("h", (F.col("least") == F.col("most")).alias("alike"))
    shared = stage(shared)  # a plan of its own, so that the join can split a hot anchor
    kept = stage(rows.join(shared, "h"))
    whole = kept.where("alike").select("r", "lo", "n")
    mixed = kept.where("NOT alike").drop("alike")
    each = stage(mixed.groupBy("h", "dig").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("r", "lo", "n")).alias("at")))
    twice = each.where("times > 1").select("h", "dig")
    whole = whole.union(mixed.join(twice, ["h", "dig"], "left_semi").select("r", "lo", "n"))
    per = each.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("fewest")).where("fewest = 1")
    wanted = each.join(per, "h").select("h", "at.*", (F.col("times") == 1).alias("open"), (F.col("kinds") > GROUP).alias("many"))
    wanted = stage(wanted)
    few = merged(cut_contexts(docs, wanted.where("NOT many").drop("many")))
    many = wanted.where("many").drop("many")
    found = few if many.isEmpty() else few.union(counted(stage(cut_contexts(docs, many))))
    return whole.select("r", F.col("lo").alias("first"), (F.col("lo") + F.col("n") - 1).alias("last")).union(found)


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", F.md5(text.cast("binary"))).alias("r"), text.alias("text"))
    spans = stage(repeated_spans(rows.select("r", "text")).distinct())
    lists = spans.groupBy("r").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[list] = [[] for _ in range(5)]
            for text, first, last in zip(batch.column(1), batch.column(2), batch.column(3)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                gone, spans, kept = 0, 0, data
                if first.is_valid:
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, np.array(first.as_py()), 1)
                    np.add.at(edge, np.array(last.as_py()) + LENGTH, -1)
                    under = np.cumsum(edge[:-1]) > 0
                    gone, spans = int(under.sum()), int(under[0]) + int((under[1:] & ~under[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~under].tobytes()
                values = (len(data), gone, spans, hashlib.sha256(kept).hexdigest(), kept)
                for column, value in zip(out, values):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, t) for v, t in zip(out, types)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    ready = rows.join(lists, "r", "left").select("doc_id", "text", "first", "last")
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return ready.mapInArrow(cut, schema)


def query(docs: DataFrame) -> DataFrame:
    return removal(docs).drop("kept")
