"""Documents to term rows: counts, postings, vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import porter
from tagloom.functions.text import (
    PLAIN,
    Profile,
    keeps_characters,
    keeps_length,
    not_stopword,
    raw_tokens,
    term_array,
)
from tagloom.operators.ranking import row_number_in_blocks
from tagloom.operators.sharding import task_count
from tagloom.session import filed, forget


def document_terms(
    docs: DataFrame,
    profile: Profile = PLAIN,
    cluster_on: Sequence[str] | None = None,
    text: str = "content",
    partitions: int | None = None,
) -> DataFrame:
    """TXT-1..7, AGG-15: (q_id, term, tf), plus the ``cluster_on`` columns.

    The text is shuffled once, by document (or by ``cluster_on``); counting afterwards is local
    to the partition, and so is any later join on the same columns. Stems are computed on the
    distinct words of a document, not on every token. The number of ``partitions`` follows that of
    the documents, so that the words of a task stay as many when these grow.
    """
    keys = list(cluster_on or ["q_id"])
    carry = list(dict.fromkeys([*keys, "q_id"]))
    partitions = partitions or task_count(docs.sparkSession, docs.count())
    placed = docs.select(*carry, F.col(text).alias("_text")).repartition(partitions, *keys)
    words = placed.select(*carry, F.explode(raw_tokens(F.col("_text"), profile)).alias("term"))
    term = F.col("term")
    words = words.where(keeps_length(term, profile) & keeps_characters(term, profile))
    if not profile.stem:
        words = words.where(not_stopword(term, profile))
    counted = words.groupBy(*carry, "term").agg(F.count(F.lit(1)).alias("tf"))
    if not profile.stem:
        return counted
    stems = porter.with_stem(counted, "term", "_stem").where(not_stopword(F.col("_stem"), profile))
    return stems.groupBy(*carry, F.col("_stem").alias("term")).agg(F.sum("tf").alias("tf"))


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """List lengths and concatenated items."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def pack_terms(terms: DataFrame) -> DataFrame:
    """The rows of ``document_terms`` as two arrays per document: (q_id, terms, tfs)."""
    return terms.groupBy("q_id").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))


#: Between the terms of a packed document; no tokeniser lets it into a term.
SEPARATOR = "\x00"
CODEC = pa.Codec("zstd", compression_level=1)


def squeezed(numbers: np.ndarray) -> bytes:
    """Compressed, the first bytes of all numbers before the second ones: whole numbers have few others than zero there."""
    raw = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def array_of(packed: bytes, kind: type) -> np.ndarray:
    raw = CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def encoded(sizes: np.ndarray, terms: pa.Array, numbers: Sequence[np.ndarray], total: int = 0) -> pa.Array:
    """One binary per document: its terms and the whole ``numbers`` of each, compressed, with one number of the whole document."""
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    names = pc.binary_join(pa.ListArray.from_arrays(pa.array(first), terms.cast(pa.string())), SEPARATOR).cast(pa.binary())
    narrow = [n.astype(np.int32) for n in numbers]
    out = []
    for k, name in enumerate(names.to_pylist()):
        part = slice(first[k], first[k + 1])
        raw = b"".join([np.array([sizes[k], total], np.int64).tobytes(), *[n[part].tobytes() for n in narrow], name])
        out.append(len(raw).to_bytes(4, "little") + CODEC.compress(raw, asbytes=True))
    return pa.array(out, pa.binary())


def decoded(column: pa.ChunkedArray, many: int = 1) -> tuple[np.ndarray, pa.Array, list[np.ndarray], np.ndarray]:
    """What ``encoded`` was given, of ``many`` numbers a term: sizes, concatenated terms and numbers, numbers of the documents."""
    raw = [CODEC.decompress(b[4:], int.from_bytes(b[:4], "little"), asbytes=True) for b in column.to_pylist()]
    head = np.frombuffer(b"".join(r[:16] for r in raw), np.int64).reshape(-1, 2)
    sizes = head[:, 0]
    numbers = [
        np.frombuffer(b"".join(r[16 + 4 * j * n:16 + 4 * (j + 1) * n] for r, n in zip(raw, sizes.tolist())), np.int32)
        for j in range(many)
    ]
    names = pa.array([r[16 + 4 * many * n:] for r, n in zip(raw, sizes.tolist())], pa.binary()).cast(pa.string())
    # an empty string has one empty part
    terms = pc.split_pattern(names.filter(pa.array(sizes > 0)), SEPARATOR).flatten()
    return sizes, terms, numbers, head[:, 1]


DOCS_AT_ONCE = 1_000  # whose terms Python holds as rows


def slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, DOCS_AT_ONCE):
            yield pa.Table.from_batches([batch.slice(start, DOCS_AT_ONCE)])


def _summed(doc: np.ndarray, terms: pa.Array, tf: np.ndarray, docs: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Sizes, terms in order and sums of tf of every document."""
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    wide = max(1, len(order))
    cells, back = np.unique(doc * wide + rank[coded.indices.to_numpy(zero_copy_only=False)], return_inverse=True)
    sums = np.bincount(back, tf, len(cells)).astype(np.int64)
    return np.bincount(cells // wide, minlength=docs), coded.dictionary.take(pa.array(order[cells % wide])), sums


def _counted(batches):
    for rows in slices(batches):
        sizes, words = flat(rows["words"])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sizes, terms, tf = _summed(doc, words, np.ones(len(doc), np.int64), len(sizes))
        packed = rows.select(["q_id"]).append_column("doc", encoded(sizes, terms, [tf]))
        yield from packed.filter(pa.array(sizes > 0)).to_batches()


def _merged(batches):
    """One document of those that bear one id."""
    for rows in slices(batches):
        many, docs = flat(rows["docs"])
        first = np.cumsum(many) - many
        out = docs.take(pa.array(first)).to_pylist()
        for k in np.flatnonzero(many > 1):
            sizes, terms, (tf,), _ = decoded(docs.slice(first[k], many[k]))
            out[k] = encoded(*_whole(_summed(np.zeros(len(tf), np.int64), terms, tf, 1)))[0].as_py()
        yield from rows.select(["q_id"]).append_column("doc", pa.array(out, pa.binary())).to_batches()


def _whole(summed: tuple[np.ndarray, pa.Array, np.ndarray]) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
    return summed[0], summed[1], [summed[2]]


def _compacted(batches):
    for rows in slices(batches):
        sizes, terms = flat(rows["terms"])
        tf = flat(rows["tfs"])[1].to_numpy(zero_copy_only=False)
        packed = rows.select(["q_id"]).append_column("doc", encoded(sizes, terms, [tf]))
        yield from packed.filter(pa.array(sizes > 0)).to_batches()


def _unpacked(batches):
    for rows in slices(batches):
        sizes, terms, (tf,), _ = decoded(rows["doc"])
        first = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        yield from rows.select(["q_id"]).append_column("terms", pa.ListArray.from_arrays(first, terms)).append_column(
            "tfs", pa.ListArray.from_arrays(first, pa.array(tf.astype(np.int64)))
        ).to_batches()


def compact(packed: DataFrame) -> DataFrame:
    """Packed documents (q_id, terms, tfs), or the rows of ``document_terms``, as (q_id, doc), ``doc`` compressed."""
    if "doc" in packed.columns:
        return packed
    packed = packed if "terms" in packed.columns else pack_terms(packed)
    return packed.select("q_id", "terms", "tfs").mapInArrow(_compacted, f"q_id {packed.schema['q_id'].dataType.simpleString()}, doc binary")


def compact_terms(
    docs: DataFrame, profile: Profile = PLAIN, text: str = "content", partitions: int | None = None
) -> DataFrame:
    """``document_terms`` with one row per document that has terms, (q_id, doc), ``doc`` holding terms and counts compressed.
    Without stems to be formed, the words of a row are counted before anything is shuffled, so that no text is."""
    if profile.stem:
        return compact(pack_terms(document_terms(docs, profile, text=text, partitions=partitions)))
    partitions = partitions or task_count(docs.sparkSession, docs.count())
    kind = docs.schema["q_id"].dataType.simpleString()
    words = docs.select("q_id", term_array(F.col(text), profile).alias("words")).where("words IS NOT NULL")
    counted = words.mapInArrow(_counted, f"q_id {kind}, doc binary").repartition(partitions, "q_id")
    # rows of one id are one document
    return counted.groupBy("q_id").agg(F.collect_list("doc").alias("docs")).mapInArrow(_merged, f"q_id {kind}, doc binary")


def _repeated(batches):
    for rows in slices(batches):
        docs = rows["doc"].combine_chunks()
        out, times = docs.to_pylist(), rows["n"].to_pylist()
        for k, n in enumerate(times):
            if n is not None:
                sizes, terms, (tf,), _ = decoded(docs.slice(k, 1))
                out[k] = encoded(sizes, terms, [tf * n])[0].as_py()
        yield from rows.select(["q_id"]).append_column("doc", pa.array(out, pa.binary())).to_batches()


def repeated(compacted: DataFrame, times: DataFrame) -> DataFrame:
    """``compacted`` (q_id, doc) with the counts of the documents of ``times`` (q_id, n) taken n times."""
    kind = compacted.schema["q_id"].dataType.simpleString()
    return compacted.join(times, "q_id", "left").select("q_id", "doc", "n").mapInArrow(_repeated, f"q_id {kind}, doc binary")


def packed_terms(
    docs: DataFrame, profile: Profile = PLAIN, text: str = "content", partitions: int | None = None
) -> DataFrame:
    """``compact_terms`` with the terms and counts as two arrays: (q_id, terms, tfs)."""
    rows = compact_terms(docs, profile, text, partitions)
    return rows.mapInArrow(_unpacked, f"q_id {docs.schema['q_id'].dataType.simpleString()}, terms array<string>, tfs array<bigint>")


BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
HASH_BITS = 40


def term_hashes(terms: pa.Array) -> np.ndarray:
    """Numbers of ``HASH_BITS`` bits. Two terms may share one: whoever uses them must allow for it."""
    if not len(terms):
        return np.zeros(0, np.int64)
    terms = pa.concat_arrays([terms.cast(pa.string())])
    edge = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset:terms.offset + len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[edge[0]:edge[-1]]
    edge, size = edge - edge[0], np.diff(edge)
    power = np.cumprod(np.full(max(1, size.max()), BASE), dtype=np.uint64)
    place = np.arange(len(data)) - np.repeat(edge[:-1], size)
    value = (data.astype(np.uint64) + np.uint64(1)) * SPREAD
    value = (value ^ (value >> np.uint64(29))) * power[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    h = (sums[edge[1:]] - sums[edge[:-1]]) ^ size.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * SPREAD
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _hash_counts(batches):
    for rows in slices(batches):
        h, n = np.unique(term_hashes(decoded(rows["doc"])[1]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])


MASK_BITS = (16, 26)


def without_rare(compacted: DataFrame, least: int) -> DataFrame:
    """``compacted`` (q_id, doc) without most of the terms that occur in fewer than ``least`` documents.

    Occurrences are counted by hashes, and a Bloom mask of at most 2^26 bits tells each task which terms to keep: a hash that two
    terms share, or a full mask, keeps terms that are rare, but never drops one that is not.
    """
    if least <= 1:
        return compacted
    counts = compacted.mapInArrow(_hash_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = filed(counts.where(F.col("n") >= least).select("h"))
    bits = min(max(MASK_BITS[0], (8 * often.count()).bit_length()), MASK_BITS[1])
    low = F.lit((1 << bits) - 1)
    bit = F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftright("h", HASH_BITS - bits).bitwiseAND(low)))
    words = (
        often.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 31))")).alias("x")).toArrow()
    )
    forget(often)
    mask = np.zeros(1 << (bits - 5), np.uint32)
    mask[words["w"].to_numpy().astype(np.int64)] = words["x"].to_numpy().astype(np.uint32)

    def keep(batches):
        for rows in slices(batches):
            sizes, terms, (tf,), _ = decoded(rows["doc"])
            h = term_hashes(terms)
            kept = np.ones(len(h), bool)
            for at in (h & ((1 << bits) - 1), h >> (HASH_BITS - bits)):
                kept &= (mask[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
            out = rows.select(["q_id"]).append_column("doc", encoded(sizes, terms.filter(pa.array(kept)), [tf[kept]]))
            yield from out.filter(pa.array(sizes > 0)).to_batches()

    return compacted.select("q_id", "doc").mapInArrow(keep, f"q_id {compacted.schema['q_id'].dataType.simpleString()}, doc binary")


def postings(terms: DataFrame) -> DataFrame:
    """TXT-9: the inverted index as a table. Lists are rows, so a frequent term has no row limit;
    write with ``sources.writers.write_postings`` to range-sort it by term."""
    return terms.select("term", "q_id", "tf")


def vocabulary(tag_terms: DataFrame) -> DataFrame:
    """AGG-4, SRT-1, JON-6: per tag, the sorted distinct terms with ids from 0.

    The blocks of the two-pass row number are range partitions of (tag, term), drawn from the data and kept as files.
    """
    distinct = tag_terms.select("tag", "term").distinct()
    placed = filed(distinct.repartitionByRange("tag", "term").withColumn("_part", F.spark_partition_id()))
    numbered = row_number_in_blocks(placed, ["tag"], "term", "_rn", block=F.col("_part"))
    return numbered.select("tag", "term", (F.col("_rn") - 1).alias("term_id"))
