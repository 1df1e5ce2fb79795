"""TF-IDF, for every tag at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.sharding import hash_shard, join_in_shards, keep_clustering, task_count
from tagloom.operators.terms import (
    array_of,
    compact,
    decoded,
    encoded,
    flat,
    pack_terms,
    slices,
    squeezed,
    term_hashes,
    without_rare,
)
from tagloom.session import filed, release_shuffles

MIN_DF = 4  # kept terms occur in more than three documents
DOCS_PER_SHARD = 4_096  # every shard gets a copy of the values of its terms, so larger ones move fewer


@dataclass
class Weighted:
    """``members`` with their shard and N, the idf table, and the long-form vectors."""

    members: DataFrame  # tag, shard, q_id, n_docs (+ label)
    idf: DataFrame  # tag, term, df, n_docs, idf
    features: DataFrame  # tag, shard, q_id, term, x; clustered on (tag, shard)
    held: tuple[DataFrame, ...] = ()  # persisted inputs of the above
    partitions: int | None = None  # in which the vectors lie
    shards: DataFrame | None = None  # the terms of each (tag, shard) in compressed buckets: tag, shard, bucket, held
    placed: DataFrame | None = None  # idf with the bucket of each term
    documents: DataFrame | None = None  # members that have terms, one row each with its compressed document; clustered on (tag, shard)

    def values(self) -> DataFrame:
        """What x needs of a term, in the form that ``to_shards`` sends to the shards."""
        if self.placed is None:
            return self.idf.select("tag", "term")
        return self.placed.select("tag", "term", "bucket", "df", "n_docs")

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def tag_sizes(pairs: DataFrame) -> DataFrame:
    """AGG-3: documents per tag, counted as rows."""
    return pairs.groupBy("tag").agg(F.count(F.lit(1)).alias("n_docs"))


def in_shards(pairs: DataFrame, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Cut each tag's documents into shards of about ``docs_per_shard``."""
    shards = F.ceil(F.col("n_docs") / F.lit(docs_per_shard))
    return pairs.join(tag_sizes(pairs), "tag").withColumn("shard", hash_shard("q_id", shards))


def tag_documents(members: DataFrame, terms: DataFrame, partitions: int | None = None) -> DataFrame:
    """Members with the terms and counts of their document as two arrays, clustered on (tag, shard) in as many partitions as
    the documents call for. A document on many tags is copied as one row per tag, not as one row per tag and term.
    ``terms`` may be packed already."""
    partitions = partitions or task_count(members.sparkSession, members.count())
    packed = terms if "terms" in terms.columns else pack_terms(terms)
    return members.drop("n_docs").join(packed, "q_id").repartition(partitions, "tag", "shard")


def term_rows(documents: DataFrame) -> DataFrame:
    """The rows (tag, shard, q_id, term, tf) of ``tag_documents``, where these lie."""
    return documents.select("tag", "shard", "q_id", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))


def tag_terms(members: DataFrame, terms: DataFrame, partitions: int | None = None) -> DataFrame:
    """Term counts of every (tag, document), clustered on (tag, shard) in as many partitions as the documents call for."""
    return term_rows(tag_documents(members, terms, partitions))


def shard_frequency(sharded_terms: DataFrame) -> DataFrame:
    """Documents per (tag, shard, term), without a shuffle."""
    return sharded_terms.groupBy("tag", "shard", "term").agg(F.count(F.lit(1)).alias("df"))


def document_frequency(per_shard: DataFrame) -> DataFrame:
    """AGG-6: documents per (tag, term), summed over the shards."""
    return per_shard.groupBy("tag", "term").agg(F.sum("df").alias("df"))


def inverse_frequency(df: DataFrame, sizes: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """AGG-7, FLT-10: the raw ratio N / df of terms in at least ``min_df`` documents."""
    return (
        df.where(F.col("df") >= min_df)
        .join(sizes, "tag")
        .withColumn("idf", F.col("n_docs").cast("double") / F.col("df").cast("double"))
    )


def tf_idf(sharded_terms: DataFrame, idf: DataFrame, per_shard: DataFrame, partitions: int | None = None) -> DataFrame:
    """AGG-8, FLT-11, JON-5, WIN-4: x = tf / (kept tokens of the document) * idf.

    ``sharded_terms`` stays where it is; the idf rows travel to the shards.
    """
    kept = join_in_shards(
        sharded_terms, idf.select("tag", "term", "idf"), ["tag", "shard"], ["tag", "term"],
        need=per_shard.select("tag", "shard", "term"), partitions=partitions,
    )
    total = F.sum("tf").over(Window.partitionBy("tag", "shard", "q_id"))
    x = F.col("tf").cast("double") / total.cast("double") * F.col("idf")
    return kept.select("tag", "shard", "q_id", "term", x.alias("x"))


SHARDS_PER_BUCKET = 4


def _frequency(docs: pa.Table) -> pa.Table:
    """The terms of one (tag, shard), and how many rows hold each, as one row a bucket."""
    coded = decoded(docs["doc"])[1].dictionary_encode()
    df = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
    order = pc.sort_indices(coded.dictionary).to_numpy()
    bucket = (term_hashes(coded.dictionary) % docs["buckets"][0].as_py())[order]
    by_bucket = np.argsort(bucket, kind="stable")
    order = order[by_bucket]
    own, sizes = np.unique(bucket, return_counts=True)
    held = encoded(sizes, coded.dictionary.take(pa.array(order)), [df[order]])
    place = [pa.repeat(docs[c][0], len(own)) for c in ("tag", "shard")]
    return pa.table([*place, pa.array(own.astype(np.int32)), held], names=["tag", "shard", "bucket", "held"])


def _often(min_df: int):
    def add(rows: pa.Table) -> pa.Table:
        """The terms of one (tag, bucket) in enough documents."""
        _, terms, (df,), _ = decoded(rows["held"])
        coded = terms.dictionary_encode()
        df = np.bincount(coded.indices.to_numpy(zero_copy_only=False), df, len(coded.dictionary)).astype(np.int64)
        some = np.flatnonzero(df >= min_df)
        place = [pa.repeat(rows[c][0], len(some)) for c in ("tag", "bucket")]
        return pa.table([*place, coded.dictionary.take(pa.array(some)), pa.array(df[some])], names=["tag", "bucket", "term", "df"])

    return add


def _term_x(docs: pa.Table, known: pa.Table) -> pa.Table:
    """The long-form vectors of one (tag, shard)."""
    kind = docs.schema.field("q_id").type
    schema = pa.schema([("tag", pa.string()), ("shard", pa.int32()), ("q_id", kind), ("term", pa.string()), ("x", pa.float64())])
    if not docs.num_rows or not known.num_rows:
        return schema.empty_table()
    known = opened(known)
    # rows of a repeated member share what the document's kept tokens sum to
    once = docs["q_id"].combine_chunks().dictionary_encode()
    doc, at, x = entries(docs, known, False, once.indices.to_numpy(zero_copy_only=False))
    row = pa.array(doc)
    return pa.table(
        [docs["tag"].take(row), docs["shard"].take(row), docs["q_id"].take(row), known["term"].combine_chunks().take(pa.array(at)), pa.array(x)],
        schema=schema,
    )


def most_repeats(pairs: DataFrame) -> int:
    """How often the same member of a tag occurs at most."""
    return pairs.groupBy("tag", "q_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1


def weigh(pairs: DataFrame, terms: DataFrame, min_df: int = MIN_DF,
          docs_per_shard: int = DOCS_PER_SHARD) -> Weighted:
    """Vectors of all documents of all tags. Documents without a kept term have no feature row
    but stay in ``members`` and count in N (ML-2).

    ``terms``: ``compact_terms``, or any form that ``compact`` takes. A document is copied to each of its tags, so it is
    compressed first, and loses the terms that are in too few documents to be kept for any tag.
    """
    spark = pairs.sparkSession
    keep_clustering(spark)
    members = in_shards(pairs, docs_per_shard)
    # placed and counted once; everything below reads it where it lies
    partitions = task_count(spark, pairs.count())
    whole = filed(compact(terms))
    release_shuffles(spark)
    # a member that occurs m times counts m times
    kept = without_rare(whole, -(-min_df // most_repeats(pairs)))
    buckets = F.ceil(F.col("n_docs") / F.lit(docs_per_shard * SHARDS_PER_BUCKET)).cast("int").alias("buckets")
    copies = members.select(*[c for c in members.columns if c != "n_docs"], buckets).join(kept, "q_id")
    documents = copies.repartition(partitions, "tag", "shard").persist()
    documents.count()  # where a table lies is known to the joins below only once it is there
    shards = filed(documents.select("tag", "shard", "buckets", "doc").groupBy("tag", "shard").applyInArrow(
        _frequency, "tag string, shard int, bucket int, held binary"
    ))
    often = shards.groupBy("tag", "bucket").applyInArrow(_often(min_df), "tag string, bucket int, term string, df bigint")
    placed = filed(inverse_frequency(often, tag_sizes(pairs), min_df))
    release_shuffles(spark)
    idf = placed.select("tag", "term", "df", "n_docs", "idf")
    weighted = Weighted(members, idf, documents, (documents,), partitions, shards, placed, documents)
    weighted.features = _term_rows(weighted)
    return weighted


def _term_rows(weighted: Weighted) -> DataFrame:
    """AGG-8, FLT-11, JON-5, WIN-4: x = tf / (kept tokens of the document) * idf. The documents stay where they are; the
    idf rows travel to the shards."""
    documents = weighted.documents.select("tag", "shard", "q_id", "doc")
    known = to_shards(weighted, documents, weighted.values())
    kind = documents.schema["q_id"].dataType.simpleString()
    return documents.groupBy("tag", "shard").cogroup(known.groupBy("tag", "shard")).applyInArrow(
        _term_x, f"tag string, shard int, q_id {kind}, term string, x double"
    )


def kept_entries(docs: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, position in ``known`` and tf of every entry of a kept term."""
    sizes, words, (tf,), _ = decoded(docs["doc"])
    at = pc.index_in(words, value_set=known["term"].combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
    kept = at >= 0
    return np.repeat(np.arange(docs.num_rows), sizes)[kept], at[kept], tf[kept]


def entries(
    docs: pa.Table, known: pa.Table, weighted: bool, once: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, position in ``known`` and x of every entry of a kept term; ``weighted``: documents have terms and their x
    already. ``once``: rows of one number are one document."""
    if weighted:
        sizes, words = flat(docs["terms"])
        x = flat(docs["tfs"])[1].to_numpy(zero_copy_only=False).astype(np.float64)
        at = pc.index_in(words, value_set=known["term"].combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
        kept = at >= 0
        return np.repeat(np.arange(docs.num_rows), sizes)[kept], at[kept], x[kept]
    doc, at, tf = kept_entries(docs, known)
    of = doc if once is None else once[doc]
    return doc, at, tf / np.bincount(of, tf, docs.num_rows)[of] * (known["n_docs"].to_numpy() / known["df"].to_numpy())[at]


def _sent(columns: list[str]):
    """The values of one (tag, bucket) to every shard that holds some of its terms, as one row a shard."""
    schema = pa.schema([("tag", pa.string()), ("shard", pa.int32()), ("names", pa.binary()), ("numbers", pa.list_(pa.binary()))])

    def send(shards: pa.Table, values: pa.Table) -> pa.Table:
        if not shards.num_rows or not values.num_rows:
            return schema.empty_table()
        terms = values["term"].combine_chunks()
        numbers = [values[c].to_numpy().astype(NUMBERS[c]) for c in columns]
        shard, names, sent = [], [], []
        for k in range(shards.num_rows):
            at = pc.index_in(decoded(shards["held"].slice(k, 1))[1], value_set=terms).drop_null()
            if len(at):
                rows = at.to_numpy(zero_copy_only=False)
                shard.append(shards["shard"][k].as_py())
                names.append(encoded(np.array([len(rows)]), terms.take(at), [])[0].as_py())
                sent.append([squeezed(n[rows]) for n in numbers])
        return pa.table([[values["tag"][0].as_py()] * len(shard), shard, names, sent], schema=schema)

    return send


#: Numbers that travel to the shards, and as what.
NUMBERS = {"df": np.int64, "n_docs": np.int64, "term_id": np.int64, "w": np.float64}


def opened(known: pa.Table) -> pa.Table:
    """One row per term of what ``to_shards`` sent to a shard."""
    if "names" not in known.column_names:
        return known
    terms = decoded(known["names"], 0)[1]
    sent = known["numbers"].to_pylist()
    kinds = [NUMBERS[c] for c in known["columns"][0].as_py()]
    parts = [np.concatenate([array_of(row[j], kind) for row in sent]) for j, kind in enumerate(kinds)]
    return pa.table([terms, *map(pa.array, parts)], names=["term", *known["columns"][0].as_py()])


def to_shards(weighted: Weighted, documents: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of ``values`` (tag, term, ...) that each shard holds, with the shard; ``opened`` reads them there.
    Values of known buckets travel compressed, all of a bucket in one row."""
    if weighted.shards is not None:
        columns = [c for c in values.columns if c in NUMBERS]
        sent = weighted.shards.groupBy("tag", "bucket").cogroup(values.groupBy("tag", "bucket")).applyInArrow(
            _sent(columns), "tag string, shard int, names binary, numbers array<binary>"
        )
        moved = sent.withColumn("columns", F.array(*map(F.lit, columns))).repartition(weighted.partitions, "tag", "shard")
    else:
        need = documents.select("tag", "shard", F.explode("terms").alias("term")).distinct()
        moved = need.join(values, ["tag", "term"]).repartition("tag", "shard")
    return moved.select(*[F.col(c).alias(c) for c in moved.columns])  # columns apart from those of ``documents``


def _vectors(docs: pa.Table, known: pa.Table) -> pa.Table:
    schema = pa.schema([
        ("tag", pa.string()), ("shard", pa.int32()), ("q_id", docs.schema.field("q_id").type), ("vec", pa.binary()),
    ])
    if not docs.num_rows or not known.num_rows:
        return schema.empty_table()
    known = opened(known)
    doc, at, tf = kept_entries(docs, known)
    sizes = np.bincount(doc, minlength=docs.num_rows)
    terms = known["term"].combine_chunks().take(pa.array(at))
    vec = encoded(sizes, terms, [tf, known["df"].to_numpy()[at]], known["n_docs"][0].as_py())
    return docs.select(["tag", "shard", "q_id"]).append_column("vec", vec).filter(pa.array(sizes > 0)).cast(schema)


def vector_entries(vecs: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Sizes, concatenated terms and x of compact vectors."""
    sizes, terms, (tf, df), n_docs = decoded(vecs, 2)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return sizes, terms, tf / np.bincount(doc, tf, len(sizes))[doc] * (n_docs[doc] / df)


def compact_vectors(weighted: Weighted) -> DataFrame:
    """The vectors of distinct members as one row per document, (tag, shard, q_id, vec), clustered on (tag, shard). ``vec`` holds
    terms, tf and df compressed, of which x is made where it is needed."""
    documents = weighted.documents.select("tag", "shard", "q_id", "doc")
    known = to_shards(weighted, documents, weighted.values())
    kind = documents.schema["q_id"].dataType.simpleString()
    packed = documents.groupBy("tag", "shard").cogroup(known.groupBy("tag", "shard")).applyInArrow(
        _vectors, f"tag string, shard int, q_id {kind}, vec binary"
    )
    return packed.repartition(weighted.partitions, "tag", "shard")


def _arrays(batches):
    for rows in slices(batches):
        sizes, terms, x = vector_entries(rows["vec"])
        first = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        yield from rows.select(["tag", "shard", "q_id"]).append_column("terms", pa.ListArray.from_arrays(first, terms)).append_column(
            "xs", pa.ListArray.from_arrays(first, pa.array(x))
        ).to_batches()


def vectors(weighted: Weighted) -> DataFrame:
    """``compact_vectors`` with terms and x as two arrays: (tag, shard, q_id, terms, xs)."""
    rows = compact_vectors(weighted)
    return rows.mapInArrow(_arrays, f"tag string, shard int, q_id {rows.schema['q_id'].dataType.simpleString()}, terms array<string>, xs array<double>")


def corpus_pairs(docs: DataFrame) -> DataFrame:
    """One pseudo-tag for the whole corpus, so clustering shares the code above (SET-3)."""
    return docs.select(F.lit("*").alias("tag"), "q_id").distinct()
