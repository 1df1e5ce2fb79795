"""ML-3..6: one linear classifier per tag, all tags in one plan.

Full-batch hinge subgradient, the update of the published SGD trainer with step 1.0 and
L2 0.01: in round i, w <- w * (1 - 0.01 / sqrt(i)) - g / sqrt(i), where
g = (1/n) * sum over {s * w.x < 1} of (-s * x), s = +1 / -1, n = all documents of the tag.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.features import Weighted, entries, kept_entries, opened, tag_sizes, to_shards
from tagloom.operators.sharding import keep_clustering
from tagloom.operators.terms import array_of, squeezed, vocabulary
from tagloom.session import filed, forget, release_shuffles, shuffle_partitions, stage

ROUNDS = 20
STEP = 1.0
REG = 0.01
ENTRIES_PER_TASK = 8_000_000  # about 100 MB of numbers and values
SHARDS_PER_UNIT = 16  # that get their weights together, once in a round; their blocks are read one after the other
PART_WEIGHTS = 16_384  # that travel as one row


def _factor(i: int) -> tuple[float, float]:
    eta = STEP / math.sqrt(i)
    return 1.0 - eta * REG, eta


def _block(weighted: bool):
    """The documents of one shard as one row of compressed numbers, which a round reads without decoding a term: sizes, signs and
    entries of the documents, and the terms of the shard, to which the entries refer. Of counts x is made again."""
    schema = pa.schema([("tag", pa.string()), ("shard", pa.int32()), ("block", pa.list_(pa.binary()))])

    def pack(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows or not known.num_rows:
            return schema.empty_table()
        known = opened(known)
        doc, at, value = entries(docs, known, True) if weighted else kept_entries(docs, known)
        sizes = np.bincount(doc, minlength=docs.num_rows)
        held, at = np.unique(known["term_id"].to_numpy()[at], return_inverse=True)
        order = np.lexsort((at, doc))
        at, value = at[order], value[order]
        # terms in order, so that their distances are small numbers
        numbers = [
            sizes.astype(np.int32), docs["sign"].to_numpy().astype(np.float64), np.diff(held, prepend=0).astype(np.int32),
            np.diff(at, prepend=0).astype(np.int32), value.astype(np.float64 if weighted else np.int32),
        ]
        if not weighted:
            by_id = np.argsort(known["term_id"].to_numpy())
            df = known["df"].to_numpy()[by_id[np.searchsorted(known["term_id"].to_numpy()[by_id], held)]]
            numbers += [df.astype(np.int32), known["n_docs"].to_numpy()[:1].astype(np.int64)]
        packed = [squeezed(n) for n in numbers]
        return pa.table([docs["tag"].slice(0, 1), docs["shard"].slice(0, 1), pa.array([packed], schema.field(2).type)], schema=schema)

    return pack


def _numbers(block: list[bytes]) -> tuple[np.ndarray, ...]:
    """Sizes and signs of the documents, the term numbers of the shard, place among these and x of every entry."""
    sizes, sign, held, at = (array_of(b, t) for b, t in zip(block, (np.int32, np.float64, np.int32, np.int32)))
    held, at = np.cumsum(held), np.cumsum(at, dtype=np.int32)
    if len(block) == 5:
        return sizes, sign, held, at, array_of(block[4], np.float64)
    tf, idf = array_of(block[4], np.int32), array_of(block[6], np.int64)[0] / array_of(block[5], np.int32)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return sizes, sign, held, at, tf / np.bincount(doc, tf, len(sizes))[doc] * idf[at]


def _add_push(block: tuple[np.ndarray, ...], w: np.ndarray, total: np.ndarray) -> None:
    """Add what the documents of a block push the weights by."""
    sizes, sign, held, at, x = block
    doc = np.repeat(np.arange(len(sizes)), sizes)
    margin = np.bincount(doc, x * w[held][at], len(sizes))
    push = np.where(sign * margin < 1.0, sign, 0.0)
    total[held] += np.bincount(at, x * push[doc], len(held))


def _train_in_task(rounds: int):
    """All rounds for one tag of bounded size: nothing has to leave the task."""
    schema = pa.schema([("tag", pa.string()), ("term_id", pa.int64()), ("w", pa.float64())])

    def fit(rows: pa.Table, meta: pa.Table) -> pa.Table:
        if not rows.num_rows or not meta.num_rows:
            return schema.empty_table()
        blocks = [_numbers(b.as_py()) for b in rows["block"]]
        n, w = meta["n_docs"][0].as_py(), np.zeros(meta["n_terms"][0].as_py())
        for i in range(1, rounds + 1):
            keep, eta = _factor(i)
            total = np.zeros(len(w))
            for b in blocks:
                _add_push(b, w, total)
            w = w * keep + eta / n * total
        return pa.table([pa.repeat(meta["tag"][0], len(w)), pa.array(np.arange(len(w))), pa.array(w)], schema=schema)

    return fit


PARTS = "tag string, part int, n_docs bigint, ws binary"
PARTS_SCHEMA = pa.schema([("tag", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("ws", pa.binary())])


def _push(rows: pa.Table, parts: pa.Table) -> pa.Table:
    """What the blocks of one unit add to the weights of their tag, in parts; no weights yet means zeros."""
    if not rows.num_rows or not parts.num_rows:
        return PARTS_SCHEMA.empty_table()
    w = np.zeros((parts.num_rows, PART_WEIGHTS))
    for part, ws in zip(parts["part"].to_pylist(), parts["ws"].to_pylist(), strict=True):
        if ws is not None:
            w[part] = np.frombuffer(ws)
    total = np.zeros(w.size)
    for b in rows["block"]:
        _add_push(_numbers(b.as_py()), w.ravel(), total)
    tag, n = rows["tag"][0].as_py(), len(w)
    return pa.table([[tag] * n, list(range(n)), [None] * n, [g.tobytes() for g in total.reshape(w.shape)]], schema=PARTS_SCHEMA)


def _moved(keep: float, eta: float):
    """The weights of one part after a round: its row of before has n_docs, the others are pushes."""

    def move(rows: pa.Table) -> pa.Table:
        w, total, n = np.zeros(PART_WEIGHTS), np.zeros(PART_WEIGHTS), None
        for n_docs, ws in zip(rows["n_docs"].to_pylist(), rows["ws"].to_pylist(), strict=True):
            if n_docs is None:
                total += np.frombuffer(ws)
            else:
                n, w = n_docs, w if ws is None else np.frombuffer(ws)
        moved = w * keep + eta / n * total
        return pa.table([[rows["tag"][0].as_py()], [rows["part"][0].as_py()], [n], [moved.tobytes()]], schema=PARTS_SCHEMA)

    return move


def _unpacked(batches):
    for batch in batches:
        for tag, part, ws in zip(batch["tag"], batch["part"], batch["ws"], strict=True):
            w = np.frombuffer(ws.as_py()) if ws.is_valid else np.zeros(PART_WEIGHTS)
            ids = part.as_py() * PART_WEIGHTS + np.arange(len(w))
            yield pa.RecordBatch.from_arrays([pa.array([tag.as_py()] * len(w), pa.string()), pa.array(ids), pa.array(w)], names=["tag", "term_id", "w"])


def _train_spread(blocks: DataFrame, meta: DataFrame, rounds: int, partitions: int) -> DataFrame:
    """Rounds for tags that one task cannot hold. The blocks are placed and sorted once; in a round the weights go to
    units of blocks in rows of ``PART_WEIGHTS``, and the sums of a unit come back in such rows."""
    blocks = blocks.withColumn("unit", F.expr(f"cast(shard div {SHARDS_PER_UNIT} as int)"))
    places = stage(blocks.select("tag", "unit").distinct())
    partitions = max(1, min(partitions, places.count()))  # empty tasks cost a round as much as full ones
    blocks = blocks.repartition(partitions, "tag", "unit").sortWithinPartitions("tag", "unit").persist()
    blocks.count()
    spark = blocks.sparkSession
    last = F.expr(f"cast((n_terms - 1) div {PART_WEIGHTS} as int)")
    weights = meta.select(
        "tag", F.explode(F.sequence(F.lit(0), last)).alias("part"), "n_docs", F.lit(None).cast("binary").alias("ws")
    )
    for i in range(1, rounds + 1):
        shipped = places.join(weights, "tag").select("tag", "unit", "part", "ws")
        push = blocks.groupBy("tag", "unit").cogroup(shipped.groupBy("tag", "unit")).applyInArrow(_push, PARTS)
        moved = filed(weights.unionByName(push).groupBy("tag", "part").applyInArrow(_moved(*_factor(i)), PARTS))
        # a round leaves nothing behind but the weights
        if i > 1:
            forget(weights)
        weights, shipped, push, moved = moved, None, None, None
        release_shuffles(spark)
    blocks.unpersist()
    return weights.mapInArrow(_unpacked, "tag string, term_id bigint, w double")


def _documents(weighted: Weighted) -> tuple[DataFrame, bool]:
    """Members with their compressed terms and counts, or with their terms and x where only the vectors are at hand."""
    if weighted.documents is not None:
        return weighted.documents, False
    packed = weighted.features.groupBy("tag", "shard", "q_id").agg(
        F.collect_list("term").alias("terms"), F.collect_list("x").alias("tfs")
    )
    return weighted.members.drop("n_docs").join(packed, ["tag", "shard", "q_id"]).repartition("tag", "shard"), True


def _content(ready: bool) -> list[str]:
    return ["terms", "tfs"] if ready else ["doc"]


def train(
    weighted: Weighted,
    split: Column | None = None,
    rounds: int = ROUNDS,
    entries_per_task: int = ENTRIES_PER_TASK,
    last: bool = False,
) -> DataFrame:
    """Weights (tag, term, w) of every tag in ``weighted``, whose members carry ``label``.

    ``split``, a condition on q_id, trains on a part of the documents; n is then the size of
    that part. The documents of a shard are packed once into one row of numbers. Tags with at most
    ``entries_per_task`` vector entries are brought together and trained inside a task; larger ones in
    rounds over the cluster, their blocks staying where they lie. Both use the same update and every document.
    ``last``: nothing reads the documents of ``weighted`` any more, so they are released once they are packed.
    """
    keep_clustering(weighted.idf.sparkSession)
    documents, ready = _documents(weighted)
    members = weighted.members
    if split is not None:
        members, documents = members.where(split), documents.where(split)
    # a term in df documents is df entries
    lengths = weighted.idf.groupBy("tag").agg(F.sum("df").alias("entries"), F.count(F.lit(1)).alias("n_terms"))
    meta = stage(tag_sizes(members).join(lengths, "tag"))
    numbers = filed(vocabulary(weighted.idf))
    known = to_shards(weighted, documents, weighted.values().join(numbers, ["tag", "term"]))
    signed = documents.select(
        "tag", "shard", (F.lit(2.0) * F.col("label") - F.lit(1.0)).alias("sign"), *_content(ready)
    )
    blocks = filed(
        signed.groupBy("tag", "shard").cogroup(known.groupBy("tag", "shard"))
        .applyInArrow(_block(ready), "tag string, shard int, block array<binary>")
    )
    spark, partitions = blocks.sparkSession, weighted.partitions
    if last:
        weighted.release()
    documents = signed = known = None
    release_shuffles(spark)
    in_task = F.col("entries") <= entries_per_task
    fitted = filed(
        blocks.join(meta.where(in_task).select("tag"), "tag", "left_semi").groupBy("tag")
        .cogroup(meta.where(in_task).groupBy("tag"))
        .applyInArrow(_train_in_task(rounds), "tag string, term_id bigint, w double")
    )
    large = meta.where(~in_task)
    if not large.isEmpty():
        spread = blocks.join(large.select("tag"), "tag", "left_semi")
        partitions = partitions or shuffle_partitions(spark)
        fitted = fitted.unionByName(_train_spread(spread, large, rounds, partitions))
    forget(blocks)
    release_shuffles(spark)
    # terms no training document holds have weight 0 but still count as kept terms
    return numbers.join(fitted, ["tag", "term_id"], "left").select(
        "tag", "term", F.coalesce("w", F.lit(0.0)).alias("w")
    )


def model_table(weights: DataFrame, idf: DataFrame) -> DataFrame:
    """D15: what scoring needs of a model, one row per (tag, term)."""
    return weights.join(idf.select("tag", "term", "idf"), ["tag", "term"])


def _margins(ready: bool, q_id: str):
    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        schema = pa.schema([("tag", pa.string()), ("q_id", docs.schema.field("q_id").type), ("margin", pa.float64())])
        if not docs.num_rows or not known.num_rows:
            return schema.empty_table()
        known = opened(known)
        doc, at, x = entries(docs, known, ready)
        margin = np.bincount(doc, x * known["w"].to_numpy()[at], docs.num_rows)
        # repeated members have one margin
        once = docs.select(["tag", "q_id"]).append_column("margin", pa.array(margin)).group_by(["tag", "q_id"]).aggregate([("margin", "max")])
        return once.rename_columns({"margin_max": "margin"}).select(schema.names).cast(schema)

    return score, f"tag string, q_id {q_id}, margin double"


def margins(weighted: Weighted, weights: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """AGG-9 on weighted documents: the raw score, 0.0 where no kept term occurs."""
    keep_clustering(weights.sparkSession)
    docs = weighted.members if members is None else members
    documents, ready = _documents(weighted)
    known = to_shards(weighted, documents, weighted.values().join(weights, ["tag", "term"]))
    scored = documents.select("tag", "shard", "q_id", *_content(ready)).groupBy("tag", "shard").cogroup(
        known.groupBy("tag", "shard")
    ).applyInArrow(*_margins(ready, documents.schema["q_id"].dataType.simpleString()))
    return docs.join(scored, ["tag", "q_id"], "left").withColumn(
        "margin", F.coalesce("margin", F.lit(0.0))
    )


def in_train_split(seed: int = 11) -> Column:
    """ML-5: 80/20 by a hash of the id, so a question's side depends on nothing else.

    The first eight hex digits of the digest, as text, are below 0.8 * 2^32.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("q_id").cast("string")))
    return F.substring(digest, 1, 8) < F.lit("cccccccc")


def accuracy(scored: DataFrame) -> DataFrame:
    """FLT-13, FLT-14, AGG-10: share of rows whose sign matches the label; margin 0 is class 0."""
    hit = (F.col("margin") > 0).cast("int") == F.col("label")
    return scored.groupBy("tag").agg(
        F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_test")
    )


def evaluate(weighted: Weighted, seed: int = 11, rounds: int = ROUNDS,
             entries_per_task: int = ENTRIES_PER_TASK) -> DataFrame:
    """ML-6: train on 80 %, report accuracy per tag on the rest. As in the original, idf comes
    from all documents, before the split."""
    split = in_train_split(seed)
    weights = train(weighted, split, rounds, entries_per_task)
    test = Weighted(
        weighted.members.where(~split), weighted.idf, weighted.features.where(~split),
        partitions=weighted.partitions, shards=weighted.shards, placed=weighted.placed,
        documents=None if weighted.documents is None else weighted.documents.where(~split),
    )
    return accuracy(margins(test, weights))
