"""ML-7..9, ML-12: k-means over long-form vectors (tag, shard, q_id, term, x).

``term`` may be any type: a word, or the index of a dense vector. Documents stay in their shards: a round sends each shard the
centroid rows of the terms it holds, multiplies there, and brings back per-shard sums. The start is k-means||: rounds of
distance-weighted oversampling, drawn by hashes of the ids, then a weighted reduction to k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tagloom.operators.features import vector_entries
from tagloom.operators.sharding import default_shards, hash_shard, task_count
from tagloom.operators.terms import flat as _flat
from tagloom.operators.terms import slices
from tagloom.session import filed, forget, release_shuffles, stage

MAX_ITER = 1000
TOL = 1e-6
RUNS = 3
#: Costs of two runs that differ by less, in parts of the cost, differ by rounding only: the first run stays.
SAME_COST = 1e-9
INIT_ROUNDS, OVERSAMPLING = 2, 2
#: Numbers of a product that a task holds at a time.
CELLS = 4_000_000
MAX_BROADCAST_IDS = 100_000
DOCS_PER_SHARD = 4_096  # of a corpus; every shard gets a copy of the centroid rows of its terms
DOCS_PER_SUM = 2_048  # whose entries are summed at a time


def dense_rows(vectors: DataFrame, id_col: str, vector_col: str, shards: int | None = None) -> DataFrame:
    """Dense arrays as long-form rows, one per dimension."""
    shard = hash_shard(id_col, shards or default_shards(vectors))
    return (
        vectors.select(F.col(id_col).alias("q_id"), shard.alias("shard"), F.col(vector_col).alias("_v"))
        .repartition("shard")
        .select("q_id", "shard", F.posexplode("_v").alias("term", "_x"))
        .select("shard", "q_id", "term", F.col("_x").cast("double").alias("x"))
    )


def _entries(docs: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Sizes, concatenated terms and x of packed documents: arrays, or compact vectors."""
    if "vec" in docs.column_names:
        return vector_entries(docs["vec"])
    size, terms = _flat(docs["terms"])
    return size, terms, _flat(docs["xs"])[1].to_numpy(zero_copy_only=False)


def _held_as(packed: DataFrame) -> list[str]:
    return ["vec"] if "vec" in packed.columns else ["terms", "xs"]


def _is_packed(features: DataFrame) -> bool:
    return "terms" in features.columns or "vec" in features.columns


def _cell_sums(cluster: np.ndarray, terms: pa.Array, x: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The sum of x of every (cluster, term)."""
    coded = terms.dictionary_encode()
    wide = max(1, len(coded.dictionary))
    cells, back = np.unique(cluster * wide + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    return cells // wide, coded.dictionary.take(pa.array(cells % wide)), np.bincount(back, x, len(cells))


def _group_sums(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, DOCS_PER_SUM):
            rows = pa.Table.from_batches([batch.slice(start, DOCS_PER_SUM)])
            size, terms, x = _entries(rows)
            many, of = _flat(rows["clusters"])
            own, code = np.unique(of.to_numpy(zero_copy_only=False), return_inverse=True)
            # the entries of a document once for each of its groups
            doc = np.repeat(np.arange(rows.num_rows), many)
            first = np.cumsum(size) - size
            entry = np.arange(size[doc].sum()) + np.repeat(first[doc] - (np.cumsum(size[doc]) - size[doc]), size[doc])
            cluster, term, s = _cell_sums(np.repeat(code, size[doc]), terms.take(pa.array(entry)), x[entry])
            yield pa.RecordBatch.from_arrays([pa.array(own[cluster], of.type), term, pa.array(s)], names=["cluster_id", "term", "s"])


def mean_vectors(features: DataFrame, groups: DataFrame) -> DataFrame:
    """Centroids (cluster_id, term, v) of ``groups`` (cluster_id, q_id): the mean over all
    members, absent terms counting as zero. Sums are formed map-side first. ``features`` may be packed."""
    sizes = groups.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    if _is_packed(features):
        of = groups.where("cluster_id IS NOT NULL").groupBy("q_id").agg(F.collect_list("cluster_id").alias("clusters"))
        kind = [groups.schema["cluster_id"].dataType.simpleString(), _term_type(features)]
        held = _held_as(features)
        partial = features.select("q_id", *held).join(of, "q_id").select("clusters", *held).mapInArrow(
            _group_sums, "cluster_id {}, term {}, s double".format(*kind)
        )
    else:
        partial = features.select("q_id", "term", "x").join(groups, "q_id").select("cluster_id", "term", F.col("x").alias("s"))
    sums = partial.groupBy("cluster_id", "term").agg(F.sum("s").alias("s"))
    return sums.join(sizes, "cluster_id").select(
        "cluster_id", "term", (F.col("s") / F.col("n")).alias("v")
    )


def _term_type(packed: DataFrame) -> str:
    return "string" if "vec" in packed.columns else packed.schema["terms"].dataType.elementType.simpleString()


def pack(features: DataFrame) -> DataFrame:
    """One row (tag, shard, q_id, terms, xs) per document, where its feature rows lie; packed rows stay as they are."""
    if _is_packed(features):
        return features
    place = [c for c in ("tag", "shard") if c in features.columns]
    return features.groupBy(*place, "q_id").agg(F.collect_list("term").alias("terms"), F.collect_list("x").alias("xs"))


def held_terms(packed: DataFrame) -> DataFrame:
    """The terms of each shard: (tag, shard, term)."""
    place = [c for c in ("tag", "shard") if c in packed.columns]
    if "vec" not in packed.columns:
        return packed.select(*place, F.explode("terms").alias("term")).distinct()

    def held(docs: pa.Table) -> pa.Table:
        found = vector_entries(docs["vec"])[1].unique()
        return pa.table([*[pa.repeat(docs[c][0], len(found)) for c in place], found], names=[*place, "term"])

    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in place)
    return packed.select(*place, "vec").groupBy(*place).applyInArrow(held, f"{kinds}, term string")


def _shipped(packed: DataFrame, centroids: DataFrame, need: DataFrame | None = None) -> DataFrame:
    """What each shard needs of the centroids: (tag, shard, term, ids, vs), and the norms under a null term.
    ``need``: ``held_terms(packed)``, if the caller keeps it."""
    place = [c for c in ("tag", "shard") if c in packed.columns]
    need = held_terms(packed) if need is None else need
    rows = centroids.groupBy("term").agg(F.collect_list("cluster_id").alias("ids"), F.collect_list("v").alias("vs"))
    norms = centroids.groupBy("cluster_id").agg(F.sum(F.col("v") * F.col("v")).alias("norm"))
    all_norms = norms.agg(F.struct(F.collect_list("cluster_id").alias("ids"), F.collect_list("norm").alias("vs"))).scalar()
    no_term = F.lit(None).cast(centroids.schema["term"].dataType).alias("term")
    shards = packed.select(*place).distinct().select(*place, no_term, all_norms.alias("_n"))
    both = need.join(rows, "term").select(*place, "term", "ids", "vs").unionByName(
        shards.select(*place, "term", "_n.ids", "_n.vs")
    )
    return both.select(*[F.col(c).alias(c) for c in both.columns])  # columns apart from those of ``packed``


def _nearest(docs: pa.Table, cents: pa.Table, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Cluster and squared distance of every row of ``docs``; row, term and x of every entry. Ties take the lower cluster."""
    bare = pc.is_null(cents["term"])
    _, ids = _flat(cents.filter(bare)["ids"])
    _, norms = _flat(cents.filter(bare)["vs"])
    order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
    ids, norms = ids.to_numpy(zero_copy_only=False)[order], norms.to_numpy(zero_copy_only=False)[order]
    known = cents.filter(pc.invert(bare))
    held, of = _flat(known["ids"])
    column = np.searchsorted(ids, of.to_numpy(zero_copy_only=False))
    line = np.repeat(np.arange(len(held)), held)
    value = _flat(known["vs"])[1].to_numpy(zero_copy_only=False)
    size, terms, x = _entries(docs)
    row = np.repeat(np.arange(docs.num_rows), size)
    # terms that no centroid holds meet an empty line at the end
    at = pc.index_in(terms, value_set=known["term"].combine_chunks()).fill_null(len(held)).to_numpy(zero_copy_only=False)
    best, index = np.full(docs.num_rows, np.inf), np.zeros(docs.num_rows, np.int64)
    square = np.bincount(row, x * x, docs.num_rows)
    first = np.concatenate([[0], np.cumsum(size)])
    wide = max(1, CELLS // (len(held) + 1))
    for low in range(0, len(ids), wide):
        high = min(low + wide, len(ids))
        mine = (column >= low) & (column < high)
        block = np.zeros((len(held) + 1, high - low))
        block[line[mine], column[mine] - low] = value[mine]
        step = max(1, CELLS // (high - low))
        start = 0
        while start < docs.num_rows:
            stop = max(start + 1, int(np.searchsorted(first, first[start] + step, side="right")) - 1)
            part = slice(first[start], first[stop])
            products = np.zeros((stop - start, high - low))
            if first[stop] > first[start]:
                some = np.flatnonzero(size[start:stop])
                products[some] = np.add.reduceat(x[part, None] * block[at[part]], first[start:stop][some] - first[start], axis=0)
            d = np.maximum(norms[low:high] - 2 * products + square[start:stop, None], 0)
            d = d if digits is None else np.round(d, digits)
            least = d.argmin(axis=1)
            d = d[np.arange(stop - start), least]
            better = d < best[start:stop]
            best[start:stop][better], index[start:stop][better] = d[better], least[better] + low
            start = stop
    return ids[index], best, row, terms, x


def nearest(
    packed: DataFrame, docs: DataFrame, centroids: DataFrame, digits: int | None = None, need: DataFrame | None = None
) -> DataFrame:
    """(q_id, cluster_id, d): the nearest centroid and its squared distance, of every document; ties take the lower id.

    ``docs`` names all documents, so those without any term are placed too: at the centroid of least norm.
    ``digits``: decimals to which distances are compared.
    """
    place = [c for c in ("tag", "shard") if c in packed.columns]
    kind = {c: packed.schema[c].dataType.simpleString() for c in ("q_id",)} | {"cluster_id": centroids.schema["cluster_id"].dataType.simpleString()}

    def product(rows: pa.Table, cents: pa.Table) -> pa.Table:
        schema = pa.schema([("q_id", rows.schema.field("q_id").type), ("cluster_id", cents.schema.field("ids").type.value_type), ("d", pa.float64())])
        if not rows.num_rows:
            return schema.empty_table()
        cluster, d, *_ = _nearest(rows, cents, digits)
        return pa.Table.from_arrays([rows["q_id"], pa.array(cluster, schema.field(1).type), pa.array(d)], schema=schema)

    placed = packed.groupBy(*place).cogroup(_shipped(packed, centroids, need).groupBy(*place)).applyInArrow(
        product, f"q_id {kind['q_id']}, cluster_id {kind['cluster_id']}, d double"
    )
    least = _least_norm(centroids, digits)
    return docs.select("q_id").join(placed, "q_id", "left").select(
        "q_id", F.coalesce("cluster_id", least["cluster_id"]).alias("cluster_id"), F.coalesce("d", least["norm"]).alias("d")
    )


def _least_norm(centroids: DataFrame, digits: int | None = None) -> Column:
    norm = F.sum(F.col("v") * F.col("v"))
    norms = centroids.groupBy("cluster_id").agg((norm if digits is None else F.round(norm, digits)).alias("norm"))
    return norms.agg(F.min(F.struct("norm", "cluster_id"))).scalar()


def assign(features: DataFrame, docs: DataFrame, centroids: DataFrame) -> DataFrame:
    """ML-8, ML-9: nearest centroid per document, (q_id, cluster_id)."""
    return nearest(pack(features), docs, centroids).select("q_id", "cluster_id")


def _step(
    packed: DataFrame, bare: DataFrame, centroids: DataFrame, need: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """One iteration, and the filed sums it is read from; ``bare``: ids of the documents without any term."""
    place = [c for c in ("tag", "shard") if c in packed.columns]
    term, cluster = centroids.schema["term"].dataType.simpleString(), centroids.schema["cluster_id"].dataType.simpleString()

    def sums(rows: pa.Table, cents: pa.Table) -> pa.Table:
        schema = pa.schema([("cluster_id", cents.schema.field("ids").type.value_type), ("term", cents.schema.field("term").type), ("s", pa.float64())])
        if not rows.num_rows:
            return schema.empty_table()
        near, _, row, terms, x = _nearest(rows, cents, None)
        own, which = np.unique(near, return_inverse=True)
        cell, named, s = _cell_sums(which[row], terms, x)
        cluster = np.concatenate([own[cell], own])
        named = pa.concat_arrays([named, pa.nulls(len(own), named.type)])
        # a null term stands for the number of documents
        return pa.Table.from_arrays([pa.array(cluster, schema.field(0).type), named, pa.array(np.concatenate([s, np.bincount(which)]))], schema=schema)

    partial = packed.groupBy(*place).cogroup(_shipped(packed, centroids, need).groupBy(*place)).applyInArrow(
        sums, f"cluster_id {cluster}, term {term}, s double"
    )
    rest = bare.select(_least_norm(centroids)["cluster_id"].alias("cluster_id"), F.lit(None).cast(term).alias("term"), F.lit(1.0).alias("s"))
    total = filed(partial.unionByName(rest).groupBy("cluster_id", "term").agg(F.sum("s").alias("s")))
    sizes = total.where("term IS NULL").select("cluster_id", F.col("s").alias("n"))
    moved = total.where("term IS NOT NULL").join(sizes, "cluster_id").select("cluster_id", "term", (F.col("s") / F.col("n")).alias("v"))
    empty = centroids.join(sizes, "cluster_id", "left_anti")
    return moved.unionByName(empty.select("cluster_id", "term", "v")), total


def lloyd_step(features: DataFrame, docs: DataFrame, centroids: DataFrame) -> DataFrame:
    """One iteration: assign, then the mean of each cluster. Empty clusters keep their centroid."""
    packed = pack(features)
    return _step(packed, docs.select("q_id").join(packed.select("q_id"), "q_id", "left_anti"), centroids)[0]


def shift(before: DataFrame, after: DataFrame) -> float:
    """The largest squared distance any centroid moved."""
    b = before.select("cluster_id", "term", F.col("v").alias("b"))
    a = after.select("cluster_id", "term", F.col("v").alias("a"))
    gap = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return (
        a.join(b, ["cluster_id", "term"], "full").groupBy("cluster_id")
        .agg(F.sum(gap * gap).alias("d")).agg(F.max("d")).first()[0] or 0.0
    )


def drawn(seed: int, round_: int) -> Column:
    """A number in [0, 1) for every q_id: the first eight hex digits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{round_}:"), F.col("q_id").cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _vector_rows(batches):
    for rows in slices(batches):
        size, terms, x = vector_entries(rows["vec"])
        of = rows["cluster_id"].take(pa.array(np.repeat(np.arange(len(size)), size)))
        yield from pa.table([of, terms, pa.array(x)], names=["cluster_id", "term", "v"]).to_batches()


def seeds(
    packed: DataFrame, docs: DataFrame, k: int, seed: int, rounds: int = INIT_ROUNDS, need: DataFrame | None = None
) -> DataFrame:
    """ML-7, the start: centroids of k documents found by k-means||.

    The first candidate is the document of least draw. In each round a document at squared distance d from the candidates so far
    becomes one if its draw is below ``OVERSAMPLING`` * k * d / (sum of d): about that many. The candidates, weighted by the
    documents nearest to them, are reduced to k: the heaviest first, then always the one of largest weight times squared distance to
    those chosen; equal ones by id. Fewer distinct documents give fewer centroids.
    """
    ids = packed.select("q_id")
    first = ids.orderBy(drawn(seed, 0), "q_id").limit(1)
    chosen, known = stage(first.select(F.lit(0).alias("cluster_id"), "q_id")), 1

    def vectors() -> DataFrame:
        # counted on the driver: no more than this is ever broadcast
        small = F.broadcast(chosen) if known <= MAX_BROADCAST_IDS else chosen
        if "vec" in packed.columns:
            kind = chosen.schema["cluster_id"].dataType.simpleString()
            return packed.select("q_id", "vec").join(small, "q_id").select("cluster_id", "vec").mapInArrow(
                _vector_rows, f"cluster_id {kind}, term string, v double"
            )
        rows = packed.select("q_id", F.explode(F.arrays_zip("terms", "xs")).alias("e")).join(small, "q_id")
        return rows.select("cluster_id", F.col("e.terms").alias("term"), F.col("e.xs").alias("v"))

    for r in range(1, rounds + 1):
        near = filed(vectors())
        far = stage(nearest(packed, ids, near, need=need))
        forget(near)
        release_shuffles(ids.sparkSession)
        total = far.agg(F.sum("d")).first()[0] or 0.0
        if total == 0:
            break
        u = drawn(seed, r)
        new = far.where(u * F.lit(total) < F.lit(float(OVERSAMPLING * k)) * F.col("d"))
        # about OVERSAMPLING * k rows
        number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(u, "q_id")) + F.lit(known - 1)
        chosen = stage(chosen.unionByName(new.select(number.alias("cluster_id"), "q_id")))
        known = chosen.count()
    candidates = filed(vectors())
    weight = nearest(packed, docs, candidates, digits=6, need=need).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("w"))
    rows = candidates.join(weight, "cluster_id", "left").select("cluster_id", "term", "v", F.coalesce("w", F.lit(0)).alias("w")).withColumn("all", F.lit(0))
    term = rows.schema["term"].dataType.simpleString()

    def reduce(table: pa.Table) -> pa.Table:
        old, which = np.unique(table["cluster_id"].to_numpy(), return_inverse=True)
        coded = table["term"].combine_chunks().dictionary_encode()
        coded = coded.indices.to_numpy(zero_copy_only=False)
        v = table["v"].to_numpy()
        w = np.zeros(len(old))
        w[which] = table["w"].to_numpy()
        square = np.bincount(which, v * v)
        least, taken = np.full(len(old), np.inf), []
        gain = w
        while len(taken) < k and gain.max() > 0:
            taken.append(int(gain.argmax()))
            one = np.zeros(coded.max() + 1)
            mine = which == taken[-1]
            one[coded[mine]] = v[mine]
            d = np.maximum(square + square[taken[-1]] - 2 * np.bincount(which, v * one[coded]), 0)
            least = np.minimum(least, np.round(d, 6))
            gain = w * least
        new = np.full(len(old), -1)
        new[taken] = np.arange(len(taken))
        keep = pa.array(new[which] >= 0)
        out = table.select(["term", "v"]).filter(keep)
        return out.add_column(0, "cluster_id", pa.array(new[which][new[which] >= 0].astype(np.int32)))

    # the candidates, whose number k bounds, in one task
    return rows.groupBy("all").applyInArrow(reduce, f"cluster_id int, term {term}, v double")


def to_vectors(features: DataFrame, docs: DataFrame, numbers: DataFrame, size: int) -> DataFrame:
    """ML-1, ML-2: one sparse vector per document, (q_id, features). ``numbers`` gives each term
    its index; documents without any term get an empty vector."""
    entries = features.join(numbers, "term").groupBy("q_id").agg(
        F.array_sort(F.collect_list(F.struct("term_id", "x"))).alias("e")
    )
    none = F.array().cast("array<struct<term_id:int,x:double>>")
    full = docs.select("q_id").join(entries, "q_id", "left").withColumn("e", F.coalesce("e", none))
    parts = F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"),
        F.col("e.term_id").alias("indices"), F.col("e.x").alias("values"),
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    parsed = F.from_json(F.to_json(F.struct(parts.alias("v"))), schema)
    return full.select("q_id", parsed["v"].alias("features"))


def fit(
    features: DataFrame,
    docs: DataFrame,
    k: int,
    max_iter: int = MAX_ITER,
    tol: float = TOL,
    runs: int = RUNS,
    seed: int = 1,
) -> DataFrame:
    """ML-7: k-means, the cheapest of ``runs`` starts, as centroids (cluster_id, term, v).

    Neither the vocabulary nor a dense centroid must fit the driver, and the documents are placed once for all rounds.
    ``features`` may be packed already; the caller then keeps and releases them.
    """
    given = _is_packed(features)
    packed = features if given else pack(features).persist()
    packed.count()
    # placed by term once; a round moves only what the centroids hold of it
    need = held_terms(packed).repartition(task_count(docs.sparkSession, docs.count()), "term").persist()
    need.count()
    bare = stage(docs.select("q_id").distinct().join(packed.select("q_id"), "q_id", "left_anti"))
    best, best_cost = None, float("inf")
    for run in range(runs):
        centroids = filed(seeds(packed, docs, k, seed + run, need=need))
        for _ in range(max_iter):
            step, total = _step(packed, bare, centroids, need)
            moved = filed(step)
            still = shift(centroids, moved) <= tol * tol
            # a round leaves nothing behind but its centroids
            forget(total)
            forget(centroids)
            centroids, step, total = moved, None, None
            release_shuffles(docs.sparkSession)
            if still:
                break
        if runs == 1:
            best = centroids
            break
        total = nearest(packed, docs, centroids, need=need).agg(F.sum("d")).first()[0] or 0.0
        if total < best_cost * (1 - SAME_COST):
            best, best_cost = centroids, total
    need.unpersist()
    if not given:
        packed.unpersist()
    return best


def cluster_tags(assignment: DataFrame, bridge: DataFrame) -> DataFrame:
    """ML-12, AGG-12: the distinct tags of the questions in each cluster."""
    return assignment.join(bridge, "q_id").select("cluster_id", "tag").distinct()


def cluster_sizes(assignment: DataFrame) -> DataFrame:
    """AGG-11."""
    return assignment.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_docs"))
