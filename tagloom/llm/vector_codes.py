"""Vector code compression: product codes whose nearest entries are found by equal-average search.

A vector's integer components are cut into ``PARTS`` equal consecutive parts. Every part position has a codebook of at most
``ENTRIES`` entries, first taken from the vectors of smallest id, then moved ``ROUNDS`` times to the floored means of the parts
they are nearest to. The nearest entry of a part is searched in the order of component sums: by the Cauchy-Schwarz inequality
(sum x - sum c)^2 <= dim * |x - c|^2, so the search goes outward from the part's own sum, and a side ends when its squared gap over
the dimension strictly exceeds the best distance so far. Entries at an equal distance are so still seen; the lower index wins.

Scale: all tasks share the codebooks, ENTRIES x dimension integers whatever the number of vectors. A round reads the vectors, adds
up per task and sends (part, entry, component) sums; nothing else is shuffled. Sums of errors are formed per label before the
shuffle and then joined, so a label on a third of all rows is one row of the small side.

Edge cases: rows whose vector is null, empty or holds null, NaN or infinite components are dropped; so are vectors of another length
than that of the smallest kept id, and if that length is no multiple of ``PARTS``, there are no codes. Components beyond +-65,536 count as that bound,
so that distances fit a long. Repeated rows, and rows of one id, are separate rows (order of equal ids: by vector). A null id sorts last. Fewer than
``ENTRIES`` vectors make as many entries. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.session import stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 24  # of a component after scaling


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` without rows that have no usable vector."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)


def as_integers(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) scaled, floored components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(np.clip(flat * SCALE, -LARGEST, LARGEST))
    return scaled.astype(np.int64).reshape(-1, dim)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``entries`` for every row of ``x`` and the squared distance: equal-average search."""
    dim, count = entries.shape[1], len(entries)
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sorted_sums, own = sums[order], x.sum(axis=1)
    right = np.searchsorted(sorted_sums, own)
    left = right - 1
    best = np.full(len(x), np.iinfo(np.int64).max)
    index = np.full(len(x), count)

    def look(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Compares ``rows`` with the entries at sorted places ``at``; those whose side goes on."""
        inside = (at >= 0) & (at < count)
        rows, at = rows[inside], at[inside]
        gap = own[rows] - sorted_sums[at]
        # gap^2 / dim > best, without a division
        open_ = -(-gap * gap // dim) <= best[rows]
        rows, entry = rows[open_], order[at[open_]]
        d = x[rows] - entries[entry]
        d = np.einsum("ij,ij->i", d, d)
        better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], entry[better]
        return rows

    going_right = going_left = np.arange(len(x))
    step = 0
    while len(going_right) or len(going_left):
        going_right = look(going_right, right[going_right] + step)
        going_left = look(going_left, left[going_left] - step)
        step += 1
    return index, best


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) entry indexes and squared distances of whole vectors; ``books``: (parts, entries, width)."""
    width = books.shape[2]
    found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(len(books))]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def first_books(vectors: DataFrame, id_col: str, vector: str, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks of the ``entries`` vectors of smallest id: (parts, entries, width)."""
    least = kept(vectors, vector).select(id_col, F.col(vector).cast("array<double>").alias("v"))
    order = [F.asc_nulls_last(id_col), F.asc("v")]
    first = least.orderBy(*order).limit(1).select(F.size("v")).collect()
    if not first or first[0][0] % parts:
        return None
    dim = first[0][0]
    rows = least.where(F.size("v") == dim).orderBy(*order).limit(entries).collect()  # at most ``entries`` rows
    x = as_integers(pa.array([r.v for r in rows], pa.list_(pa.float64())), dim)
    return x.reshape(len(rows), parts, dim // parts).transpose(1, 0, 2).copy()


def moved(usable: DataFrame, vector: str, books: np.ndarray) -> np.ndarray:
    """``books`` after one round: entries become the floored means of their parts, unused ones stay."""
    parts, entries, width = books.shape
    dim = parts * width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = as_integers(batch.column(0), dim)
            codes, _ = encode(x, books)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in (np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)),
                                   sums[p, e].ravel(), np.repeat(counts[p, e], width))],
            names=["part", "entry", "at", "s", "n"],
        )

    partial = usable.select(vector).mapInArrow(add, "part long, entry long, at long, s long, n long")
    total = partial.groupBy("part", "entry", "at").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")
    )
    out = books.copy()
    for r in total.collect():  # at most as many rows as ``books`` has integers
        out[r.part, r.entry, r.at] = int(r.s) // r.n
    return out


def train(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width); None without a usable vector."""
    books = first_books(vectors, id_col, vector, parts, entries)
    if books is None:
        return None
    usable = kept(vectors, vector).where(F.size(vector) == books.shape[0] * books.shape[2])
    for _ in range(rounds):
        books = moved(usable, vector, books)
    return books


def codes(vectors: DataFrame, books: np.ndarray, carry: list[str], vector: str = "embedding") -> DataFrame:
    """The columns ``carry`` of every usable vector with ``code`` (array of entry indexes) and ``error``."""
    dim = books.shape[0] * books.shape[2]
    usable = kept(vectors, vector).where(F.size(vector) == dim).select(*carry, F.col(vector).alias("_v"))
    schema = usable.drop("_v").schema.add("code", T.ArrayType(T.IntegerType())).add("error", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, error = encode(as_integers(batch.column(len(carry)), dim), books)
            ends = np.arange(0, found.size + 1, len(books), dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carry)], lists, pa.array(error.sum(axis=1))], names=[*carry, "code", "error"]
            )

    return usable.mapInArrow(read, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    rows = embeddings.select("vec_id", "embedding", "label")
    books = train(rows)
    if books is None:
        none = rows.where("false")
        return none.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = codes(rows, books, ["vec_id", "label"])
    digits = F.concat_ws("", F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    coded = stage(coded.select("vec_id", F.struct("label").alias("l"), digits.alias("code"), "error"))
    # a struct key joins the missing label, too
    sums = coded.groupBy("l").agg(F.sum("error").alias("label_error"))
    return coded.join(sums, "l").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
