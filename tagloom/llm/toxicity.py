"""Toxicity: a factorization machine over hashed terms.

A text is the set of its distinct hashed words (lower case, outer punctuation cut). The score is the logistic of a bias, the
terms' own weights and the products of their latent vectors, so that a pair such as an insult and a group mention
can weigh more than its parts. Which terms take part is screened on the training rows by association with the
label, over all rows and again among the rows that hold a strongly associated term, so that terms which matter
only in company are kept.

Training sees at most ``TRAIN_ROWS`` labelled rows, those first by a hash of the id (the bound that
the fit is allowed), in one task. Every whole text is scored, map-side only.

Edge cases: null and empty texts have no terms and get the score of the bias; without labelled rows, or with one class only,
every score is the share of the class (0 without rows); different labels of one id count as rows of their own, equal ones once; repeated rows get equal scores;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import WordHashes, filed, small

TRAIN_ROWS = 30_000
BITS = 20
RANK, EPOCHS, RATE, PENALTY = 4, 25, 0.05, 1e-4
LEAST_DF, LEAST_Z, STRONG_Z = 5, 4.5, 8.0
TERM = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def terms(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashed terms of a text."""
    found = list(set(TERM.findall((text or "").lower())))
    return np.unique(hashes(found) >> np.uint64(64 - BITS)).astype("<u4")


def associated(ids: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """z value of the difference in document frequency between the classes, for every hashed term."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    df1 = np.bincount(ids, y[row], 1 << BITS)
    df0 = np.bincount(ids, 1.0 - y[row], 1 << BITS)
    p = (df1 + df0 + 1) / (n1 + n0 + 2)
    z = (df1 / n1 - df0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    z[df1 + df0 < LEAST_DF] = 0
    return z


class Machine:
    def __init__(self, kept: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.kept, self.bias, self.w, self.v = kept, bias, w, v

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.kept, found)
        at = at[(at < len(self.kept))]
        at = at[np.isin(self.kept[at], found)] if len(at) else at
        at = np.unique(at)
        v = self.v[at]
        margin = self.bias + self.w[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit(sets: list[np.ndarray], y: np.ndarray) -> Machine:
    y = y.astype(np.float64)
    ids = np.concatenate([np.zeros(0, np.uint32), *sets]).astype(np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    share = float(y.mean()) if len(y) else 0.0
    nothing = Machine(np.zeros(0, np.uint32), -30.0 if share == 0 else 30.0, np.zeros(0), np.zeros((0, RANK)))
    if share in (0.0, 1.0):
        return nothing
    z = associated(ids, row, y)
    strong = np.zeros(len(y), bool)
    strong[row[z[ids] > STRONG_Z]] = True
    keep = np.abs(z) > LEAST_Z
    if strong.any() and 0 < y[strong].sum() < strong.sum():
        inside = strong[row]
        number = np.cumsum(strong) - 1
        keep |= np.abs(associated(ids[inside], number[row[inside]], y[strong])) > LEAST_Z
    kept = np.flatnonzero(keep).astype(np.uint32)
    used = keep[ids]
    at, row = np.searchsorted(kept, ids[used]), row[used]
    rng = np.random.default_rng(5)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), RANK))
    gb, gw, gv = 1e-8, np.full(len(kept), 1e-8), np.full(v.shape, 1e-8)
    first = np.searchsorted(row, np.arange(len(y) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for chunk in np.array_split(order, max(1, len(y) // 256)):
            take = np.concatenate([np.zeros(0, np.int64), *[np.arange(first[r], first[r + 1]) for r in chunk]]).astype(np.int64)
            local = np.repeat(np.arange(len(chunk)), first[chunk + 1] - first[chunk])
            a = at[take]
            sums = np.zeros((len(chunk), RANK))
            np.add.at(sums, local, v[a])
            squares = np.bincount(local, (v[a] ** 2).sum(1), len(chunk))
            margin = bias + np.bincount(local, w[a], len(chunk)) + 0.5 * ((sums**2).sum(1) - squares)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[chunk]) / len(chunk)
            grad_w = np.bincount(a, slope[local], len(kept)) + PENALTY * w
            grad_v = PENALTY * v
            np.add.at(grad_v, a, slope[local][:, None] * (sums[local] - v[a]))
            gb, gw, gv = gb + slope.sum() ** 2, gw + grad_w**2, gv + grad_v**2
            bias -= RATE * slope.sum() / np.sqrt(gb)
            w -= RATE * grad_w / np.sqrt(gw)
            v -= RATE * grad_v / np.sqrt(gv)
    return Machine(kept, bias, w, v)


def train(docs: DataFrame, known: DataFrame) -> Machine:
    """From ``docs(doc_id, text)`` with ``known(doc_id, toxic)``. The ids are chosen on narrow columns and kept as files, whose size
    ``TRAIN_ROWS`` bounds, so that the texts are neither shuffled nor read by a join of all labels."""
    narrow = docs.select("doc_id").join(known, "doc_id").select("doc_id", "toxic", F.xxhash64("doc_id").alias("_h")).distinct()
    picked = filed(narrow.orderBy("_h", "doc_id", "toxic").limit(TRAIN_ROWS).select("doc_id", "toxic"))
    sample = docs.select("doc_id", "text").join(picked, "doc_id").select("toxic", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"y": batch["toxic"].astype("int32"), "t": [terms(t, hashes).tobytes() for t in batch["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"y": [], "t": []}), *batches]).sort_values(["y", "t"])
        m = fit([np.frombuffer(t, "<u4") for t in rows["t"]], rows["y"].to_numpy(np.float64))
        yield pd.DataFrame([(m.bias, *(a.tobytes() for a in (m.kept, m.w, m.v)))], columns=["bias", "kept", "w", "v"])

    made = (
        sample.mapInPandas(sets, "y int, t binary").repartition(1)
        .mapInPandas(learn, "bias double, kept binary, w binary, v binary").collect()
    )
    if not made:
        return fit([], np.zeros(0))
    r = made[0]
    return Machine(np.frombuffer(r.kept, np.uint32), r.bias, np.frombuffer(r.w), np.frombuffer(r.v).reshape(-1, RANK))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score and predicted of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            s = [machine.score(terms(t.as_py(), hashes)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {id_type}, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Learns from labelled rows outside ``held_out`` (a condition on doc_id) and scores all rows."""
    known = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    seen = docs.where(~F.coalesce(held_out, F.lit(True))).select("doc_id", "text")
    return score(docs, train(seen, known)).withColumn("held_out", F.coalesce(held_out, F.lit(True)))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
