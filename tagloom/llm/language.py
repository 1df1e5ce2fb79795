"""Language ID by hierarchical discrimination: the family first, then pairs of close languages.

A text is lower-cased, everything but letters becomes a space, and the shares of its hashed two- and
three-character strings, square-rooted, are its features. Linear support vector machines (squared hinge) tell each
language family from the others; within the family that wins, one machine per pair of languages votes, ties going to
the larger sum of margins. A language without an entry in ``FAMILIES`` is a family of its own.

Training sees at most ``TRAIN_PER_LANG`` documents of each language, those first by a hash of the id
(the bound that the fit is allowed); it runs in one task on that sample. Every whole text is scored, map-side only.

Edge cases: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing could
be learned; rows with a null language are scored but not learned; with one learned language it is always
that one; repeated rows get equal results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import filed, small
from tagloom.operators.ranking import top_k

TRAIN_PER_LANG = 1000
HALF = 4096
STEPS, PENALTY = 150, 1e-4
UNKNOWN = "und"
FAMILIES = {
    "de": "germanic", "en": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sk": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "ar": "semitic", "he": "semitic",
    "hi": "indic", "bn": "indic", "ur": "indic", "tr": "turkic", "az": "turkic",
}


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Float vector of 2 * HALF shares, or None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes] if len(codes) else np.zeros(0, bool)
    if not letter.any():
        return None
    c = np.where(letter, codes, np.uint32(32))
    c = np.concatenate([np.array([32], np.uint32), c, np.array([32, 32], np.uint32)])
    inside = np.concatenate([[False], letter, [False, False]])
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    real2, real3 = inside[:-1] | inside[1:], inside[:-2] | inside[1:-1] | inside[2:]
    out = np.empty(2 * HALF, np.float32)
    for k, (h, real) in enumerate(((two, real2), (three, real3))):
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
        counts = np.bincount(h[real], minlength=HALF)
        out[k * HALF : (k + 1) * HALF] = np.sqrt(counts / counts.sum())
    return out


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of a squared-hinge machine; ``y`` is +1 or -1, classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = z = np.zeros(x.shape[1], np.float32)
    step = 1.0 / (2 * 3.0 + PENALTY)  # rows have squared length 3
    for k in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (PENALTY * z - 2 * x.T @ (weight * y * slack))
        z, w = new + k / (k + 3) * (new - w), new
    return w.astype(np.float32)


def fit(x: np.ndarray, langs: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
    """(positive, negative, weights): families against the rest ('' as negative), then pairs of languages."""
    names = sorted(set(langs))
    family = {n: FAMILIES.get(n, n) for n in names}
    groups, out = sorted(set(family.values())), []
    own = np.array([family[n] for n in langs])
    if len(groups) > 1:
        out += [(g, "", fit_machine(x, np.where(own == g, 1, -1).astype(np.float32))) for g in groups]
    for a, b in combinations(names, 2):
        if family[a] == family[b]:
            pair = (langs == a) | (langs == b)
            out.append((a, b, fit_machine(x[pair], np.where(langs[pair] == a, 1, -1).astype(np.float32))))
    return out


def train(labelled: DataFrame) -> tuple[list[str], list[tuple[str, str, np.ndarray]]]:
    """The learned languages and machines from ``labelled(doc_id, text, lang)``; null languages are left out."""
    rows = labelled.where("lang IS NOT NULL")
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h")).distinct()
    # kept as files of known, bounded size, so that the texts need no shuffle
    picked = filed(top_k(ids, ["lang"], [F.col("_h"), F.col("doc_id")], TRAIN_PER_LANG).select("doc_id", "lang"))
    sample = rows.join(picked, ["doc_id", "lang"], "left_semi").select("lang", "text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(lang, v) for lang, text in zip(batch["lang"], batch["text"]) if (v := features(text)) is not None]
            yield pd.DataFrame([(lang, v.astype("<f2").tobytes()) for lang, v in made], columns=["lang", "v"])

    def machines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["lang", "v"]), *batches]).sort_values(["lang", "v"])
        langs = rows["lang"].to_numpy(dtype=str)
        x = np.frombuffer(b"".join(rows["v"]), "<f2").astype(np.float32).reshape(len(rows), 2 * HALF)
        found = [(a, b, w.tobytes()) for a, b, w in fit(x, langs)]
        yield pd.DataFrame([(n, None, None) for n in sorted(set(langs))] + found, columns=["a", "b", "w"])

    made = (
        sample.mapInPandas(vectors, "lang string, v binary").repartition(1)
        .mapInPandas(machines, "a string, b string, w binary").collect()
    )
    return [r.a for r in made if r.w is None], [(r.a, r.b, np.frombuffer(r.w, np.float32)) for r in made if r.w]


def decide(margins: np.ndarray, names: list[str], machines: list[tuple[str, str]]) -> tuple[str, float]:
    """Language and score: the logistic of the smallest margin that the decision rests on."""
    family = {n: FAMILIES.get(n, n) for n in names}
    least, groups = 4.0, sorted(set(family.values()))
    won = groups[0]
    if len(groups) > 1:
        at = {a: m for (a, b), m in zip(machines, margins) if b == ""}
        won = max(groups, key=lambda g: (at[g], g))
        least = min(least, float(at[won]))
    votes = {n: [0, 0.0] for n in names if family[n] == won}
    against: dict[str, float] = {}
    for (a, b), m in zip(machines, margins):
        if b and a in votes and b in votes:
            for name, own in ((a, float(m)), (b, -float(m))):
                votes[name][0] += own > 0
                votes[name][1] += own
                against[name] = min(against.get(name, 4.0), own)
    best = max(votes, key=lambda n: (*votes[n], n))
    return best, float(1 / (1 + np.exp(-2 * min(least, against.get(best, 4.0)))))


def predict(docs: DataFrame, names: list[str], machines: list[tuple[str, str, np.ndarray]]) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    kinds = [(a, b) for a, b, _ in machines]
    weights = np.stack([w for _, _, w in machines], 1) if machines else np.zeros((2 * HALF + 1, 0), np.float32)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            said = []
            for text in batch.column(1):
                v = features(text.as_py()) if names else None
                said.append((UNKNOWN, 0.0) if v is None else decide(v @ weights[:-1] + weights[-1], names, kinds))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learns from the rows outside ``held_out`` (a condition on doc_id) and scores all rows."""
    names, machines = train(docs.where(~F.coalesce(held_out, F.lit(True))).select("doc_id", "text", "lang"))
    return predict(docs, names, machines).withColumn("held_out", F.coalesce(held_out, F.lit(True)))


def query(docs: DataFrame) -> DataFrame:
    return identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
