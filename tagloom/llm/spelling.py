"""Spelling variant grouping by pivotal grams.

``word_counts`` reads the words of whole texts and counts them. ``near_pairs`` joins words at edit distance one: the bigrams of a
word, each with its place, are ordered from rare to frequent; the first 2 * 1 + 1 of them, with all that are as rare as the last, are
its *prefix*, and two of them that share no letter its *pivots*, chosen by dynamic programming so that they are rarest together. One
edit spoils at most one of two disjoint bigrams. So of two near words, the one whose prefix ends at the rarer bigram keeps a pivot
in the other's bigrams, and as that pivot is not more frequent than the end of the other's prefix, it lies in that prefix.
Pivots are looked up in prefixes by equality of (bigram, place, word length): an edit leaves a bigram at its place or, if the lengths
differ, moves it by that one letter, which makes five lookups a pivot. Pairs are then verified by edit distance.

``variants`` names for each word its near word of largest count, if that is at least ``RATIO`` times its own, and follows these to
the last. Counts grow by that factor at every step, so ways are short; they are halved by joining the table with itself.

Scale: words are counted within tasks before the shuffle; all after that are narrow rows of distinct words. Pairs are verified inside
the join, so false candidates are no rows. A bigram at one place in words of one length that many words share is a hot key: its
prefix rows are dealt over ``CELL``-sized cells by a hash, and pivot rows are copied to the cells of their key, so no task gets it whole.

Edge cases: a null text has no words; a null id counts as an empty string; repeated rows count each time; ties of count take the
smaller word in code-point order; an empty table, or no frequent word, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import small
from tagloom.session import stage

#: Letters in lower-cased UTF-8: a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
SLIP = 199  # one occurrence in so many loses a letter
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Distinct words that a task counts before it passes the sums on.
HELD = 200_000
#: Prefix rows of one key that a task meets, about.
CELL = 4096


def slipped(run: bytes, h: int) -> bytes:
    """``run`` without its code point number h % length."""
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the frequent words of all texts, after the slips that crc32 of id and run decides."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            words = pa.array(held.keys(), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in small(iter([batch])):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    data = text.as_py().encode("utf-8", "surrogatepass").lower()
                    seed = zlib.crc32(f"{doc_id}:".encode())
                    for run, times in Counter(RUN.findall(data)).items():
                        h = zlib.crc32(run, seed)
                        held[run if h % slip else slipped(run, h)] += times
                if len(held) > HELD:
                    yield passed()
                    held.clear()
        yield passed()

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counted = docs.where("text IS NOT NULL").select(key.alias("doc_id"), "text").mapInArrow(read, "word string, n long")
    long_enough = counted.where(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def two_rarest(prefix: list[tuple[int, int]], weight: list[int]) -> tuple[int, int]:
    """Places in ``prefix`` of two disjoint bigrams of least total weight; ``prefix``: (place, rank), by place.

    One pass: ``before`` is the rarest of all but the previous bigram, the only one that may touch the next.
    """
    before = last = None
    best = (float("inf"), 0, 0)
    for k, (place, rank) in enumerate(prefix):
        free = before
        if last is not None and prefix[last][0] <= place - 2 and (before is None or weight[prefix[last][1]] < weight[prefix[before][1]]):
            free = last
        if free is not None:
            best = min(best, (weight[prefix[free][1]] + weight[rank], free, k))
        if last is not None and (before is None or weight[prefix[last][1]] < weight[prefix[before][1]]):
            before = last
        last = k
    return best[1], best[2]


def key_of(rank: int, place: int, length: int) -> int:
    """A bigram's rank, its place and the word's length in one long; beyond 2^24 letters two keys may be alike, which adds candidates."""
    return rank << 48 | (place & 0xFFFFFF) << 24 | (length & 0xFFFFFF)


def ends(counts: DataFrame) -> DataFrame:
    """(key, pivot, word, n, last): the prefix rows of every word, and its pivots under each key where a near word may hold them.

    All tasks share the ranks of bigrams: at most 90 * 90 of them, as runs have 90 letters.
    """
    places = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda p: F.substring(F.col("word"), p, 2))
    grams = counts.select(F.explode(places).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c")).orderBy("c", "g").collect()
    rank, weight = {r.g: k for k, r in enumerate(grams)}, [r.c for r in grams]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pivot, row, lasts = [], [], [], []

            def add(at: int, is_pivot: bool, last: int, *found: int) -> None:
                keys.extend(found)
                row.extend([at] * len(found)), pivot.extend([is_pivot] * len(found)), lasts.extend([last] * len(found))

            for at, word in enumerate(batch.column(0).to_pylist()):
                size = len(word)
                order = sorted((rank[word[p : p + 2]], p) for p in range(size - 1))
                last = order[2][0]  # one edit: 2 * 1 + 1 bigrams
                prefix = sorted((p, r) for r, p in order if r <= last)
                add(at, False, last, *[key_of(r, p, size) for p, r in prefix])
                for k in two_rarest(prefix, weight):
                    p, r = prefix[k]
                    add(at, True, last, key_of(r, p, size), key_of(r, p, size + 1), key_of(r, p + 1, size + 1),
                        key_of(r, p, size - 1), *([key_of(r, p - 1, size - 1)] if p else []))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(pivot, pa.bool_()), batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(lasts, pa.int32())], names=["key", "pivot", "word", "n", "last"],
            )

    return counts.select("word", "n").mapInArrow(read, "key long, pivot boolean, word string, n long, last int")


def near_pairs(counts: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, n_a, b, n_b): every two words of ``counts(word, n)`` at edit distance one, once, with a before b. Words have four letters or more
    of the 90 of a run."""
    rows = stage(ends(counts))
    prefix, pivots = rows.where("NOT pivot"), rows.where("pivot")
    # keys with more rows than a cell holds; there are at most rows / cell of them
    hot = stage(prefix.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > cell)
                .select("key", F.ceil(F.col("c") / cell).cast("int").alias("cells")))
    cells = F.coalesce("cells", F.lit(1))
    x = prefix.join(hot, "key", "left").select(
        "key", F.pmod(F.xxhash64("word"), cells).cast("int").alias("cell"),
        F.col("word").alias("x"), F.col("n").alias("n_x"), F.col("last").alias("last_x"),
    )
    y = pivots.join(hot, "key", "left").select(
        "key", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"),
        F.col("word").alias("y"), F.col("n").alias("n_y"), F.col("last").alias("last_y"),
    )
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.cell") == F.col("r.cell"))
    near = F.expr("last_y <= last_x AND x <> y AND levenshtein(x, y, 1) = 1")
    found = y.alias("l").join(x.alias("r"), same & near)
    in_order = F.col("x") < F.col("y")

    def either(p: str, q: str, out: str) -> Column:
        return F.when(in_order, F.col(p)).otherwise(F.col(q)).alias(out)

    return found.select(either("x", "y", "a"), either("n_x", "n_y", "n_a"), either("y", "x", "b"), either("n_y", "n_x", "n_b")).distinct()


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``counts(word, n)``."""
    counts = stage(counts.select("word", "n"))
    pairs = stage(near_pairs(counts))
    both = pairs.union(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near"))).alias("best")
    )
    named = F.col("best")["less"] * -1 >= F.col("n") * ratio
    forms = stage(counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(named, F.col("best")["near"]).alias("form"), F.when(named, -F.col("best")["less"]).alias("form_n"),
    ))
    links = stage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # every round doubles the steps that a link spans
        onward = links.toDF("root", "_next")
        ahead = stage(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")))
        links = ahead.select("word", "root")
        if ahead.where("_on").isEmpty():
            return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(docs: DataFrame) -> DataFrame:
    return variants(word_counts(docs.select("doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")
