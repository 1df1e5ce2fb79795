"""Benchmark decontamination with a distributed positional inverted index.

``build`` reads the training texts once and stores, sorted by term, the places of every word that a given set of items can ask for:
rows (term, texts, places), each of one bounded slice of texts, so that no list is a single row. ``exact`` finds the windows of
``WINDOW`` consecutive item words that occur in a text. The lists of a window's ``SEEDS`` rarest words come first, as lists of texts: only texts that hold all seeds
of some window go on. A place less the word's offset in the item is a *diagonal*, and lists are intersected by adding up, per (text, item, diagonal),
a bit for each offset that was met. Where all seeds of some window agree, the lists of its other words are read for the places that are
asked for, and a window occurs where its bits are all set. ``near`` finds windows whose rarest words lie close together though not in place: on diagonals
of one stretch [k * SLACK, (k + 2) * SLACK).

Scale: an item is cut into chunks of ``CHUNK`` windows, so a diagonal's bits fit one long and sums of bits are formed before every shuffle.
Index rows hold what one slice of about a megabyte has of one term; lists of frequent words are many rows in many files. A window with a word that
no text holds asks for nothing. Which texts and places to read in the later steps is told by masks of fixed size. What comes of the items alone is kept as files, so that Spark knows its size when it plans a join and the index
need not move; no side carries a broadcast hint. Texts are known by 64-bit
hashes, so a text that a third of all documents repeat is one key.

Edge cases: null texts and texts without words have no places, items without words no windows; items of fewer than ``WINDOW`` words are one
window; rows of one item_id are that item together; a null item_id hits words but is in no list or count. Repeated
documents get equal rows. Without items no document is hit; an empty table of documents gives no rows. The digest of no items
is that of an empty string. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import LOWER, SCAN_BYTES, Rolling, batched, filed, in_mask, mask_of, mix
from tagloom.session import stage

WINDOW, SEEDS, SLACK = 10, 3, 10
FREQUENT = 8  # times in a slice of texts
CHUNK = 63 - WINDOW  # windows of a chunk: its words fit the bits of a long beside the sign
IS_TERM = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])


def scan(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of ``column``: its first row, and row (from there), place and 64-bit hash of every word, ASCII letters lower-cased.
    Words are found in the UTF-8 bytes."""
    raw = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    every = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    for part in batched(np.diff(at).tolist(), SCAN_BYTES):
        edges = at[part.start : part.stop + 1]
        data = LOWER[every[edges[0] : edges[-1]]]
        begin = edges[:-1] - edges[0]
        inside = IS_TERM[data]
        # words end with their text
        first = inside & ~np.concatenate([[False], inside[:-1]])[: len(inside)]
        filled = begin[np.diff(edges) > 0]
        first[filled] = inside[filled]
        last = inside & ~np.concatenate([inside[1:], [False]])[: len(inside)]
        ends = (edges[1:] - edges[0])[np.diff(edges) > 0] - 1
        last[ends] = inside[ends]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        term = mix(Rolling(data).raw(start, end) + mix((end - start).astype(np.uint64)))
        row = np.searchsorted(begin, start, side="right") - 1
        # of equal beginnings the last is the text that is not empty
        words_before = np.searchsorted(start, begin)
        yield part.start, row, np.arange(len(start)) - words_before[row], term.view(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words) of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for base, row, _, _ in scan(batch.column(2)):
                found = np.bincount(row)
                n[base : base + len(found)] = found
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n)], names=["doc_id", "text_key", "n_words"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_words long")


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, unit, windows, span, at, term): the words of every chunk of an item at their offsets. ``unit`` names the chunk, ``span`` is the
    words of a window."""
    id_type = items.schema["item_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = batch.column(1).to_numpy().view(np.uint64)
            out = []  # row, unit, windows, span, words
            for base, row, place, term in scan(batch.column(2)):
                for r in np.unique(row):
                    words = term[row == r]
                    span = min(WINDOW, len(words))
                    for chunk in range(0, len(words) - span + 1, CHUNK):
                        held = min(CHUNK, len(words) - span + 1 - chunk)
                        unit = mix(item[base + r : base + r + 1] ^ mix(np.array([chunk], np.uint64)))
                        out.append((base + r, unit.view(np.int64)[0], held, span, words[chunk : chunk + held + span - 1]))
            size = [len(o[4]) for o in out]
            column = lambda k, kind: pa.array(np.repeat(np.array([o[k] for o in out], kind), size))
            at = np.concatenate([np.arange(n) for n in size] or [[]]).astype(np.int32)
            terms = np.concatenate([o[4] for o in out] or [[]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(column(0, np.int64)), column(1, np.int64), column(2, np.int32), column(3, np.int32), pa.array(at), pa.array(terms)],
                names=["item_id", "unit", "windows", "span", "at", "term"],
            )

    rows = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").dropDuplicates(["item"])
    return rows.mapInArrow(read, f"item_id {id_type}, unit long, windows int, span int, at int, term long")


def build(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The index, as a table in the shared folder: (term, texts, places), sorted by term. ``terms(term)`` bounds it to the words that
    will be asked for, and a few others; without it every word is stored."""
    mask = None if terms is None else mask_of(terms, "term")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for base, row, place, term in scan(batch.column(1)):
                if mask is not None:
                    asked = in_mask(mask, term)
                    row, place, term = row[asked], place[asked], term[asked]
                order = np.argsort(term, kind="stable")  # texts and places stay in order
                term = term[order]
                first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))[: len(term)]
                cuts = pa.array(np.append(first, len(term)).astype(np.int32))
                texts = pa.ListArray.from_arrays(cuts, pa.array(keys[base + row[order]]))
                places = pa.ListArray.from_arrays(cuts, pa.array(place[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(term[first]), texts, places], names=["term", "texts", "places"])

    rows = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("text_key"), "text")
    lists = rows.mapInArrow(read, "term long, texts array<long>, places array<int>")
    # lists of a term that a slice holds often are dealt over all files
    deal = F.when(F.size("places") > FREQUENT, F.xxhash64(F.col("texts")[0])).otherwise(F.lit(0))
    return filed(lists.repartition("term", deal).sortWithinPartitions("term"))


def bit(offset: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), offset)


def seeds(words: DataFrame, index: DataFrame, count: int = SEEDS) -> DataFrame:
    """(unit, seeds): for every chunk with a window that may occur, the bits of the ``count`` rarest words of each such window."""
    lengths = index.groupBy("term").agg(F.sum(F.size("places")).alias("n"))
    # words outside the index have no count; a window with one of them occurs nowhere
    held = words.join(lengths, "term").groupBy("unit").agg(
        F.first("windows").alias("windows"), F.first("span").alias("span"), F.collect_list(F.struct("n", "at")).alias("held")
    )

    def rarest(s: Column) -> Column:
        own = F.array_sort(F.filter("held", lambda h: (h["at"] >= s) & (h["at"] < s + F.col("span"))))
        bits = F.aggregate(F.slice(own, 1, count), F.lit(0).cast("long"), lambda b, h: b.bitwiseOR(bit(h["at"])))
        return F.when(F.size(own) == F.col("span"), bits)

    bits = F.filter(F.transform(F.sequence(F.lit(0), F.col("windows") - 1), rarest), lambda b: b.isNotNull())
    return held.select("unit", bits.alias("seeds")).where("size(seeds) > 0")


def agreeing(hits: DataFrame, asked: DataFrame, *place: str) -> DataFrame:
    """(text_key, unit, place) where all seeds of some window are met."""
    met = hits.groupBy("text_key", "unit", *place).agg(F.bit_or("hit").alias("hit")).join(asked, "unit")
    return met.where(F.exists("seeds", lambda s: F.col("hit").bitwiseAND(s) == s)).select("text_key", "unit", *place)


def spot(text_key, place):
    """A hash of a place in a text, of columns or arrays: both probes of a mask depend on both."""
    if isinstance(place, np.ndarray):
        return text_key ^ (place.astype(np.int64) << 7) ^ (place.astype(np.int64) << 29)
    place = place.cast("long")
    return text_key.bitwiseXOR(F.shiftleft(place, 7)).bitwiseXOR(F.shiftleft(place, 29))


def places_of(index: DataFrame, terms: DataFrame, mask: np.ndarray, of_place: bool) -> DataFrame:
    """(term, text_key, place) of the ``terms`` for texts, or ``spot``s of places, in the mask, and a few others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            text, place = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            held = in_mask(mask, spot(text, place) if of_place else text)
            term = np.repeat(batch.column(0).to_numpy(), size)[held]
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(text[held]), pa.array(place[held])], names=["term", "text_key", "place"])

    lists = index.join(terms.select("term").distinct(), "term", "left_semi").select("term", "texts", "places")
    return lists.mapInArrow(read, "term long, text_key long, place int")


def seed_hits(words: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """(text_key, unit, diagonal, hit): the places of seeds, on their diagonals, in texts that hold all seeds of some window anywhere."""
    of_window = F.aggregate("seeds", F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    wanted = words.join(asked.select("unit", of_window.alias("all")), "unit")
    wanted = filed(wanted.where(F.col("all").bitwiseAND(bit(F.col("at"))) != 0).select("unit", "at", "term"))
    hit = bit(F.col("at")).alias("hit")
    # a text counts once per list and slice
    lists = index.join(wanted, "term").select("unit", "at", F.explode(F.array_distinct("texts")).alias("text_key"))
    texts = stage(agreeing(lists.select("text_key", "unit", hit), asked))
    places = places_of(index, wanted, mask_of(texts, "text_key"), False)
    on = places.join(wanted, "term").join(texts, ["text_key", "unit"])
    return on.select("text_key", "unit", (F.col("place") - F.col("at")).alias("diagonal"), hit)


def exact(words: DataFrame, index: DataFrame, hits: DataFrame, asked: DataFrame) -> DataFrame:
    """(text_key, unit, diagonal, span, starts): bit s of ``starts``: window s of the chunk occurs in the text at place diagonal + s."""
    likely = agreeing(hits, asked, "diagonal")
    wanted = stage(likely.join(words, "unit").select(
        "text_key", "term", (F.col("diagonal") + F.col("at")).alias("place"), "unit", "diagonal", "windows", "span", "at"
    ))
    spots = mask_of(wanted.select(spot(F.col("text_key"), F.col("place")).alias("spot")), "spot")
    met = places_of(index, words, spots, True).distinct().join(wanted, ["term", "text_key", "place"])
    bits = met.groupBy("text_key", "unit", "diagonal").agg(
        F.bit_or(bit(F.col("at"))).alias("bits"), F.first("windows").alias("windows"), F.first("span").alias("span")
    )
    run = F.expr("shiftleft(1L, span) - 1")
    starts = F.aggregate(
        F.sequence(F.lit(0), F.col("windows") - 1), F.lit(0).cast("long"),
        lambda a, s: a.bitwiseOR(F.when(F.call_function("shiftright", F.col("bits"), s).bitwiseAND(run) == run, bit(s)).otherwise(F.lit(0).cast("long"))),
    )
    return bits.select("text_key", "unit", "diagonal", "span", starts.alias("starts")).where("starts <> 0")


def near(hits: DataFrame, asked: DataFrame, slack: int = SLACK) -> DataFrame:
    """(text_key, unit): texts where, for some k, the seeds of a window all lie on diagonals of [k * slack, (k + 2) * slack)."""
    k = F.floor(F.col("diagonal") / slack).cast("int")
    both = hits.select("text_key", "unit", F.explode(F.array(k, k - 1)).alias("k"), "hit")
    return agreeing(both, asked, "k").select("text_key", "unit").distinct()


def hit_words(found: DataFrame) -> DataFrame:
    """(text_key, n_hit): the words of a text that lie in some occurrence; ``found``: what ``exact`` returns."""
    # bit i: the word at diagonal + i is hit, for the at most 63 words of a chunk
    covered = F.expr("aggregate(sequence(0, span - 1), 0L, (a, i) -> a | shiftleft(starts, i))")
    # the bits of one diagonal fall into two words of 32 places' grid, held as longs
    at = F.col("diagonal")
    rows = found.select("text_key", at.alias("at"), covered.alias("bits"))
    lead = F.expr("pmod(at, 32)")
    word = F.expr("cast(floor(at / 32) as int)")
    low = F.lit(0xFFFFFFFF).cast("long")
    first, second = F.col("bits").bitwiseAND(low), F.expr("shiftrightunsigned(bits, 32)")
    a, b = F.call_function("shiftleft", first, lead), F.call_function("shiftleft", second, lead)
    cells = F.array(
        F.struct(word.alias("w"), a.bitwiseAND(low).alias("x")),
        F.struct((word + 1).alias("w"), F.expr("0L").bitwiseOR(F.call_function("shiftrightunsigned", a, F.lit(32))).bitwiseOR(b.bitwiseAND(low)).alias("x")),
        F.struct((word + 2).alias("w"), F.call_function("shiftrightunsigned", b, F.lit(32)).alias("x")),
    )
    cell = rows.select("text_key", F.explode(cells).alias("c")).select("text_key", "c.w", "c.x").where("x <> 0")
    return (
        cell.groupBy("text_key", "w").agg(F.bit_or("x").alias("x"))
        .groupBy("text_key").agg(F.sum(F.bit_count("x")).cast("long").alias("n_hit"))
    )


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items with a proximity match) of every document."""
    words = filed(item_words(items))
    index = build(docs, words.select("term").distinct())
    asked = filed(seeds(words, index))
    hits = stage(seed_hits(words, index, asked))
    found = stage(exact(words, index, hits, asked))
    ids = words.select("unit", "item_id").distinct()
    named = found.select("text_key", "unit").distinct().join(ids, "unit").select("text_key", "item_id").distinct()
    lists = named.groupBy("text_key").agg(
        F.count("item_id").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids")
    )
    close = near(hits, asked).join(ids, "unit").groupBy("text_key").agg(F.count_distinct("item_id").alias("n_near"))
    result = stage(hit_words(found).join(lists, "text_key", "full").join(close, "text_key", "full"))
    joined = F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ",")
    zero = F.lit(0).cast("long")
    return counted(docs).join(result, "text_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.encode(joined, "UTF-8"), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"),
    )
