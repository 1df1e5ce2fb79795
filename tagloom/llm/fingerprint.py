"""Order MinHash fingerprints, with built-in functions only.

The k-mers of a text are the runs of ``K`` words (fewer in a shorter text; the text itself, hashed, if it has no
word), each numbered by its occurrence in the text, so that repeats count. Under each of ``ORDERS`` random
orders, numbered k-mers fall into ``KEPT`` classes; the least of every class is selected, the selected
ones are put back into text order, and the tuple is hashed. Two texts share a value if the same k-mers are selected *in the
same order*, so swaps and moves count as edits, unlike with plain minima. The likeness of two
fingerprints grows with the share of equal values.

Taking the least of ``KEPT`` disjoint classes, instead of the ``KEPT`` least of one set, is what lets a plain
``min`` per (order, class), summed before any shuffle, do the selection; both are samples of ``KEPT``
numbered k-mers without replacement.

Texts are laid out by doc_id once; occurrence numbers, minima and the edited text all use that layout. A text of any length
is a run of rows, never one array of its k-mers.

Edge cases: null texts are empty; an empty text has the fingerprint of zero k-mers, equal only to that of another empty
text; a repeated doc_id is a document of its own (ties follow the text's hash); a lone document is its own next; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import numbered, words
from tagloom.session import shuffle_partitions, stage

K = 3
ORDERS = 40
KEPT = 2
#: A packed long: high bits of the k-mer's hash under an order, low bits its position.
POSITION_BITS = 28
#: Partitions of the text layout for every shuffle partition.
FINER = 4


def minima(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows(by.., text)`` -> by.. and the packed least k-mer m_j_c of every order j and class c.

    Nothing moves if ``rows`` lies partitioned by some of ``by``.
    """
    found = rows.select(*by, "text", words(F.col("text")).alias("w"))
    own = F.when(F.size("w") > 0, F.col("w")).when(F.length("text") > 0, F.array("text")).otherwise(F.array())
    hashes = found.select(*by, F.transform(own, lambda x: F.xxhash64(x)).alias("tokens"))
    gram = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("tokens") - K, F.lit(0))),
        lambda i: F.xxhash64(*[F.coalesce(F.get(F.col("tokens"), i + j), F.lit(0)) for j in range(K)]),
    )
    each = hashes.where(F.size("tokens") > 0).select(*by, F.posexplode(gram).alias("pos", "g"))
    number = F.row_number().over(Window.partitionBy(*by, "g").orderBy("pos"))
    each = each.select(*by, "pos", F.xxhash64("g", number).alias("g"))
    packed = [
        F.xxhash64("g", F.lit(j)).bitwiseAND(F.lit(-(1 << POSITION_BITS))).bitwiseOR(F.col("pos").cast("bigint"))
        for j in range(ORDERS)
    ]
    each = each.select(*by, "g", *[p.alias(f"p_{j}") for j, p in enumerate(packed)])
    least = []
    for j in range(ORDERS):
        side = F.col("g").bitwiseAND(F.lit(1 << j))
        least += [F.min(F.when(side == 0, F.col(f"p_{j}"))).alias(f"m_{j}_0"),
                  F.min(F.when(side != 0, F.col(f"p_{j}"))).alias(f"m_{j}_1")]
    return each.groupBy(*by).agg(*least)


def value(j: int) -> Column:
    """The hashed tuple of order ``j``: the selected k-mers in text order."""
    low = F.lit((1 << POSITION_BITS) - 1)
    a, b = F.col(f"m_{j}_0"), F.col(f"m_{j}_1")
    first = F.coalesce(a.bitwiseAND(low) <= b.bitwiseAND(low), F.lit(True))
    a, b = F.shiftright(a, POSITION_BITS), F.shiftright(b, POSITION_BITS)
    return F.hash(F.when(first, a).otherwise(b), F.when(first, b).otherwise(a))


def signatures(rows: DataFrame, by: list[str]) -> DataFrame:
    """by.. and signature, an array of ``ORDERS`` integers; texts without a k-mer have no row."""
    return minima(rows, by).select(*by, F.array(*[value(j) for j in range(ORDERS)]).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """The ``KEPT``-th root of the share of equal values, since a value needs all its k-mers to be shared; two empty
    texts are alike, an empty and a full one are not."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).otherwise(F.coalesce(F.pow(same / F.lit(float(ORDERS)), F.lit(1.0 / KEPT)), F.lit(0.0)))


def shown(signature: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""), F.lit(""))


def neighbours(docs: DataFrame) -> DataFrame:
    """Narrow rows doc_id, n_chars, n and, of the document that has this one as its next by descending doc_id,
    for_n, for_chars; both with the layout keys i, h (hashes of id and text) and k, which tells equal rows apart.
    n numbers all rows by ascending doc_id."""
    text = F.coalesce("text", F.lit(""))
    ids = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("h"))
    order = numbered(ids, ["doc_id", "h"], "n").withColumn("i", F.xxhash64("doc_id"))
    order = stage(order.withColumn("k", F.row_number().over(Window.partitionBy("i", "h").orderBy("n"))))
    total = max(1, order.count())
    above = order.select(
        F.pmod(F.col("n") - 1, F.lit(total)).alias("n"), F.col("i").alias("for_i"), F.col("h").alias("for_h"),
        F.col("n").alias("for_n"), F.col("n_chars").alias("for_chars"),
    )
    return order.join(above, "n")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, and that of its text with the last half replaced by the start of the next one's."""
    text = F.coalesce("text", F.lit(""))
    place = Window.partitionBy("i", "h").orderBy(F.lit(0))
    laid = docs.select(text.alias("text"), F.xxhash64("doc_id").alias("i"), F.xxhash64(text).alias("h"))
    # every task sorts about three times its share of words a text byte, so shares are smaller than usual
    parts = FINER * shuffle_partitions(docs.sparkSession)
    laid = laid.repartition(parts, "i", "h").withColumn("at", F.row_number().over(place))
    # what is no part of the layout is compared by two inequalities, so that (i, h) serves every join as it is
    here = laid.join(stage(neighbours(docs)), ["i", "h"]).where("at <= k AND at >= k").drop("at", "k")
    heads = here.select(
        F.col("for_i").alias("i"), F.col("for_h").alias("h"), F.col("for_n").alias("of_n"),
        F.expr("left(text, int(for_chars div 2))").alias("head"),
    )
    both = here.join(heads, ["i", "h"]).where("n <= of_n AND n >= of_n")
    edited = F.concat(F.expr("left(text, int(n_chars - n_chars div 2))"), "head")
    both = both.select("i", "h", "n", "doc_id", "n_chars", "text", edited.alias("new_text"))
    by = ["i", "h", "n", "edited"]
    versions = both.select("i", "h", "n", F.posexplode(F.array("text", "new_text")).alias("edited", "text"))
    signed = signatures(versions, by).groupBy("i", "h", "n").agg(
        F.max(F.when(F.col("edited") == 0, F.col("signature"))).alias("own"),
        F.max(F.when(F.col("edited") == 1, F.col("signature"))).alias("changed"),
    ).withColumnRenamed("n", "of_n")
    sha = F.sha2(F.encode("new_text", "UTF-8"), 256).alias("edited_sha256")
    # one job for both, so that it reads one shuffle of the texts
    done = stage(
        both.select("i", "h", "n", "doc_id", "n_chars", sha)
        .join(signed, (both["i"] == signed["i"]) & (both["h"] == signed["h"]) & (F.col("n") <= F.col("of_n")) & (F.col("n") >= F.col("of_n")), "left")
        .select("n", "doc_id", "n_chars", "edited_sha256", "own", "changed")
    )
    total = max(1, done.count())
    following = done.select(F.pmod(F.col("n") + 1, F.lit(total)).alias("n"), F.col("own").alias("following"))
    return (
        done.join(following, "n", "left")
        .select(
            "doc_id", "n_chars", "edited_sha256",
            shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("changed")).alias("near_edited"),
            likeness(F.col("own"), F.col("following")).alias("near_next"),
        )
    )
