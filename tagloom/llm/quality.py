"""Quality rules: minimum-covariance-determinant estimates per language and source.

Every text gives counts (``base_statistics``), the counts a vector of transformed ratios
(``vectors``), and each (language, source) a robust centre and scatter (``estimates``): starting from
medians, concentration steps keep the ``SUPPORT`` share of rows that lie nearest and take their mean and
covariance, which never raises the determinant. A row farther than the ``CUT`` quantile is rejected.

Only DataFrame functions are used. Statistics are narrow rows; a language or source that
holds a third of all rows is summed before its shuffle, and no group is ever collected.

Edge cases: a null or empty text has zero words and fails the base rules; null language or source is a
group of its own; groups under ``LEAST_ROWS`` rows that pass the base rules use the estimate of their language, or of all
rows, taken over all passing rows of that level; below that everything passes. Repeated rows are counted as often as they occur. Columns other than
doc_id, text, lang, source are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import aside, words
from tagloom.session import stage

SUPPORT = 0.75
CUT = 0.9999
STEPS = 4
LEAST_ROWS = 200
WINDOW = 5
AXES = ("x0", "x1", "x2", "x3")
#: Standard deviations below which an axis counts as constant: a ratio that is zero nearly
#: everywhere would otherwise make the scatter singular and reject every row that has any.
FLOOR = (0.10, 0.45, 0.45, 0.45)


def repeated_window_words(found: Column, size: int = WINDOW) -> Column:
    """Number of array elements inside a window of ``size`` elements that occurs twice or more."""
    hashed = F.transform(found, lambda w: F.xxhash64(w))
    n = F.size(found)

    def window_hashes(h: Column) -> Column:
        return F.when(
            n >= size,
            F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)])),
        ).otherwise(F.array().cast("array<bigint>"))

    # one-element transforms bind an array to a name, so that it is made once a row
    def bind(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def repeated(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return bind(placed, lambda s: F.filter(s, lambda x, i: F.coalesce(
            x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(
            x["h"] == F.get(s, i + 1)["h"], F.lit(False))))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b)

    positions = bind(hashed, lambda h: bind(window_hashes(h), repeated))
    return bind(F.sort_array(F.transform(positions, lambda x: x["at"])), covered)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select("doc_id", "lang", "source", text.alias("text"))
        .select("*", words(F.col("text")).alias("words"), lines.alias("lines"))
        .select(
            "doc_id", "lang", "source",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeated_window_words(F.col("words")).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """Log ratios; the added constants draw the ratios of short texts to a common value."""
    return stats.withColumns({
        "x0": F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50)),
        "x1": F.log((F.col("n_symbols") + 3) / (F.col("word_chars") + 1000)),
        "x2": F.log((F.col("n_dup_lines") + 3) / (F.col("n_lines") + 30)),
        "x3": F.log((F.col("n_repeat_words") + 10) / (F.col("n_words") + 200)),
    })


def chi2_cdf(x: float, p: int) -> float:
    """For even ``p``."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def _factor(moments: DataFrame) -> DataFrame:
    """(g, c0.., l00, l10, l11..): centre and Cholesky factor of the scatter, axis floors added."""
    p = len(AXES)
    # the kept share of a normal sample has less spread than the whole
    widen = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, p), p + 2)
    out = moments
    for i in range(p):
        for j in range(i + 1):
            cov = (F.col(f"s{i}{j}") - F.col(f"c{i}") * F.col(f"c{j}")) * widen
            rest = cov - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            value = F.sqrt(F.greatest(rest, F.lit(0.0)) + FLOOR[i] ** 2) if i == j else rest / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    return out.select("g", *[f"c{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def with_distance(rows: DataFrame, estimate: DataFrame, out: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    p, columns = len(AXES), rows.columns
    df = rows.join(estimate, "g", "left")
    for i in range(p):
        known = sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"z{i}", (F.col(AXES[i]) - F.col(f"c{i}") - known) / F.col(f"l{i}{i}"))
    return df.select(*columns, sum((F.col(f"z{i}") ** 2 for i in range(p)), F.lit(0.0)).alias(out))


def _nearest(rows: DataFrame) -> DataFrame:
    """The rows of each group whose distance lies in its first ``SUPPORT`` share.

    The bound comes from counts on a fixed grid of 1/16 octaves, which add up before the shuffle and
    are the same on every run; rows of the bound's cell are all kept.
    """
    cell = F.floor(16 * F.log2(F.col("d2") + 1e-9)).cast("int")
    up_to = Window.partitionBy("g").orderBy("cell")
    bound = (
        rows.groupBy("g", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(up_to))
        .withColumn("total", F.sum("n").over(Window.partitionBy("g")))
        .where(F.col("upto") >= SUPPORT * F.col("total"))
        .groupBy("g").agg(F.min("cell").alias("bound"))
    )
    return rows.join(bound, "g").where(cell <= F.col("bound")).drop("bound")


def _moments(rows: DataFrame) -> DataFrame:
    p = len(AXES)
    return rows.groupBy("g").agg(
        *[F.avg(AXES[i]).alias(f"c{i}") for i in range(p)],
        *[F.avg(F.col(AXES[i]) * F.col(AXES[j])).alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)],
    )


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and factor of each group ``g`` of ``rows(g, x0..)``; ``STEPS`` concentration steps."""
    start = rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"c{i}") for i, x in enumerate(AXES)])
    spread = rows.join(start, "g").groupBy("g").agg(
        *[F.first(f"c{i}").alias(f"c{i}") for i in range(len(AXES))],
        *[(1.4826 * F.percentile_approx(F.abs(F.col(x) - F.col(f"c{i}")), 0.5, 10_000) + FLOOR[i]).alias(f"m{i}")
          for i, x in enumerate(AXES)],
    )
    d2 = sum(((F.col(x) - F.col(f"c{i}")) / F.col(f"m{i}")) ** 2 for i, x in enumerate(AXES))
    near = rows.join(spread, "g").select("g", *AXES, d2.alias("d2"))
    for _ in range(STEPS):
        estimate = stage(_factor(_moments(_nearest(near))))
        near = with_distance(rows, estimate)
    return estimate


def levels(passing: DataFrame) -> DataFrame:
    """Each row of ``passing(lang, source, x0..)`` in all its groups ``g``: language and source, language, all rows."""
    return passing.select(F.explode(F.array(*_level_keys())).alias("g"), *AXES)


def _level_keys() -> list[Column]:
    # a missing field is left out of the JSON, so the levels are told apart by their first letter
    both, one = F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s"))), F.to_json(F.struct(F.col("lang").alias("l")))
    return [F.concat(F.lit("b"), both), F.concat(F.lit("l"), one), F.lit("all")]


def level_names(rows: DataFrame) -> DataFrame:
    """(_both, g, _enough) of every (language, source): ``g`` is the first of it, its language and all rows with ``LEAST_ROWS`` rows that
    pass the base rules; ``_enough`` is false, and ``g`` "all", if none has."""
    both, one, every = _level_keys()
    ok = F.sum((~base_failed()).cast("long"))
    count = rows.groupBy(both.alias("_both"), one.alias("_one")).agg(ok.alias("_n"))
    # as many rows as there are languages and sources
    count = count.withColumn("_m", F.sum("_n").over(Window.partitionBy("_one"))).withColumn("_a", F.sum("_n").over(Window.partitionBy()))
    g = F.when(F.col("_n") >= LEAST_ROWS, F.col("_both")).when(F.col("_m") >= LEAST_ROWS, F.col("_one")).otherwise(every)
    return count.select("_both", g.alias("g"), (F.greatest("_n", "_m", "_a") >= LEAST_ROWS).alias("_enough"))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared) and kept, one row per row of ``docs``."""
    stats = stage(vectors(base_statistics(docs)))
    names = stage(level_names(stats))
    rows = stats.withColumn("_both", _level_keys()[0]).join(names, "_both").drop("_both")
    # only the levels that some group uses are estimated, each from all its passing rows
    used = names.select("g").distinct()
    passing = stage(levels(stats.where(~base_failed())).join(used, "g", "left_semi"))
    cut = chi2_quantile(CUT, len(AXES))
    scored = with_distance(rows, estimates(passing))
    far = F.col("_enough") & F.coalesce(F.col("d2") > cut, F.lit(False))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~far).alias("kept"),
        F.col("d2").alias("distance"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps. Rows that share a doc_id are kept if all of them are."""
    return aside(docs, ("doc_id", "text", "lang", "source"), _keep)


def _keep(docs: DataFrame) -> DataFrame:
    kept = verdicts(docs).groupBy("doc_id").agg(F.min("kept").alias("_kept")).where("_kept")
    id_key = F.struct(F.col("doc_id"))  # a missing id is an id like any other
    ids = kept.select(F.struct("doc_id").alias("_id"))
    return docs.withColumn("_id", id_key).join(ids, "_id", "left_semi").select(*docs.columns)
