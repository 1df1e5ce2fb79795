"""TXT-5: Porter's published suffix-stripping algorithm as one Column expression per step.

The vowel/consonant conditions are regular expressions without look-around. Stemming is a
projection: it needs no shuffle and no join on a (heavily skewed) term key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published conditions on a stem and the suffix tables.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M_GT_0 = f"^({_C})?{_V}{_C}"
M_EQ_1 = f"^({_C})?{_V}{_C}({_V})?$"
M_GT_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = f"^({_C})?[aeiouy]"
CVC = f"^{_C}[aeiouy][^aeiouwxy]$"
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"
).split()


def _ending(suffixes) -> str:
    """A pattern for the longest of ``suffixes``: the leftmost match that reaches the end. Once
    a suffix matches, its condition alone decides."""
    return f"(?:{'|'.join(suffixes)})$"


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.lit(n))


def _case(branches: list[tuple[Column, Column]], default: Column) -> Column:
    chain = F.when(*branches[0])
    for test, value in branches[1:]:
        chain = chain.when(test, value)
    return chain.otherwise(default)


def _plural(w: Column) -> Column:
    return _case(
        [
            (w.endswith("sses") | w.endswith("ies"), _cut(w, 2)),
            (w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)),
        ],
        w,
    )


def _past(w: Column) -> Column:
    """Step 1b; a word that lost ``ed`` or ``ing`` is marked with ``#`` for the repair step."""
    def lost(n: int) -> Column:
        return F.when(_cut(w, n).rlike(HAS_VOWEL), F.concat(_cut(w, n), F.lit("#"))).otherwise(w)

    return _case(
        [
            (w.endswith("eed"), F.when(_cut(w, 3).rlike(M_GT_0), _cut(w, 1)).otherwise(w)),
            (w.endswith("ed"), lost(2)),
            (w.endswith("ing"), lost(3)),
        ],
        w,
    )


def _repair(w: Column) -> Column:
    stem, last = _cut(w, 1), F.substring(w, -2, 1)
    doubled = (F.length(w) >= 3) & (last == F.substring(w, -3, 1)) & ~last.rlike("[aeiouylsz]")
    return _case(
        [
            (~w.endswith("#"), w),
            (stem.endswith("at") | stem.endswith("bl") | stem.endswith("iz"),
             F.concat(stem, F.lit("e"))),
            (doubled, _cut(w, 2)),
            (stem.rlike(M_EQ_1) & stem.rlike(CVC), F.concat(stem, F.lit("e"))),
        ],
        stem,
    )


def _final_y(w: Column) -> Column:
    stem = _cut(w, 1)
    return F.when(w.endswith("y") & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)


def _final_e(w: Column) -> Column:
    stem = _cut(w, 1)
    drop = stem.rlike(M_GT_1) | (stem.rlike(M_EQ_1) & ~stem.rlike(CVC))
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _final_ll(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(M_GT_1), _cut(w, 1)).otherwise(w)


def _by_table(df: DataFrame, pattern: str, condition: str, table: dict[str, str] | None) -> DataFrame:
    """Steps 2 to 4: find the ending, then replace it (or drop it) if the stem allows."""
    w, end = F.col("_w"), F.col("_end")
    df = df.withColumn("_end", F.regexp_extract(w, pattern, 0))
    stem = F.substring(w, F.lit(1), F.length(w) - F.length(end))
    new = stem
    if table:
        pairs = [F.lit(x) for pair in table.items() for x in pair]
        new = F.concat(stem, F.element_at(F.create_map(*pairs), end))
    return df.withColumn("_w", F.when((end != "") & stem.rlike(condition), new).otherwise(w))


def with_stem(df: DataFrame, term: str, out: str) -> DataFrame:
    """Add column ``out`` with the stem of the lower-case word in ``term``; words of one or two
    letters stay."""
    w, kept = F.col("_w"), df.columns
    y_hidden = F.when(F.col(term).startswith("y"), F.concat(F.lit("Y"), F.substring(term, 2, 1 << 30)))
    df = df.withColumn("_w", y_hidden.otherwise(F.col(term)))
    for step in (_plural, _past, _repair, _final_y):
        df = df.withColumn("_w", step(w))
    df = _by_table(df, _ending(STEP_2), M_GT_0, STEP_2)
    df = _by_table(df, _ending(STEP_3), M_GT_0, STEP_3)
    df = _by_table(df, _ending([*STEP_4, "(?<=[st])ion"]), M_GT_1, None)
    for step in (_final_e, _final_ll):
        df = df.withColumn("_w", step(w))
    y_shown = F.when(w.startswith("Y"), F.concat(F.lit("y"), F.substring(w, 2, 1 << 30)))
    stem = F.when(F.length(term) > 2, y_shown.otherwise(w)).otherwise(F.col(term))
    # a generator, so that a later filter on the stem is not pushed below the nine steps, where
    # each step would be copied into the next
    return df.select(*kept, F.explode(F.array(stem)).alias(out))
