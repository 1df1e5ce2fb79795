"""Cleaning of raw posts: regular-expression rewrites and tag-string parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define the cleaned text.
TITLE_MARKUP = r"<(([A-Za-z]*)|(/[A-Za-z]*))>"
LINE_BREAKS = r"&#10|&#xD;|&#xA;|\n|\r"
BODY_MARKUP = r"<([^&]*?)>"
BODY_ENTITIES = r"&gt;|&lt;(/?)"
TAG_OPEN = r"&lt;|<"
TAG_CLOSE = r"&gt;|>"
RECORD_BREAKS = r"&#10|&#xA|\n|\r"


def clean_title(title: Column) -> Column:
    """PRJ-1: bare element marks in a title become one space each."""
    return F.regexp_replace(title, TITLE_MARKUP, " ")


def clean_body(body: Column, newline_repl: str = "") -> Column:
    """PRJ-2..4: drop line breaks, then markup, then escaped angle brackets."""
    body = F.regexp_replace(body, LINE_BREAKS, newline_repl)
    body = F.regexp_replace(body, BODY_MARKUP, "")
    return F.regexp_replace(body, BODY_ENTITIES, "")


def flatten_record(value: Column) -> Column:
    """PRJ-9: whatever line breaks are left become spaces, so a record is one line."""
    return F.regexp_replace(value, RECORD_BREAKS, " ")


def tag_list(tags_raw: Column) -> Column:
    """PRJ-5: ``<a><b>`` or its escaped form becomes ``a,b,``; no tags at all is ''."""
    tags = F.regexp_replace(F.coalesce(tags_raw, F.lit("")), TAG_OPEN, "")
    return F.regexp_replace(tags, TAG_CLOSE, ",")


def split_tags(tags: Column) -> Column:
    """PRJ-6, PRJ-7, FLT-5: a comma list as a set without the empty string."""
    return F.array_distinct(F.array_remove(F.split(F.coalesce(tags, F.lit("")), ","), ""))


def lower_tags(tags: Column) -> Column:
    """PRJ-12 over an array; two spellings of one tag collapse."""
    return F.array_distinct(F.transform(tags, F.lower))


def blank_to_null(text: Column) -> Column:
    """FLT-6: whitespace-only element text counts as missing."""
    return F.nullif(F.trim(text), F.lit(""))


def content(title: Column, body: Column) -> Column:
    """PRJ-10: the text of a question; a missing part adds nothing."""
    return F.concat_ws(" ", title, body)


def joined_tags(tags: Column) -> Column:
    """PRJ-11: tags as one comma list, in a fixed order."""
    return F.array_join(F.array_sort(tags), ",")


def label_text(tag: Column, label: Column) -> Column:
    """PRJ-15: the third column of a training row."""
    return F.when(label == 1, tag).otherwise(F.concat(F.lit("NOT_"), tag))
