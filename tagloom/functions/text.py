"""Text profiles and tokenising as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.stopwords import DEFAULT

LETTERS = r"\p{L}{1,255}"  # the published letter tokenizer cuts a longer run
DIGIT_OR_DOT = r"[0-9.]"


@dataclass(frozen=True)
class Profile:
    """How a text becomes terms: pattern -> lower -> length -> stem -> stop words."""

    name: str
    pattern: str = LETTERS
    min_len: int = 1
    max_len: int | None = None
    stem: bool = False
    stopwords: Sequence[str] = field(default=DEFAULT, repr=False)

    def with_stopwords(self, words: Sequence[str]) -> "Profile":
        words = tuple(dict.fromkeys(w.lower() for w in words))
        return Profile(self.name, self.pattern, self.min_len, self.max_len, self.stem, words)


PLAIN = Profile("plain", min_len=3, max_len=100)
STEM = Profile("stem", stem=True)


def raw_tokens(text: Column, profile: Profile) -> Column:
    """TXT-1, TXT-2: matches of the pattern, cut out first and lower-cased after."""
    return F.transform(F.regexp_extract_all(text, F.lit(profile.pattern), F.lit(0)), F.lower)


def keeps_length(term: Column, profile: Profile) -> Column:
    """TXT-4."""
    test = F.length(term) >= profile.min_len
    return test if profile.max_len is None else test & (F.length(term) <= profile.max_len)


def keeps_characters(term: Column, profile: Profile) -> Column:
    """FLT-12: only a custom pattern can let a digit or a dot through."""
    return F.lit(True) if profile.pattern == LETTERS else ~term.rlike(DIGIT_OR_DOT)


def not_stopword(term: Column, profile: Profile) -> Column:
    """TXT-6: a hash-set test against the literal list, no join."""
    return ~term.isin(list(profile.stopwords)) if profile.stopwords else F.lit(True)


def term_array(text: Column, profile: Profile) -> Column:
    """TXT-7 for profiles without stemming: the kept tokens in text order."""
    if profile.stem:
        raise ValueError("stemming works on term rows: use operators.terms.document_terms")
    return F.filter(
        raw_tokens(text, profile),
        lambda t: keeps_length(t, profile) & keeps_characters(t, profile) & not_stopword(t, profile),
    )
