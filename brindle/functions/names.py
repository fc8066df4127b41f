"""Names of listings: normal form, words that tell them apart, series and special editions. All are Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Stop words, words that many titles share, weekdays, patterns.
STOP_WORDS = ["the", "at", "in", "and", "of", "by", "a", "an", "y"]
GENERIC_WORDS = [
    "salsa", "bachata", "kizomba", "zouk", "merengue", "cumbia", "chacha", "timba", "rueda", "reggaeton", "dembow", "mambo", "latin", "latino", "latina",
    "afrolatin", "dance", "dancing", "dancers", "social", "socials", "party", "parties", "night", "nights", "music", "live", "dj", "event", "events",
]
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
NAME_STEPS = [
    (r"\b\d{1,2}[/\-]\d{1,2}([/\-]\d{2,4})?\b", " "),
    (r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2}\w*\b", " "),
    (r"\bvol\s*\.?\s*\d+\b", " "),
    (r"#\d+", " "),
    (r"\b\d{1,2}(st|nd|rd|th)\b", " "),
    (r"[^\p{L}\p{N}_\s]", ""),
    (r"\s+", " "),
]
SPECIAL_EDITION = r"\b(?:anniversary|anniversaries|\d+\s*year|festival|festiva|edition|ft|feat|featuring|takeover|special|halloween|nye|new year|christmas|valentine|vs)\b"


def normalize_name(name: Column) -> Column:
    """Lower case without dates, numbers of editions and punctuation, in that order: 9/12 and #4 are gone before their marks are."""
    out = F.lower(name)
    for pattern, to in NAME_STEPS:
        out = F.regexp_replace(out, f"(?U){pattern}", to)
    return F.trim(out)


def _words(name: Column) -> Column:
    return F.filter(F.array_distinct(F.split(name, " ")), lambda w: w != "")


def content_words(name: Column) -> Column:
    """Distinct words of a normal name without stop words."""
    return F.array_except(_words(name), F.array(*map(F.lit, STOP_WORDS)))


def distinctive_words(words: Column) -> Column:
    """Words that can identify a listing: three letters or more, no generic word, no weekday."""
    common = GENERIC_WORDS + [d + s for d in WEEKDAYS for s in ("", "s")]
    return F.filter(F.array_except(words, F.array(*map(F.lit, common))), lambda w: F.length(w) >= 3)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def shared_word_count(a: Column, b: Column) -> Column:
    """Words in both, plus pairs of other words of three letters or more that are one edit apart, matched in sorted order, each once."""
    exact = F.size(F.array_intersect(a, b))

    def rest(x: Column, y: Column) -> Column:
        return F.array_sort(F.filter(F.array_except(x, y), lambda w: F.length(w) >= 3))

    def match(state: Column, word: Column) -> Column:
        hit = F.element_at(F.concat(F.filter(state["left"], lambda w: within_one_edit(word, w)), F.array(F.lit(None).cast("string"))), 1)
        left = F.filter(state["left"], lambda w: ~w.eqNullSafe(hit))
        return F.struct((state["n"] + F.when(hit.isNotNull(), 1).otherwise(0)).cast("int").alias("n"), left.alias("left"))

    fuzzy = F.aggregate(rest(a, b), F.struct(F.lit(0).alias("n"), rest(b, a).alias("left")), match, lambda s: s["n"])
    return exact + fuzzy


def same_series(a: Column, b: Column) -> Column:
    """Normal names of one series: equal, one in the other, or most of the shorter one's words shared."""
    wa, wb = content_words(a), content_words(b)
    smaller = F.least(F.size(wa), F.size(wb))
    return (a == b) | a.contains(b) | b.contains(a) | ((smaller > 0) & (shared_word_count(wa, wb) >= F.greatest(F.lit(2.0), smaller * 0.6)))


@pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def to_ascii(text: Column) -> Column:
    """Letters without their marks, compatible forms as plain ones; what has no ASCII form goes. Only texts that need it leave the JVM, but a null for each other row does too."""
    plain = is_ascii(text)
    return F.when(plain, text).otherwise(_decomposed(F.when(~plain, text)))


def is_special_edition(name: Column) -> Column:
    """A branded edition (anniversary, guest, holiday), by the normal name."""
    return F.coalesce(name.rlike(f"(?iU){SPECIAL_EDITION}"), F.lit(False))
