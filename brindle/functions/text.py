"""Free text of listings and pages: topic, cost, kind, cleaning. All are Column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import normalize_name

# Patterns.
STYLES = {"bachata": "bachata", "salsa": "salsa|timba", "kizomba": "kizomba", "zouk": "zouk", "merengue": "merengue"}
TOPIC = (
    r"\b(salsa|bachata|kizomba|zouk|merengue|latin|cumbia|reggaeton|timba|son(?:go)?|cha\s*cha|mambo|rumba|guaguanco|cubana?|tropical|rueda|casino"
    r"|afro[-\s]?latin|afro[-\s]?cuban|afro[-\s]?caribbean|bossa\s*nova|bugal[uú]|dominican)\b"
)
COSTS = [
    r"(?:cover|cost|admission|entry|ticket)[:\s]*\$?\s*(\$?\d+(?:\s*[-–]\s*\$?\d+)?)",
    r"\$(\d+)\s*(?:at\s+(?:the\s+)?door|online|advance)",
    r"(\$\d+(?:\s*[-–/]\s*\$?\d+)?)\s*(?:at\s+(?:the\s+)?door|online|advance|cover|entry)",
    r"free\s+event",
]
CLASS = r"\b(class(?:es)?|workshop|boot\s*camp|technique|lesson[s]?|drill[s]?|intensive|course|seminar|fundamentals|footwork|styling)\b"
SOCIAL = r"\b(social|party|parties|night[s]?|fiesta|milonga|practica|pr[aá]ctica|dj|live\s+music|live\s+band|open\s+dancing)\b"
BIG_NAME = r"\b(?:festival|congress|weekender|annual|anniversary|anniversaries|gala|cruise|block party|benefit|fundraiser|solidarity|encuentro)\b"
BIG_TEXT = r"\b(?:benefit\s+(?:concert|show|dance|night|party|event)|fundraiser|all proceeds|earthquake relief|in solidarity|stand in solidarity)\b"
SATELLITE = r"\b(?:pre|after)\s*party\b"
CANCELLED = r"\b(cancel+ed|postponed|rescheduled)\b"
CONDITIONAL = r"(in the event of|in case of|\bif\b|will be|may be|weather|rain)"


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))


def detect_styles(text: Column, styles: dict[str, str] = STYLES) -> Column:
    """Styles whose pattern the text holds, in the order given; ["other"] if none."""
    found = F.array_compact(F.array(*(F.when(_has(text, p), F.lit(s)) for s, p in styles.items())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def mentions_topic(text: Column) -> Column:
    return _has(text, TOPIC)


def extract_cost(text: Column) -> Column:
    """What a text says about the price: the first of four patterns, the first amount, the word free, null."""

    def found(pattern: str) -> Column:
        hit = F.nullif(F.regexp_extract(text, f"(?iU){pattern}", 0), F.lit(""))
        return F.when(hit.rlike("(?i)free"), F.lit("Free")).otherwise(F.trim(hit))

    amount = F.nullif(F.regexp_extract(text, r"\$\d+", 0), F.lit(""))
    return F.coalesce(*map(found, COSTS), amount, F.when(_has(text, r"\bfree\b"), F.lit("Free")))


def parse_price(cost: Column) -> Column:
    """The lower price of a cost text: blank and free are 0, no number is null."""
    number = F.nullif(F.regexp_extract(cost, r"\$?\s*(\d+(?:\.\d{1,2})?)", 1), F.lit(""))
    return F.when((F.trim(cost) == "") | _has(cost, r"\bfree\b"), F.lit(0).cast("decimal(10,2)")).otherwise(F.try_to_number(number, F.lit("99999999.99")).cast("decimal(10,2)"))


def looks_like_class(text: Column) -> Column:
    return _has(text, CLASS) & ~_has(text, SOCIAL)


def derive_special(explicit: Column, recurring: Column, name: Column, text: Column) -> Column:
    """True for a big one-off: an explicit flag wins (false becomes null), recurring rows and satellite parties never are."""
    big = _has(normalize_name(name), BIG_NAME) | _has(text, BIG_TEXT)
    return F.when(explicit.isNotNull(), F.when(explicit, F.lit(True))).when(F.coalesce(recurring, F.lit(False)) | _has(normalize_name(name), SATELLITE), F.lit(None).cast("boolean")).when(big, F.lit(True))


def unescape(text: Column) -> Column:
    """The five common entities; & last."""
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(to))
    return text


def clean_location(text: Column) -> Column:
    """Lines become parts between commas; empty parts go."""
    out = F.regexp_replace(unescape(text), r"\s*[\r\n]+\s*", ", ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(\s*,\s*)+", ", "), r"^, |, $", ""))


def page_text(html: Column) -> Column:
    """Text of a page: scripts and styles out, tags to spaces, entities, spaces squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(out), r"\s+", " "))


def truncate_words(text: Column, limit: int) -> Column:
    """At most limit characters, cut after a word, its trailing marks gone, with an ellipsis."""
    cut = F.regexp_extract(F.substring(text, 1, limit), r"(?s)^(.*)\s", 1)
    cut = F.when(cut == "", F.substring(text, 1, limit)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"[\s,;:.\-]+$", ""), F.lit("…")))


def excerpt_around(text: Column, token: str, width: int = 120) -> Column:
    """width characters around the first hit of a token; the start where there is none."""
    at = F.greatest(F.lit(1), F.locate(token.lower(), F.lower(text)) - width // 2)
    return F.substring(text, at, F.lit(width))


def highlight_spans(text: Column, tokens: list[str]) -> Column:
    """Sorted array of (start, stop) in characters, stop exclusive: what any hit of any token covers, in either case. Hits that overlap or touch are one span.

    Each token is looked for from hit to hit, so the work grows with the text and its hits; both arrays of numbers go back as one.
    Empty tokens hit nothing.
    """
    tokens = sorted({t.lower() for t in tokens if t})
    spans = "array<struct<start:int,stop:int>>"
    if not tokens:
        return F.when(text.isNotNull(), F.array().cast(spans))

    def covered(text: str) -> tuple[list[int], list[int]]:
        hits = []
        for token in tokens:
            at = text.find(token)
            while at >= 0:
                hits.append((at, at + len(token)))
                at = text.find(token, at + 1)
        starts, stops = [], []
        for start, stop in sorted(hits):
            if stops and start <= stops[-1]:
                stops[-1] = max(stops[-1], stop)
            else:
                starts.append(start)
                stops.append(stop)
        return starts, stops

    @F.pandas_udf("starts array<int>, stops array<int>")
    def found(texts: pd.Series) -> pd.DataFrame:
        each = [(None, None) if t is None else covered(t) for t in texts]
        return pd.DataFrame({"starts": pd.Series([x for x, _ in each], dtype=object), "stops": pd.Series([x for _, x in each], dtype=object)})

    both = found(F.lower(text))
    return F.arrays_zip(both["starts"], both["stops"]).cast(spans)


def cancellation_mention(html: Column) -> Column:
    """A word of cancellation in the first 5000 characters without a condition in the 80 before it, each mention on its own."""
    head = F.substring(html, 1, 5000)
    parts, mentions = F.split(head, f"(?i){CANCELLED}"), F.regexp_extract_all(head, F.lit(f"(?i){CANCELLED}"), F.lit(0))

    def look(state: Column, at: Column) -> Column:
        """state: where the last mention ended, whether one so far has no condition."""
        begins = state["end"] + F.length(F.get(parts, at))
        before = F.substring(head, F.greatest(F.lit(1), begins - 79), F.least(F.lit(80), begins))
        return F.struct((begins + F.length(F.get(mentions, at))).alias("end"), (state["found"] | ~before.rlike(f"(?i){CONDITIONAL}")).alias("found"))

    each = F.when(F.size(mentions) > 0, F.sequence(F.lit(0), F.size(mentions) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(each, F.struct(F.lit(0).alias("end"), F.lit(False).alias("found")), look, lambda s: s["found"])


def clock_lines(text: Column, most: int = 6) -> Column:
    """The first distinct lines that state a clock time."""
    lines = F.transform(F.split(text, r"\n"), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: x.rlike(r"(?i)\b\d{1,2}(:\d{2})?\s*(am|pm)\b|\b\d{1,2}:\d{2}\b"))), 1, most)


def display_text(text: Column) -> Column:
    """Lines that shout (more than 65 % capitals among letters) go, unless nothing remains."""

    def shouts(line: Column) -> Column:
        letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
        return (letters > 0) & (F.length(F.regexp_replace(line, r"[^\p{Lu}]", "")) > letters * 0.65)

    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~shouts(x)), "\n")
    return F.when(F.trim(kept) == "", text).otherwise(kept)


def snippet(text: Column, limit: int = 150) -> Column:
    """The first sentence if it fits, else a cut at a word; addresses of pages go."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"https?://\S+", ""), r"\s+", " "))
    sentence = F.regexp_extract(plain, rf"^(.{{20,{limit}}}?[.!?])(\s|$)", 1)
    return F.when(F.length(plain) <= limit, plain).when(sentence != "", sentence).otherwise(truncate_words(plain, limit))
