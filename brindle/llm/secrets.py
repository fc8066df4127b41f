"""Secret scans: patterns of credentials, and the values in a credential's place that are too costly to guess.

A value's guess cost is that of its cheapest segmentation, in bits: words of the corpus by their rank, dates, repeats, walks on the keyboard,
and spans that only trying out finds. "password: welcome" is cheap and left alone; what a guesser can't build up is a secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, staged

#: Words of the corpus that a guesser tries, the most frequent first: bounds what is sent to every task.
WORDS = 20_000
WORD_CHARS = (3, 20)
#: A value that takes this many bits to guess is a secret.
LEAST_BITS = 40.0
#: Characters of the shortest value that is looked at.
LEAST_CHARS = 6
#: Distinct words that a task counts at once.
HELD = 200_000

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is maximal from its first character on
KINDS = ("assign", "access", "hex", "guess")
#: What names a credential, and the value after it: quoted to its quote, else to the next space or separator; or that of a URL's user.
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|access|private|signing|encryption)[ _-]?key)["']?[ \t]*(?:=>|:=|[:=])[ \t]*(?:(?:bearer|basic)[ \t]+)?"""
    r"""(?:"(?P<double>[^"\n]+)"|'(?P<single>[^'\n]+)'|(?P<bare>[^\s"'<>,;]+))|(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,30}://[^\s:/@]+:(?P<url>[^\s/@]+)@)""",
    re.IGNORECASE | re.ASCII,
)
#: A text with none of these has nothing for ASSIGN and CONTEXT.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"://")

ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./")
LEET = str.maketrans("4301$57@!", "aeoisstai")
DATE = re.compile(r"(?:19|20)\d\d([-/._ ]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._ ]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
DAY_BITS, YEAR_BITS = math.log2(365 * 120), math.log2(120)
#: Keys next to a key: in its row, and the two above and below that touch it.
NEXT = {
    key: {ROWS[r + d][i + j] for d, js in ((0, (-1, 1)), (-1, (0, 1)), (1, (-1, 0))) for j in js if 0 <= r + d < len(ROWS) and 0 <= i + j < len(ROWS[r + d])} for r, keys in enumerate(ROWS) for i, key in enumerate(keys)
}
WALK_BITS = math.log2(sum(map(len, NEXT.values())) / len(NEXT))
#: Longest unit of a repeat.
UNIT = 8


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    bits: float | None


def _tried(c: str) -> float:
    """Bits of a character that is tried out: by its class."""
    if "0" <= c <= "9":
        return math.log2(10)
    return math.log2(26) if c.isascii() and c.isalpha() else math.log2(33) if c.isascii() else math.log2(128)


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Bits of the cheapest segmentation of a value. ranks: of lower-case words, from 1.

    One pass from left to right; at each place the segments that begin there are tried: a word of at most WORD_CHARS characters (capitals and
    look-alike digits cost a bit each), a date, the longest repeat of each unit, a walk on the keyboard to any of its ends, a single
    character to try out. So it takes time in proportion to the value's length, but for walks, which are short.
    """
    n = len(value)
    low = "".join(c.lower() if c.isascii() else c for c in value)
    plain, keys = low.translate(LEET), low.translate(SHIFTED)
    best = [0.0] + [math.inf] * n
    again = [[0] * (n + 1) for _ in range(UNIT)]  # again[u - 1][i]: how many characters from i on equal the one u further
    for u in range(1, UNIT + 1):
        for i in range(n - u - 1, -1, -1):
            again[u - 1][i] = again[u - 1][i + 1] + 1 if value[i] == value[i + u] else 0
    for i in range(n):
        here = best[i]

        def reach(end: int, bits: float, here: float = here) -> None:
            if here + bits < best[end]:
                best[end] = here + bits

        reach(i + 1, _tried(value[i]))
        for end in range(i + WORD_CHARS[0], min(n, i + WORD_CHARS[1]) + 1):
            for word in {low[i:end], plain[i:end]}:
                if word in ranks:
                    reach(end, 1 + math.log2(ranks[word]) + sum(a != b for a, b in zip(value[i:end], word, strict=True)))
        if "0" <= value[i] <= "9" and (date := DATE.match(value, i)):
            reach(date.end(), 1 + (YEAR_BITS if date.end() == i + 4 else DAY_BITS))
            if date.end() > i + 4 and value[i : i + 2] in ("19", "20") and value[i + 2 : i + 4].isdigit():
                reach(i + 4, 1 + YEAR_BITS)
        for u in range(1, UNIT + 1):
            times = again[u - 1][i] // u + 1
            if times >= (3 if u == 1 else 2):
                reach(i + times * u, 1 + sum(map(_tried, value[i : i + u])) + math.log2(times))
        end = i + 1
        while end < n and end < i + 64 and keys[end] in NEXT.get(keys[end - 1], ()):
            end += 1
            if end >= i + 3:
                turns = sum((ord(keys[j + 1]) - ord(keys[j])) != (ord(keys[j]) - ord(keys[j - 1])) for j in range(i + 1, end - 1)) if "0" <= keys[i] <= "9" else end - i - 2
                reach(end, 1 + math.log2(len(NEXT)) + min(turns + 1, end - i - 1) * WALK_BITS)
    return best[n]


def base_spans(text: str, hinted: bool = True) -> list[Span]:
    """Matches of the three patterns, leftmost first and not overlapping, less those that are too short. hinted: whether the text has any of HINTS."""
    found = [Span(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_CHARS] if hinted else []
    found += [Span(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    return found + [Span(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]


def guessed_spans(text: str, ranks: dict[str, int], base: list[Span], least_bits: float) -> Iterator[Span]:
    """Values in a credential's place that cost at least so many bits, unless a base span holds them."""
    base, at, reach = sorted(base), 0, 0
    for m in CONTEXT.finditer(text):
        start, end = m.span(m.lastgroup)
        while at < len(base) and base[at].start <= start:
            at, reach = at + 1, max(reach, base[at].end)
        if end - start < LEAST_CHARS or end <= reach:
            continue
        bits = guess_bits(text[start:end], ranks)
        if bits >= least_bits:
            yield Span(start, 3, end, bits)


def spans(text: str | None, ranks: dict[str, int], least_bits: float = LEAST_BITS) -> list[Span]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    low = text.encode("utf-8", "surrogatepass").lower()
    hinted = any(h in low for h in HINTS)
    found = base_spans(text, hinted)
    if hinted:
        found += guessed_spans(text, ranks, found, least_bits)
    return sorted(found)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, counts = re.compile(f"[a-z]{{{WORD_CHARS[0]},}}"), dict[str, int]()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for run in runs.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                counts[run] = counts.get(run, 0) + 1
            if len(counts) > HELD:
                yield from arrow_batches(counts.items(), _COUNTS)
                counts.clear()
    yield from arrow_batches(counts.items(), _COUNTS)


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def word_ranks(docs: DataFrame, words: int = WORDS) -> dict[str, int]:
    """The most frequent words of all texts, counted over all of them, by rank: at most `words`, each of at most WORD_CHARS characters."""
    counted = docs.select("text").mapInArrow(_words, "word string, n long").filter(F.length("word") <= WORD_CHARS[1])
    counted = staged(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    # How many words there are of each size of n, in eighths of a power of two: those up to the size that fills the list are sorted, not all.
    size, least, held = F.floor(F.log2("n") * 8), 0, 0
    for r in counted.groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect():
        least, held = r["size"], held + r.words
        if held >= words:
            break
    top = counted.filter(size >= least).orderBy(F.desc("n"), "word").limit(words).collect()  # bounded by `words`
    return {r.word: i for i, r in enumerate(top, 1)}


def find_secrets(docs: DataFrame, ranks: dict[str, int], least_bits: float = LEAST_BITS) -> DataFrame:
    """Per document: doc_id, found (kind, start, end in code points, bits: guess cost, null for a span that a pattern decides). See secret_digests."""
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "bits": s.bits} for s in spans(t, ranks, least_bits)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, schema.field("found").type)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, "doc_id long, found array<struct<kind: string, start: long, end: long, bits: double>>")


def redacted(docs: DataFrame, ranks: dict[str, int], mask: str = "[secret]") -> DataFrame:
    """docs with each found span, overlapping ones as one, replaced by mask in text; all other columns as they are, whatever their names."""
    at, schema = docs.columns.index("text"), docs.schema

    def hide(text: str | None) -> str | None:
        out, done = [], 0
        for s in spans(text, ranks):
            if s.end > done:
                out += [text[done : s.start], mask] if s.start >= done else []
                done = s.end
        return "".join([*out, text[done:]]) if out else text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array([hide(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(scan, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), batch.column("found").to_pylist(), strict=True):
                said = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in found]
                base = ",".join(x for kind, x in said if kind != "guess")
                yield (doc_id, *(sum(kind == k for kind, _ in said) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said))

    yield from arrow_batches(rows(), schema)


def secret_digests(docs: DataFrame, words: int = WORDS, least_bits: float = LEAST_BITS) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    A null or empty text has no spans: zeros, the hash of the empty text, empty spans. Rows without doc_id and repeated rows have rows of
    their own; other columns are ignored; an empty table gives no rows. Guesses never take the place of a pattern's span.
    """
    ranks = word_ranks(docs, words)
    return find_secrets(docs, ranks, least_bits).mapInArrow(_digests, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
