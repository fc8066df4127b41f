"""BPE encoding and decoding with a transducer lexicon of the corpus's frequent words.

White space never lies inside a token here, so a text's ids are those of its white-space runs' complements ("chunks")
in order, and a task works out each distinct chunk once. A chunk is normalised and cut into pieces as the tokenizer
file says; a piece in the lexicon gives its ids at once, any other goes through the merges. The lexicon holds the most
frequent words by a count over all documents; what it holds changes the speed, never the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .lexicon import Lexicon, compile_lexicon

#: Entries of the lexicon, at most.
LEXICON_WORDS = 32_768
#: Distinct chunks that a worker remembers.
MEMORY = 600_000
#: Bytes of text whose chunks are told apart together.
TOGETHER_BYTES = 8 << 20
#: Marks that may end a word.
_MARKS = "!#$%&*,.:;?"
#: Letters of a piece from which a heap finds the next merge.
LONG = 40
#: Pieces, about equally long, that are merged at once.
AT_ONCE = 16_384
#: str.split() also cuts at these four, which are no white space to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_BEYOND_LATIN = re.compile("[^\0-\u024f]")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: Python's \w takes the superscripts and fractions below U+0250 in, which are numbers to the tokenizer.
_LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w \t-\r\x85\xa0]|_)+")


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file (by default the public word-level BPE), as a text that can be sent to tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def chunks(text: str | None) -> list[str]:
    """Runs of other characters than white space. Lower-cased if that can't matter, so that more of them are the same: among letters below
    U+0250 no mark can compose, so lower case may come before the normal form."""
    if not text:
        return []
    if (text.isascii() or not _BEYOND_LATIN.search(text)) and "<|" not in text:
        text = text.lower()
    if _SEPARATORS.search(text):
        return [c for c in _WHITE.split(text) if c]
    return text.split()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


_NO_PAIR = (1 << 63) - 1


def _letter_rows(pieces: list[str]) -> np.ndarray:
    """A row of code points per piece, 0 after its end; one column more than the longest has letters."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out = np.zeros((len(pieces), int(lengths.max()) + 1), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
    return out


class Encoder:
    """Ids of chunks. Takes a tokenizer file of the kind of word_bpe_49k.json: a BPE with a suffix at word ends over byte letters."""

    def __init__(self, file: str, lexicon: Lexicon | None = None):
        from tokenizers import Tokenizer

        spec = json.loads(file)
        self.lexicon = lexicon
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.letter_ids = {c: self.vocab[c] for c in byte_letters()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: Rank and result of a pair of ids, each in 32 bits.
        self.pairs = {self.vocab[a] << 32 | self.vocab[b]: i << 32 | self.vocab[a + b] for i, (a, b) in enumerate(merges)}
        self.no_pair = len(self.pairs) << 32
        self._pair_keys = np.array(sorted(self.pairs), np.int64)
        self._pair_values = np.array([self.pairs[k] for k in self._pair_keys.tolist()], np.int64)
        self._letter_table, self._end_table = np.full(512, -1, np.int64), np.full(512, -1, np.int64)
        for c in byte_letters():
            self._letter_table[ord(c)], self._end_table[ord(c)] = self.vocab[c], self.vocab[c + self.suffix]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        whole = Tokenizer.from_str(file)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.letters = str.maketrans({chr(b): letter for b, letter in enumerate(byte_letters())})

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text without special tokens, in byte letters. The file's own rules, or for Latin letters ones that give the same."""
        if text.isascii():
            return [p.translate(self.letters) for p in _ASCII_PIECES.findall(text.lower())]
        if max(text) < "\u0250":
            return [p.encode().decode("latin-1").translate(self.letters) for p in _LATIN_PIECES.findall(unicodedata.normalize("NFC", text).lower())]
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def merge(self, piece: str) -> list[int]:
        """Ids of a piece: the pair of neighbours with the lowest rank merges first, of equal ranks the leftmost."""
        if len(piece) > LONG:
            return self._merge_long(piece)
        ids = [self.letter_ids[c] for c in piece]
        ids[-1] = self.vocab[piece[-1] + self.suffix]
        get, none = self.pairs.get, self.no_pair
        ranked = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranked and (best := min(ranked)) != none:
            i = ranked.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], ranked[i]
            if i:
                ranked[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranked):
                ranked[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, piece: str) -> list[int]:
        """merge() with a heap of pairs and linked neighbours: its time grows with n log n."""
        ids: list[int] = [self.letter_ids[c] for c in piece]
        ids[-1] = self.vocab[piece[-1] + self.suffix]
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = best & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := pairs.get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def merge_all(self, pieces: list[str]) -> list[list[int]]:
        """merge() of many pieces of up to LONG letters: each round does every piece's next merge."""
        if not pieces:
            return []
        letters = _letter_rows(pieces)
        out: list[list[int] | None] = [None] * len(pieces)
        if self.lexicon:
            for i in np.flatnonzero((rank := self.lexicon.ranks(letters)) >= 0).tolist():
                out[i] = self.lexicon.ids_at(int(rank[i]))
        rows = np.array([i for i, ids in enumerate(out) if ids is None], np.int64)
        ids = self._letter_table[letters[rows]]
        last = (letters[rows] != 0).sum(axis=1) - 1
        ids[np.arange(len(rows)), last] = self._end_table[letters[rows, last]]
        ranked = self._ranked(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranked.min(axis=1, initial=_NO_PAIR)
            for i in np.flatnonzero(best == _NO_PAIR).tolist():
                out[rows[i]] = ids[i][ids[i] >= 0].tolist()
            going = best != _NO_PAIR
            rows, ids, ranked, best = rows[going], ids[going], ranked[going], best[going]
            if not len(rows):
                break
            each, at = np.arange(len(rows)), ranked.argmin(axis=1)
            ids[each, at] = best & 0xFFFFFFFF
            shift = np.arange(ids.shape[1] - 1) > at[:, None]
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])
            ranked = np.where(np.arange(ranked.shape[1] - 1) >= at[:, None], ranked[:, 1:], ranked[:, :-1])
            width = ids.shape[1]
            for left in (at - 1, at):
                fits = (left >= 0) & (left + 1 < width)
                where, place = each[fits], left[fits]
                ranked[where, place] = self._ranked(ids[where, place], ids[where, place + 1])
        return out  # type: ignore[return-value]

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and result of pairs of ids, as in pairs."""
        wanted = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
        at = np.minimum(np.searchsorted(self._pair_keys, wanted), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == wanted, self._pair_values[at], _NO_PAIR)

    def ids_of(self, chunks: Iterable[str]) -> dict[str, list[int]]:
        """Ids of many chunks."""
        pieces: dict[str, list[tuple[str, int | None]]] = {}
        for c in chunks:
            if self.special_at and "<|" in c:
                pieces[c] = [x for p in self.special_at.split(c) if p for x in ([(p, self.special[p])] if p in self.special else [(q, None) for q in self.pieces(p)])]
            else:
                pieces[c] = [(p, None) for p in self.pieces(c)]
        distinct = list({p for ps in pieces.values() for p, i in ps if i is None})
        short = sorted((p for p in distinct if len(p) <= LONG), key=len)
        known = {p: self.merge(p) for p in distinct if len(p) > LONG}
        for at in range(0, len(short), AT_ONCE):
            known.update(zip(short[at : at + AT_ONCE], self.merge_all(short[at : at + AT_ONCE]), strict=True))
        return {c: [x for p, i in ps for x in (known[p] if i is None else (i,))] for c, ps in pieces.items()}

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: tokens are joined by spaces. Unknown ids are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cased alphabetic chunks of up to 64 letters and how often each is met, batch by batch."""
    for batch in batches:
        for texts in slices(batch.column(0), 4 * TOGETHER_BYTES):
            found = pc.ascii_split_whitespace(pc.drop_null(texts)).flatten()
            found = found.filter(pc.and_(pc.utf8_is_alpha(found), pc.less_equal(pc.utf8_length(found), 64)))
            counted = pc.utf8_lower(found).value_counts()
            for at in range(0, len(counted), 65536):
                yield pa.RecordBatch.from_arrays(counted.slice(at, 65536).flatten(), names=["word", "n"])


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS) -> DataFrame:
    """word, n: the most frequent alphabetic chunks of up to 64 letters, counted over all texts; of equal counts the first by code point.

    A histogram of the counts (eight bars to a doubling) tells from where on limit words are left, so that only about those are sorted.
    """
    counted = docs.select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = staged(counted.filter("n > 1").withColumn("bar", F.floor(F.log2("n") * 8).cast("int")), "word-counts")
    left, least = limit, 0
    for bar, words in sorted(counted.groupBy("bar").count().collect(), reverse=True):
        left, least = left - words, bar
        if left <= 0:
            break
    return counted.filter(F.col("bar") >= least).orderBy(F.desc("n"), "word").limit(limit).drop("bar")


def ship_lexicon(docs: DataFrame, file: str, limit: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon of docs (at most limit words) and sends its file to all executors, later ones too; its name there."""
    encoder = Encoder(file)
    entries: dict[str, tuple[int, ...]] = {}
    for row in frequent_words(docs, limit).collect():
        pieces = encoder.pieces(row["word"])
        if len(pieces) == 1:
            entries[pieces[0]] = tuple(encoder.merge(pieces[0]))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    with open(path, "wb") as f:
        f.write(compile_lexicon(entries))
    docs.sparkSession.sparkContext.addFile(path)
    return name


class Memory:
    """Ids of chunks, as bytes, that were worked out: beyond MEMORY entries, those not asked for since it was last half full go."""

    def __init__(self, work_out: Callable[[list[str]], Iterable[Any]], wide: np.dtype):
        self.work_out, self.wide = work_out, wide
        self.young: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def of(self, distinct: list[str]) -> list[bytes]:
        if len(self.young) > MEMORY // 2:
            self.older, self.young = self.young, {}
        young = self.young
        if missing := self._missing(distinct):
            # Letters (still letters alone in lower case) and the marks that end them are tokens apart: the two are put together.
            marked = {c: len(w) for c in missing if (w := c.rstrip(_MARKS)) != c and w.lower().isalpha() and max(w) < "\u0250"}
            plain = [c for c in missing if c not in marked]
            plain += self._missing({part for c, n in marked.items() for part in (c[:n], c[n:])}.difference(plain))
            for c, ids in zip(plain, self.work_out(plain), strict=True):
                young[c] = ids if isinstance(ids, bytes) else array(self.wide.char, ids).tobytes()
            for c, n in marked.items():
                young[c] = young[c[:n]] + young[c[n:]]
        return [young[c] for c in distinct]

    def _missing(self, wanted: Iterable[str]) -> list[str]:
        """Those of wanted that aren't known; what only the older half knows comes over."""
        young, older = self.young, self.older
        missing = [c for c in wanted if c not in young]
        if older:
            young.update((c, older[c]) for c in missing if c in older)
            missing = [c for c in missing if c not in young]
        return missing


def slices(texts: pa.Array, most: int = TOGETHER_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of an array of texts, of at most so many bytes or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def flat_ids(memory: Memory, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts one after another, and where each text's begin, with the end of the last. ASCII white space never lies inside
    a token or a special token's string, so a text's ids are those of its runs of other characters."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    at = coded.indices.to_numpy()
    raw = memory.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    counts = np.fromiter(map(len, raw), np.int64, len(raw)) // memory.wide.itemsize
    known, starts = np.frombuffer(b"".join(raw), memory.wide), np.cumsum(counts) - counts
    n = counts[at]
    stops = np.cumsum(n)
    ids = known[np.repeat(starts[at] - stops + n, n) + np.arange(stops[-1])]
    return ids, np.concatenate([[0], stops])[split.offsets.to_numpy()]


_held: dict[str, tuple[Encoder, Memory]] = {}


def _worker(file: Broadcast, name: str) -> tuple[Encoder, Memory]:
    """This worker's encoder and memory of chunks, kept between tasks."""
    if name not in _held:
        _held.clear()
        encoder = Encoder(file.value, Lexicon(SparkFiles.get(name)))
        _held[name] = encoder, Memory(lambda cs: encoder.ids_of(cs).values(), np.dtype("<i4"))
    return _held[name]


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch], file: Broadcast, name: str) -> Iterator[pa.RecordBatch]:
    encoder, memory = _worker(file, name)
    size = max(encoder.tokens) + 1
    decimal, shown = pa.array(map(str, range(size)), pa.large_string()), pa.array([encoder.tokens.get(i, "") for i in range(size)], pa.large_string())

    def sha(table: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), table.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))
        return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined], pa.string())

    for batch in batches:
        at = 0
        for texts in slices(batch.column("text")):
            ids, bounds = flat_ids(memory, texts)
            columns = [batch.column("doc_id").slice(at, len(texts)), pa.array(np.diff(bounds)), sha(decimal, ids, bounds), sha(shown, ids, bounds)]
            yield pa.RecordBatch.from_arrays(columns, schema=_DIGESTS)
            at += len(texts)


def encode_digests(docs: DataFrame, path: str | None = None, limit: int = LEXICON_WORDS) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256 (of decode's text).

    A null or empty text, or one of white space, has no ids and decodes to an empty text. Repeated rows and null ids stay as
    they are; other columns are ignored; an empty table gives no rows. Special tokens' strings in a text become their ids.
    """
    file = tokenizer_json(path)
    name = ship_lexicon(docs, file, limit)
    sent = docs.sparkSession.sparkContext.broadcast(file)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_digests, file=sent, name=name), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(batches: Iterator[pa.RecordBatch], file: Broadcast, name: str) -> Iterator[pa.RecordBatch]:
    _, memory = _worker(file, name)
    for batch in batches:
        at = 0
        for texts in slices(batch.column("text")):
            ids, bounds = flat_ids(memory, texts)
            part = batch.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], names=[*batch.schema.names, "ids"])
            at += len(texts)


def encode(docs: DataFrame, path: str | None = None, limit: int = LEXICON_WORDS) -> DataFrame:
    """docs with a column ids (array of int, in place of one of that name). See encode_digests for nulls and empty texts."""
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    docs = docs.drop("ids")
    file = tokenizer_json(path)
    name = ship_lexicon(docs, file, limit)
    sent = docs.sparkSession.sparkContext.broadcast(file)
    return docs.mapInArrow(partial(_ids, file=sent, name=name), StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())))


def _texts(batches: Iterator[pa.RecordBatch], file: Broadcast) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(file.value)
    for batch in batches:
        out = pa.array([encoder.decode(i for i in ids or () if i is not None) for ids in batch.column("ids").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with a column decoded (in place of one of that name), the text of the array in column ids. A null or empty array gives an empty text;
    null and unknown ids are left out; repeated rows stay; an empty table gives no rows."""
    from pyspark.sql.types import StringType, StructType

    rows = rows.drop("decoded")
    sent = rows.sparkSession.sparkContext.broadcast(tokenizer_json(path))
    return rows.mapInArrow(partial(_texts, file=sent), StructType([*rows.schema.fields]).add("decoded", StringType()))
