"""Token ids of a corpus as wavelet-matrix files in ascending order of doc_id, and reading them back."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Memory, byte_letters, flat_ids, slices, tokenizer_json
from .common import arrow_batches, shared_dir, staged
from .wavelet import WaveletMatrix, build

END_ID = 1
#: A file is closed at this many ids; a longer document has a file of its own.
SHARD_TOKENS = 4_000_000
#: Documents of a part, and parts, at most: parts are ranges of doc_id, each written by one task. Beyond, a part has more files, one after another.
PART_DOCUMENTS, MOST_PARTS = 8192, 65_536

#: Pieces that go to the tokenizer in one string.
TOGETHER = 200
#: The tokenizer's pieces of lower-cased text below U+0250: contractions, letters, single digits, marks. Python's \w takes the
#: superscripts and fractions in, which are numbers to the tokenizer.
_PIECES = re.compile(r"[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w \t-\r\x85\xa0]|_)+")
_held: dict[int, tuple[Tokens, Memory]] = {}


class Tokens:
    """Ids, as bytes, of chunks of texts, by the tokenizers library.

    Below U+0250 the tokenizer's normal form is lower case and its pieces are those of one pattern, so such chunks are cut here
    and their pieces go to the library many in one string, to its model alone: a piece's end shows in its last id. Other
    chunks, and those where a special token may stand, go to the whole tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.bare = Tokenizer.from_str(json.dumps(json.loads(file) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "truncation": None, "padding": None}))
        size = max(END_ID + 1, self.whole.get_vocab_size())
        self.wide = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in self.bare.get_vocab().items() if t.endswith(self.bare.model.end_of_word_suffix)]] = True
        self.letters = str.maketrans({chr(b): letter for b, letter in enumerate(byte_letters())})

    def of(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk."""
        odd = [i for i, c in enumerate(chunks) if "<|" in c or not c.isascii() and max(c) >= "\u0250"]
        whole = {i: np.array(e.ids, self.wide).tobytes() for i, e in zip(odd, self.whole.encode_batch_fast([chunks[i] for i in odd], add_special_tokens=False), strict=True)}
        cut = [[] if i in whole else _PIECES.findall(c.lower()) for i, c in enumerate(chunks)]
        shown = [p.translate(self.letters) if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for ps in cut for p in ps]
        encoded = self.bare.encode_batch_fast([" ".join(shown[i : i + TOGETHER]) for i in range(0, len(shown), TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, self.wide), *(np.array(e.ids, self.wide) for e in encoded)])
        stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[np.cumsum([0, *map(len, cut)])] * self.wide.itemsize
        raw, at = ids.tobytes(), stops.tolist()
        return [whole[i] if i in whole else raw[at[i] : at[i + 1]] for i in range(len(chunks))]


_ENCODED = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch], file: Broadcast, bounds: list[int]) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(file.value)
    if key not in _held:  # kept by the worker between tasks
        _held.clear()
        tokens = Tokens(file.value)
        _held[key] = tokens, Memory(tokens.of, tokens.wide)
    tokens, memory = _held[key]
    places = np.array(bounds, np.int64)
    for batch in batches:
        at = 0
        for texts in slices(batch.column("text")):
            ids, starts = flat_ids(memory, texts)
            ended = np.insert(ids, starts[1:], END_ID).astype(tokens.wide)
            edges = ((starts + np.arange(len(starts))) * tokens.wide.itemsize).astype(np.int32)
            doc_id = batch.column("doc_id").slice(at, len(texts))
            part = np.where(pc.is_null(doc_id).to_numpy(zero_copy_only=False), 0, np.searchsorted(places, pc.fill_null(doc_id, 0).to_numpy(), "right"))
            raw = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edges), pa.py_buffer(ended)])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc_id, raw], schema=_ENCODED)
            at += len(texts)


_WRITTEN = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())])


def _write(batches: Iterator[pa.RecordBatch], folder: str, wide: str) -> Iterator[pa.RecordBatch]:
    """Files of a task's parts. A file is written under another name and moved, so that a retried task replaces it whole."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder)

    def close(part: int, shard: int, docs: list, held: list[bytes]) -> tuple:
        ids = np.frombuffer(b"".join(held), wide)
        raw = build(ids, docs, [len(h) // np.dtype(wide).itemsize for h in held])
        path = f"{top}/{part:05d}-{shard:05d}.wm"
        with store.open_output_stream(scratch := f"{path}.{uuid.uuid4().hex}.tmp") as f:
            f.write(raw)
        store.move(scratch, path)
        return part, shard, len(docs), len(ids)

    def rows() -> Iterator[tuple]:
        part, shard, size = -1, 0, 0
        docs: list = []
        held: list[bytes] = []
        for batch in batches:
            for p, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if docs and (p != part or size + len(ids) > SHARD_TOKENS * np.dtype(wide).itemsize):
                    yield close(part, shard, docs, held)
                    shard = shard + 1 if p == part else 0
                    docs, held, size = [], [], 0
                part = p
                docs.append(doc_id)
                held.append(ids)
                size += len(ids)
        if docs:
            yield close(part, shard, docs, held)

    yield from arrow_batches(rows(), _WRITTEN)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Writes the files `<part>-<shard>.wm` of all texts' ids, each text's ended by END_ID, to a folder that all executors see (a
    URI of pyarrow's file systems). Returns per file: part, shard, documents, tokens, start (ids before the file).

    A null or empty text has the end id alone. Documents are in ascending order of doc_id, null first; rows that repeat a
    doc_id are ordered by their ids. Other columns are ignored. An empty table gives no file.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    parts = max(1, min(MOST_PARTS, n // PART_DOCUMENTS))
    cuts = [i / parts for i in range(1, parts)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, cuts)), 100 * parts)).first()[0] or [])) if cuts else []
    file = tokenizer_json(path)
    wide = Tokens(file).wide.str
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_encode, file=spark.sparkContext.broadcast(file), bounds=bounds), "part int, doc_id long, ids binary")
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top)
    dealt = encoded.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "ids")
    written = staged(dealt.mapInArrow(partial(_write, folder=folder, wide=wide), "part int, shard int, documents long, tokens long"), "token-files")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # at most MOST_PARTS rows
    per_part = written.groupBy("part").agg(F.sum("tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return written.withColumn("_in", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(per_part, "part").withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in")


_READ = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                part, shard = map(int, path.rsplit("/", 1)[-1].removesuffix(".wm").split("-"))
                matrix = WaveletMatrix(content.as_buffer())
                doc_ids, lengths = matrix.rows()
                stops = np.cumsum(lengths)
                if not (matrix.access_many(stops - 1) == END_ID).all():
                    raise ValueError(f"{path}: a document lacks its end")
                tokens, at = matrix.tokens().astype("<u4"), 0
                for doc_id, stop in zip(doc_ids, stops.tolist(), strict=True):
                    yield part, shard, doc_id, at, stop - at, zlib.crc32(tokens[at:stop])
                    at = stop

    yield from arrow_batches(rows(), _READ)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: part, shard, doc_id, at (place in the file), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content").mapInArrow(_read, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes docs' ids to the shared folder and reads them back. Per document: doc_id, start, n_tokens, ids_crc32."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    files = write_tokens(docs, folder, path)
    rows = read_tokens(docs.sparkSession, folder)
    return rows.join(files.select("part", "shard", "start"), ["part", "shard"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
