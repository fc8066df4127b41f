"""Exact deduplication: a Grace hash table over normalised texts.

Spark's shuffle is the first partitioning. Before it, each task collapses the copies it reads to one representative (so
a text that a third of all rows hold crosses the network once per task), after it, each task resolves its bucket. Both
use the same table: records go to an open-addressing table that compares complete contents; once the table is over
its memory budget, it and the remaining records are split over spill files by the next four bits of the digest,
file by file, as deep as needed. Spill files are anonymous scratch of one task, as a sort's are: nothing reads them
after the task, and a retried task starts anew.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import count
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batches, free_name

FANOUT_BITS = 4
#: Bytes of distinct text that a table may hold before it spills.
BUDGET = 96 << 20


@dataclass(slots=True)
class Group:
    """Records of equal content. tag: of the first of them; members: what the records carry along (few: what marks a row's place goes by at once)."""

    digest: bytes
    content: bytes
    best: int | None
    rows: int
    payload: Any = None
    tag: Any = None
    members: list[tuple] = field(default_factory=list)

    def absorb(self, other: Group) -> None:
        self.rows += other.rows
        self.members += other.members
        if other.best is not None and (self.best is None or other.best > self.best):
            self.best, self.payload = other.best, other.payload


class OpenTable:
    """Open addressing with linear probing; a hit needs an equal digest and an equal content."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.groups: list[Group] = []
        self.size = 0

    def at(self, digest: bytes, content: bytes) -> Group | None:
        slots, groups, mask = self.slots, self.groups, len(self.slots) - 1
        i = int.from_bytes(digest[-8:], "little") & mask
        while (j := slots[i]) >= 0:
            if groups[j].digest == digest and groups[j].content == content:
                return groups[j]
            i = (i + 1) & mask
        return None

    def add(self, group: Group) -> None:
        self.groups.append(group)
        self.size += len(group.content) + 200 + 100 * len(group.members)
        if 2 * len(self.groups) > len(self.slots):
            self.slots = array("q", [-1]) * (4 * len(self.slots))
            for j in range(len(self.groups)):
                self._place(j)
        else:
            self._place(len(self.groups) - 1)

    def _place(self, j: int) -> None:
        mask = len(self.slots) - 1
        i = int.from_bytes(self.groups[j].digest[-8:], "little") & mask
        while self.slots[i] >= 0:
            i = (i + 1) & mask
        self.slots[i] = j


class GraceTable:
    """Takes records; beyond its budget, what it holds and what comes goes to spill files by the digest's next bits."""

    def __init__(self, budget: int = BUDGET, level: int = 0):
        self.budget, self.level = budget, level
        self.table, self.spills = OpenTable(), None

    def push(self, record: Group) -> Group | None:
        """The group that the record joined; None if it began one or was spilled."""
        if self.spills is not None:
            self._spill(record)
            return None
        held = self.table.at(record.digest, record.content)
        if held is not None:
            held.absorb(record)
            self.table.size += 100 * len(record.members)
        else:
            self.table.add(record)
        if self.table.size > self.budget and len(self.table.groups) > 1 and self.level < 8 * len(record.digest) // FANOUT_BITS:
            self.spills = [tempfile.TemporaryFile() for _ in range(1 << FANOUT_BITS)]  # noqa: SIM115
            for group in self.table.groups:
                self._spill(group)
            self.table = OpenTable()
        return held

    def _spill(self, g: Group) -> None:
        nibble = g.digest[self.level // 2] >> (4 if self.level % 2 == 0 else 0) & 15
        pickle.dump((g.digest, g.content, g.best, g.rows, g.payload, g.tag, g.members), self.spills[nibble], protocol=5)

    def finish(self) -> Iterator[tuple[Group, Group | None]]:
        """(group, record) for each spilled record that joins a group, (group, None) for each group once it is whole."""
        for group in self.table.groups:
            yield group, None
        for file in self.spills or ():
            file.seek(0)
            part = GraceTable(self.budget, self.level + 1)
            for record in _unspill(file):
                if (held := part.push(record)) is not None:
                    yield held, record
            yield from part.finish()
            file.close()


def _unspill(file: Any) -> Iterator[Group]:
    while True:
        try:
            yield Group(*pickle.load(file))
        except EOFError:
            return


def _records(batches: Iterable[pa.RecordBatch], extra: list[str] | None) -> Iterator[Group]:
    """extra: the columns to carry beside the text; None carries nothing, not even the text as it was."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        others = zip(*(batch.column(c).to_pylist() for c in extra), strict=True) if extra else iter([()] * len(ids))
        for doc_id, text, row in zip(ids, batch.column("text"), others, strict=True):
            raw = text.as_py()
            content = (raw or "").encode("utf-8", "surrogatepass").lower()
            yield Group(hashlib.sha256(content).digest(), content, doc_id, 1, None if extra is None else (raw, *row))


_MARK = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("best", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("text", pa.binary())])


def _bucket(digest: bytes) -> int:
    return int.from_bytes(digest[8:16], "little", signed=True)


def _local_marks(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """One row with the text per distinct text of the task, and rows without text, as they are met, for its further copies."""
    context = TaskContext.get()
    tags = count((context.partitionId() if context else 0) << 40)

    def copy(group: Group, record: Group) -> tuple:
        return hash(record.tag), record.best, group.tag[0], None, 0, group.digest, None

    def rows() -> Iterator[tuple]:
        table = GraceTable(budget)
        for record in _records(batches, None):
            record.tag = next(tags), record.best
            if (held := table.push(record)) is not None:
                yield copy(held, record)
        for group, record in table.finish():
            if record is not None:
                yield copy(group, record)
            else:
                tag, doc_id = group.tag
                yield _bucket(group.digest), doc_id, tag, group.best, group.rows, group.digest, group.content

    yield from arrow_batches(rows(), _MARK)


_FOUND = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("digest", pa.binary()), ("found_id", pa.int64()), ("found_n", pa.int64())])


def _resolve_marks(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Copies pass through; the texts of tasks, at most one of each for each task, meet their equals."""
    table = GraceTable(budget)
    for batch in batches:
        copies = batch.filter(pc.equal(batch.column("n"), 0))
        if copies.num_rows:
            none = pa.nulls(copies.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([copies.column("doc_id"), copies.column("tag"), copies.column("digest"), none, none], schema=_FOUND)
        for _, doc_id, tag, best, n, digest, text in zip(*(c.to_pylist() for c in batch.filter(pc.greater(batch.column("n"), 0)).columns), strict=True):
            table.push(Group(digest, text or b"", best, n, None, tag, [(tag, doc_id)]))
    yield from arrow_batches(((doc_id, tag, g.digest, g.best, g.rows) for g, record in table.finish() if record is None for tag, doc_id in g.members), _FOUND)


def mark_copies(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256. Of texts that are equal after lower-casing A-Z only,
    the row with the largest doc_id stays.

    A null text counts as empty, and empty texts are equal. Rows without doc_id rank lowest: a group of only such rows
    has keep_id null and keeps them. Rows that repeat a doc_id and its text count in group_size and share its decision.
    Other columns are ignored. An empty table gives no rows.
    """
    spark_schema = "bucket long, doc_id long, tag long, best long, n long, digest binary, text binary"
    local = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_local_marks, budget=budget), spark_schema)
    found = local.repartition("bucket").mapInArrow(partial(_resolve_marks, budget=budget), "doc_id long, tag long, digest binary, found_id long, found_n long")
    same = W.partitionBy("tag")  # the copies of a text that one task read
    out = found.withColumn("keep_id", F.max("found_id").over(same)).withColumn("group_size", F.max("found_n").over(same))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _local_rows(batches: Iterator[pa.RecordBatch], budget: int, columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    at = {c: i for i, c in enumerate(c for c in columns if c not in ("doc_id", "text"))}

    def rows() -> Iterator[tuple]:
        table = GraceTable(budget)
        for record in _records(batches, list(at)):
            table.push(record)
        for g, record in table.finish():
            if record is not None:
                continue
            raw, *others = g.payload
            yield (*(g.best if c == "doc_id" else raw if c == "text" else others[at[c]] for c in columns), _bucket(g.digest))

    yield from arrow_batches(rows(), schema)


def drop_copies(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """docs with one row of each group of mark_copies: that with the largest doc_id, all its columns.

    Null and empty texts are one group. Rows without doc_id rank lowest, a group of only such rows keeps one of them, as does a group whose
    largest doc_id is repeated. Other columns are carried whatever their names; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    columns, bucket = docs.columns, free_name(docs, "bucket")
    held = StructType([*docs.schema.fields]).add(bucket, LongType())
    local = docs.mapInArrow(partial(_local_rows, budget=budget, columns=columns, schema=to_arrow_schema(held)), held)
    return local.repartition(F.col(bucket)).drop(bucket).mapInArrow(partial(_final_rows, budget=budget, columns=columns, schema=to_arrow_schema(docs.schema)), docs.schema)


def _final_rows(batches: Iterator[pa.RecordBatch], budget: int, columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    wide = pa.schema([*schema, pa.field("", pa.int64())])
    for batch in _local_rows(batches, budget, columns, wide):
        yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=schema)


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM h
"""
