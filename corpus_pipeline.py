"""A corpus from raw documents: quality, exact copies, near copies, mix of sources, token ids. All stages but the last carry extra columns, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from brindle.llm import bpe, exact_dedup, mixing, near_dedup, quality
from brindle.llm.common import staged, table
from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality network doesn't reject. Null and empty texts are scored too; repeated rows go or stay together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id. Null and empty texts are equal; one of several rows without doc_id stays."""
    return exact_dedup.drop_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document with the smallest doc_id. Texts without words and rows
    without doc_id stay."""
    return near_dedup.drop_near_copies(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, one for each pass that takes them; the one at the end of a source's share is cut there. Texts without words go."""
    return mixing.mix_documents(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256. A null or empty text has none."""
    return bpe.encode_digests(docs)


STAGES: list[tuple[str, Stage]] = [("quality classifier", _good), ("exact dedup", _exact), ("MinHash near-dedup", _near), ("mixing sources", _mix), ("BPE encoding and decoding", _encode)]

#: SQL can't express the network or the encoder; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
