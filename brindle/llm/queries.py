"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, chat, dialogue_repair, exact_dedup, mixing, near_dedup, quality, secrets, substring_dedup, token_store, toxicity, variants
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_quality_network": lambda spark, d: quality.score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_hyperminhash_dedup": lambda spark, d: near_dedup.near_components(table(spark, d, "documents"), k=2),
    "op3_chat_perspectives": lambda spark, d: chat.perspective_digests(table(spark, d, "conversations")),
    "op4_toxicity_compression": lambda spark, d: toxicity.score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_source_mix": lambda spark, d: mixing.mix_taken(table(spark, d, "documents")),
    "op6_suffix_automata": lambda spark, d: substring_dedup.removal_digests(table(spark, d, "documents")),
    "op7_exact_dedup": lambda spark, d: exact_dedup.mark_copies(table(spark, d, "documents")),
    "op8_wavelet_tokens": lambda spark, d: token_store.round_trip(table(spark, d, "documents")),
    "op9_chroma_fingerprints": lambda spark, d: audio.match_report(audio.sonified(table(spark, d, "embeddings").selectExpr("vec_id as rec_id", "embedding as vector"))),
    "op10_bpe_lexicon": lambda spark, d: bpe.encode_digests(table(spark, d, "documents")),
    "op11_secret_guess_cost": lambda spark, d: secrets.secret_digests(table(spark, d, "documents")),
    "op12_dialogue_repair": lambda spark, d: dialogue_repair.repair_conversations(table(spark, d, "conversations")),
    "op13_spelling_variants": lambda spark, d: variants.spelling_variants(table(spark, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op2_hyperminhash_dedup": near_dedup.ORACLE,
    "op3_chat_perspectives": chat.ORACLE,
    "op5_source_mix": mixing.ORACLE,
    "op6_suffix_automata": substring_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
}
