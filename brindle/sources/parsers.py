"""Parsers by type of source: a function from a source's pages to rows of listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parse import dated_lines, jsonld_events

Parser = Callable[[DataFrame], DataFrame]
_PARSERS: dict[str, Parser] = {}


def register_parser(kind: str, parser: Parser) -> None:
    _PARSERS[kind] = parser


def parse_sources(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """page_id, name, start, place of all pages, by the parser that the registry (source_id, parser, enabled) names for their source.

    Pages meet the registry in one join; each parser then runs over its own pages.
    """
    known = pages.join(registry.filter("enabled").select("source_id", "parser"), "source_id")
    parts = [p(known.filter(F.col("parser") == k)).select("page_id", "name", "start", "place") for k, p in _PARSERS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


register_parser("jsonld", jsonld_events)
register_parser("dated_lines", lambda pages: dated_lines(pages.withColumn("text", F.col("html"))).select("page_id", F.col("venue").alias("name"), F.col("day_text").alias("start"), F.col("city").alias("place")))
