"""Queries: token counts of sections, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coinweave.llm.common import documents
from coinweave.llm.packing import pack
from coinweave.llm.token_counts import section_tokens


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of up to 4096 tokens."""
    return pack(documents(spark, sf_dir))


QUERIES = {"op1_token_counts": op1_token_counts, "op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
