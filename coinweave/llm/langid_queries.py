"""Query: language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinweave.llm.common import crc_mod, documents
from coinweave.llm.langid import identify


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those of the other folds."""
    docs = documents(spark, sf_dir)
    found = identify(docs, crc_mod(F.col("doc_id"), 4) != 2, "doc_id")
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
