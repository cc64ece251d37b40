"""Queries: exact, line and substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinweave.llm.common import crc_mod, documents
from coinweave.llm.exact_dedup import exact_dedup
from coinweave.llm.line_dedup import remove_common_lines
from coinweave.llm.substring_dedup import remove_repeats


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all documents, by id, as the snapshot and the other half as the batch; every row is judged."""
    return exact_dedup(documents(spark, sf_dir), crc_mod(F.col("doc_id"), 2) == 0).drop("origin", "text_hash")


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER w AS group_size,
         first_value(doc_id) OVER (w ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id
  FROM d WINDOW w AS (PARTITION BY norm)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line blocks of all documents that an earlier document has, deleted."""
    return remove_common_lines(documents(spark, sf_dir), with_text=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside spans of 50 words that an earlier document has, over all documents."""
    return remove_repeats(documents(spark, sf_dir), with_text=False)


QUERIES = {"op2_exact_dedup": op2_exact_dedup, "op4_line_dedup": op4_line_dedup, "op6_substring_dedup": op6_substring_dedup}
ORACLES = {"op2_exact_dedup": EXACT_SQL.strip()}
