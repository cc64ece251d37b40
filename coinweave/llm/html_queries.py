"""Query: visible text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coinweave.llm.html_render import extract_text


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout-aware text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
ORACLES: dict[str, str] = {}
