"""Queries: n-gram Jaccard join, benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coinweave.llm.common import documents
from coinweave.llm.decontam import contaminated
from coinweave.llm.ngram_join import jaccard_components


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets overlap by 85 percent."""
    return jaccard_components(documents(spark, sf_dir)).drop("text_hash")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join, "op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLES: dict[str, str] = {}
