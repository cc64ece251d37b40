"""Query: quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coinweave.llm.common import documents
from coinweave.llm.quality_rules import fit, judge


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged; documents labelled as good are the trusted ones."""
    docs = documents(spark, sf_dir)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return judge(docs, fit(docs, trusted)).drop("n_ngrams", "score")


QUERIES = {"op13_quality_rules": op13_quality_rules}
ORACLES: dict[str, str] = {}
