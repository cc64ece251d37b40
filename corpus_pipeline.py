"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the
columns of ``docs``. Filtering stages keep rows as they are: rows the language models reject go, of equal
texts and of near-duplicate groups one row stays, rows that hold a benchmark item go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinweave.llm.common import crc_mod, documents
from coinweave.llm.decontam import contaminated
from coinweave.llm.exact_dedup import exact_dedup
from coinweave.llm.langid import identify
from coinweave.llm.ngram_join import jaccard_components
from coinweave.llm.packing import pack
from coinweave.session import materialize

#: Near-duplicate stages: five words, a similarity of 0.8.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def _named_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` that (doc_id, text_hash) of ``rows`` name; of rows that agree in both, one."""
    same = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__t": F.xxhash64(F.coalesce("text", F.lit("")))})
    wanted = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__d"), F.col("text_hash").alias("__t"))
    return same.join(wanted, ["__d", "__t"], "left_semi").dropDuplicates(["__d", "__t"]).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and looks like one of the labelled languages."""
    return identify(docs, F.lit(True), *docs.columns).filter("NOT rejected").select(*docs.columns)


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; half of the ids are the snapshot, the other half the new batch."""
    return _named_rows(docs, exact_dedup(docs, crc_mod(F.col("doc_id"), 2) == 0).filter("kept"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates."""
    found = jaccard_components(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    return _named_rows(docs, found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. A document is named by id and text: another text under the id of a contaminated one
    stays, and one without id goes if its text holds an item. Null and empty texts hold none."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    named = found.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("__t"))
    return docs.join(named, same, "left_anti")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of up to 4096 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", keep_one_of_equal),
    ("ngram_jaccard", keep_one_of_similar),
    ("decontamination", keep_uncontaminated),
    ("packing", pack_documents),
]

#: SQL cannot express the language models, the latent search and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
