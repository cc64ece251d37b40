"""Readers for transaction files and for the public node/edge dataset layout."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coinweave.functions import normalize as N
from coinweave.session import materialize, scratch_path
from coinweave.sources.cutting import csv_records, json_records


class MalformedInput(ValueError):
    """Raised for files that cannot be a transaction dataset and, in fail-fast mode, for bad rows."""


def read_csv(spark: SparkSession, path: str, quoted_newlines: bool = True) -> DataFrame:
    """Header CSV; all columns stay text so that large integers reach the exact parsers untouched.

    Cells may hold line breaks; files are cut at record borders and read in parts all the same (``sources/cutting.py``). Files
    known to have no such cells skip that scan with ``quoted_newlines=False``."""
    if not quoted_newlines:
        return spark.read.csv(path, header=True, inferSchema=False, escape='"', mode="FAILFAST")
    records = materialize(csv_records(spark, path), "csv_records")
    first = Window.partitionBy("file").orderBy("start", "at")
    heads = records.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("file", "start", "at", "record")
    head = heads.orderBy("file").select("record").head()
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    # The reader itself names the columns, and refuses files with another header.
    named = spark.read.csv(spark.sparkContext.parallelize([head["record"]], 1), header=True, escape='"').schema
    if not heads.filter(F.col("record") != head["record"]).isEmpty():
        raise MalformedInput("the files have different header lines")
    rows = records.join(F.broadcast(heads.select("file", "start", "at")), ["file", "start", "at"], "left_anti")
    schema = ", ".join(f"`c{i}` string" for i in range(len(named)))
    cells = F.from_csv("record", schema, {"escape": '"', "mode": "FAILFAST"})
    return rows.select(cells.alias("c")).select(*[F.col(f"c.c{i}").alias(f.name) for i, f in enumerate(named)])


def _exact_numbers(df: DataFrame) -> DataFrame:
    """Scalars as text, arrays as arrays of text: the same shape that CSV gives."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            out.append(c.cast("array<string>").alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c.cast("string").alias(f.name))
    return df.select(*out)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects or one JSON object per file, read in parts. Primitives are read as their source text."""
    lines = scratch_path(spark, "json_records")
    json_records(spark, path).select("record").write.text(lines)
    return read_ndjson(spark, lines)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return _exact_numbers(spark.read.json(path, primitivesAsString=True, mode="FAILFAST"))


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the suffix; anything but CSV, JSON and newline-delimited JSON is an error."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    readers = {".csv": read_csv, ".json": read_json, ".jsonl": read_ndjson, ".ndjson": read_ndjson}
    if suffix not in readers:
        raise MalformedInput("only CSV, JSON and newline-delimited JSON files are supported")
    return readers[suffix](spark, path)


def check_columns(df: DataFrame) -> DataFrame:
    if not set(df.columns) & N.RECOGNISED:
        raise MalformedInput("no recognised transaction columns were found")
    return df


def check_non_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise MalformedInput("the dataset contains no transaction rows")
    return df


def read_elliptic(spark: SparkSession, features: str, classes: str, edges: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headerless features, ``txId,class`` and ``txId1,txId2`` files of the public dataset layout."""
    raw = spark.read.csv(features, header=False)
    wide = [f"feat_{i + 1}" for i in range(len(raw.columns) - 2)]
    named = raw.toDF("txId", "time_step", *wide).select(
        F.col("txId").cast("bigint").alias("txId"),
        F.col("time_step").cast("double").cast("int").alias("time_step"),
        *[F.col(c).cast("double").alias(c) for c in wide],
    )
    labels = spark.read.csv(classes, header=True).select(
        F.col("txId").cast("bigint").alias("txId"), N.remap_class(F.trim("class")).alias("class")
    )
    links = spark.read.csv(edges, header=True).select(
        F.col("txId1").cast("bigint").alias("source"),
        F.col("txId2").cast("bigint").alias("target"),
        F.lit("original").alias("edge_type"),
    )
    return named, labels, links
