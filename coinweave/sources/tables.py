"""Stored tables in versions: replace, upsert, annotate, look up, append."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_position() -> Column:
    """Where a row of a file scan stands: by file name, split and row. For ``upsert`` of rows from several files, whose
    order Spark does not keep."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def upsert(existing: DataFrame, new: DataFrame, key: str, version: str | Column | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same key; among several new rows of one
    key the highest ``version`` (a column of both, or an expression over ``new`` such as ``file_position()``)
    wins, and of equal ones, or without a version, the last row in the frame's own order. One aggregation
    with map-side combining: repeated keys collapse before the shuffle, so a key with many copies never gathers in one task."""
    cols = existing.columns
    rank = F.lit(None) if version is None else F.col(version) if isinstance(version, str) else version
    numbered = lambda df, late, by: df.select(*cols, by.alias("__version"), F.lit(late).alias("__new"), F.monotonically_increasing_id().alias("__row"))
    later = numbered(new, 1, rank)
    earlier = numbered(existing, 0, F.col(version) if isinstance(version, str) else F.lit(None).cast(later.schema["__version"].dataType))
    row = F.max_by(F.struct(*cols), F.struct("__new", "__version", "__row")).alias("__kept")
    return earlier.unionByName(later).groupBy(F.col(key).alias("__key")).agg(row).select("__kept.*")


class ConcurrentWrite(RuntimeError):
    """Another writer stored a version in between."""


def _files(spark: SparkSession, path: str):
    """The folder as a Hadoop path, and the contexts that list and rename in its store."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    folder = hadoop.Path(path)
    folder = folder.getFileSystem(conf).makeQualified(folder)
    return hadoop, folder, folder.getFileSystem(conf), hadoop.FileContext.getFileContext(folder.toUri(), conf)


_VERSION = re.compile(r"version=(\d+)")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Stored versions of a table, oldest first."""
    _, folder, files, _ = _files(spark, path)
    if not files.exists(folder):
        return []
    names = [_VERSION.fullmatch(s.getPath().getName()) for s in files.listStatus(folder)]
    return sorted(int(m.group(1)) for m in names if m)


def _version_path(path: str, version: int) -> str:
    return f"{path}/version={version:09d}"


def read_table(spark: SparkSession, path: str, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The newest stored version, or the one asked for; a frame that was read keeps to its version."""
    have = versions(spark, path)
    if not have or (version is not None and version not in have):
        raise FileNotFoundError(f"{path}: no version {version or ''}".rstrip())
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(_version_path(path, version or have[-1]))


def replace_table(df: DataFrame, path: str, after: int | None = None) -> int:
    """Store ``df`` as the next version of the table and return its number. It is written aside and becomes a version
    by one rename of the finished folder, so readers see the old rows or the new ones, a write that is killed changes nothing,
    and ``df`` may read the table it replaces. With ``after`` the version must follow that one, else
    ConcurrentWrite is raised and nothing changes. Older versions stay until ``drop_versions``."""
    spark = df.sparkSession
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    df.write.parquet(draft)
    hadoop, folder, _, context = _files(spark, path)
    no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    while True:
        number = (versions(spark, path) or [0])[-1] + 1 if after is None else after + 1
        try:
            context.rename(hadoop.Path(folder, draft.rsplit("/", 1)[1]), hadoop.Path(_version_path(folder.toString(), number)), no_options)
            return number
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            if after is not None:
                raise ConcurrentWrite(f"{path}: version {number} is there already") from e


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the ``keep`` newest versions (one at least); frames that read them are of no use after that."""
    hadoop, folder, files, _ = _files(spark, path)
    old = versions(spark, path)[: -max(keep, 1)]
    for number in old:
        files.delete(hadoop.Path(_version_path(folder.toString(), number)), True)
    return old


def upsert_table(path: str, new: DataFrame, key: str, version: str | Column | None = None) -> int:
    """``upsert`` into the stored table; raises ConcurrentWrite if it changed meanwhile."""
    spark = new.sparkSession
    have = versions(spark, path)
    if not have:
        return replace_table(upsert(new.limit(0), new, key, version), path, 0)
    return replace_table(upsert(read_table(spark, path, have[-1]), new, key, version), path, have[-1])


def annotate_table(path: str, annotations: DataFrame) -> int:
    """``annotate`` the stored table; raises ConcurrentWrite if it changed meanwhile."""
    spark = annotations.sparkSession
    newest = (versions(spark, path) or [None])[-1]
    return replace_table(annotate(read_table(spark, path, newest), annotations), path, newest)


def annotate(transactions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotation columns win over columns of the same name; other rows keep what they had."""
    shared = [c for c in annotations.columns if c != "tx_id" and c in transactions.columns]
    renamed = annotations.select(
        "tx_id", F.lit(True).alias("__hit"),
        *[F.col(c).alias(f"__a_{c}") if c in shared else F.col(c) for c in annotations.columns if c != "tx_id"],
    )
    out = transactions.join(renamed, "tx_id", "left")
    for c in shared:
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(f"__a_{c}")).otherwise(F.col(c)))
    return out.drop("__hit", *[f"__a_{c}" for c in shared])


def scan_ordered(transactions: DataFrame) -> DataFrame:
    return transactions.orderBy("ts", "tx_id")


def lookup(df: DataFrame, tx_id: str) -> DataFrame:
    """Point lookup; the predicate reaches the Parquet scan."""
    return df.filter(F.col("tx_id") == tx_id)


FEEDBACK_SCHEMA = "tx_id string, ai_score double, human_label int, reviewed_by string, timestamp timestamp"


def valid_feedback(df: DataFrame) -> DataFrame:
    return df.filter(F.col("human_label").isin(0, 1) & F.col("tx_id").isNotNull())


def append_feedback(df: DataFrame, path: str) -> DataFrame:
    """Append reviewed labels stamped with the current time; any label but 0 or 1 rejects the batch."""
    bad = df.filter(~F.coalesce(F.col("human_label").isin(0, 1), F.lit(False))).select("tx_id", "human_label").head()
    if bad is not None:
        raise ValueError(f"human_label must be 0 or 1: {bad['human_label']} for {bad['tx_id']}")
    stamped = df.withColumn("timestamp", F.current_timestamp()).select(
        *[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(FEEDBACK_SCHEMA).fields]
    )
    stamped.write.mode("append").parquet(path)
    return stamped


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK_SCHEMA).parquet(path)


def write_nodes_edges(nodes: DataFrame, edges: DataFrame, directory: str, fmt: str = "csv") -> None:
    options = {"header": "true"} if fmt == "csv" else {}
    nodes.write.mode("overwrite").options(**options).format(fmt).save(f"{directory}/nodes.{fmt}")
    edges.write.mode("overwrite").options(**options).format(fmt).save(f"{directory}/edges.{fmt}")


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    for f in schema.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def feature_columns(nodes: DataFrame) -> list[str]:
    """Every column but the id, class and time step; only the schema is read."""
    return [c for c in nodes.columns if c not in ("txId", "class", "time_step")]
