"""Session defaults, durable intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000

_fallback_dirs: dict[str, str] = {}
_memo: dict[tuple, object] = {}


def build_session(app_name: str = "coinweave", master: str | None = None, scratch: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for (all are plain Spark options). ``scratch`` is the
    shared folder for intermediate tables; a cluster needs one, here or in its own spark.checkpoint.dir."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        **conf,
    }
    if scratch:
        settings["spark.checkpoint.dir"] = scratch
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is named, a private one that goes away with the process,
    and only if driver and executors are one process; on a cluster that would silently lose rows."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _fallback_dirs[app], True)
    return _fallback_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/coinweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends at durable files,
    so a lost executor costs a re-read and never a replay of the loop that made the table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the intermediate tables that ``df`` reads, once all that needs them is durable itself."""
    context = df.sparkSession.sparkContext
    own = f"/coinweave-{context.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if own in f}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that still read them are of no use after that."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/coinweave-{context.applicationId}")
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    for key in [k for k in _memo if k[0] == context.applicationId]:
        del _memo[key]


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting at most ``max_rows`` + 1 rows; otherwise a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def memo(spark: SparkSession, key: tuple, build):
    """One build per session of a derived table that several queries share."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _memo:
        _memo[full] = build()
    return _memo[full]
