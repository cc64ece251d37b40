"""Small helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: [\x20\x09-\x0D]. bytes.split() splits at exactly these.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python task turns into arrays at a time; a longer single text goes alone.
BATCH_BYTES = 2_000_000
ID_LIMIT = (1 << 63) - 1


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once an application, so that Python tasks can import them
    wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, True)
        root = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(f"{folder}/coinweave.zip", "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(f"{folder}/coinweave.zip")
        _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without_white_space(text: Column) -> Column:
    """``text`` (null: empty) without the six ASCII white-space characters."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def power_threshold(counts: DataFrame, value: str, limit: int, least: int = 1) -> int:
    """Smallest power of two (not under ``least``) that at most ``limit`` rows reach. The histogram over
    powers of two has 64 rows at most, whatever the table's size."""
    bins = {
        r["b"]: r["n"]
        for r in counts.groupBy(F.floor(F.log2(F.col(value).cast("double"))).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()
        if r["b"] is not None
    }
    total, cut = 0, 64
    for b in range(63, -1, -1):
        total += bins.get(b, 0)
        if total > limit or (1 << b) < least:
            break
        cut = b
    return 1 << cut


def slices(texts: list, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) ranges of rows whose texts have about ``limit`` bytes together."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


_POWERS: dict[int, np.ndarray] = {}
_R = 0x9E3779B97F4A7C15 | 1


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, n.bit_length())
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        if size <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word joined[start:end]: polynomial sums over all bytes at once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    base, inverse = _R, pow(_R, -1, 1 << 64)
    with np.errstate(over="ignore"):
        # Scrambled byte values keep short words apart.
        values = _BYTES[data]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(len(data), base))])
        own = (total[ends] - total[starts]) * powers(len(data) + 1, inverse)[starts]
        return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def split_words(texts: Iterable[bytes | None], lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts: (words joined by a space, start of each, end of each, words per text)."""
    joined, counts = [], []
    for t in texts:
        words = (t.lower() if lower else t).split() if t else []
        counts.append(len(words))
        joined.extend(words)
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(joined), ends - lengths, ends, np.array(counts, np.int64)
