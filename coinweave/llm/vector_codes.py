"""Compression of vectors to short codes with per-dimension value dictionaries.

Vectors are kept in blocks. A block has, for every dimension, the sorted distinct integers that occur there (its
dictionary) and each component as an index into it. A round tabulates the squared difference of every distinct
integer to that dimension of all codebook entries; the distance of a part is then a gather by dictionary code and an
add for each of its dimensions. Dictionaries belong to blocks, so their size is bounded by the block whatever
the table holds; what the driver sees of a round is one sum for each entry and dimension."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweave.llm.common import map_arrow
from coinweave.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A block ends at this many components, and at as many rows as 16-bit codes can tell apart.
BLOCK_VALUES, BLOCK_ROWS = 1 << 20, 1 << 16

_BLOCK = "ids array<bigint>, labels array<{label}>, codes binary, sizes array<int>, dictionaries binary"


def usable(vector: Column) -> Column:
    """False for a null vector and for one with a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(flat: np.ndarray, lengths: np.ndarray, width: int, scale: int) -> np.ndarray:
    """(rows x width) floor(scale * component); components a shorter vector lacks count as 0."""
    values = np.floor(flat.astype(np.float64) * scale)
    limit = math.isqrt((1 << 61) // max(width, 1))
    if len(values) and np.abs(values).max() > limit:
        raise ValueError(f"components beyond {limit / scale:g} would overflow the squared distances of {width} dimensions")
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values.astype(np.int64)
    return out


def dictionaries(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(dimensions x rows) codes and each dimension's sorted distinct values."""
    found = [np.unique(column, return_inverse=True) for column in rows.T]
    codes = np.array([c for _, c in found], np.uint16).reshape(rows.shape[1], rows.shape[0])
    return codes, [v for v, _ in found]


def nearest(codes: np.ndarray, values: list[np.ndarray], books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts x rows) index of the nearest entry, the lower of equals, and its squared distance."""
    parts, entries, width = books.shape
    chosen = np.zeros((parts, codes.shape[1]), np.int64)
    least = np.zeros((parts, codes.shape[1]), np.int64)
    for p in range(parts):
        distance = np.zeros((codes.shape[1], entries), np.int64)
        for k in range(width):
            d = p * width + k
            table = (values[d][:, None] - books[p, :, k][None, :]) ** 2
            distance += table[codes[d]]
        chosen[p] = distance.argmin(axis=1)
        least[p] = distance[np.arange(len(distance)), chosen[p]]
    return chosen, least


def _read(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, list[np.ndarray]]]:
    """(ids, labels, codes, dictionaries) of each block."""
    for i in range(batch.num_rows):
        ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
        codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint16).reshape(width, len(ids))
        values = np.frombuffer(batch.column("dictionaries")[i].as_py(), np.int64)
        ends = np.cumsum(batch.column("sizes")[i].as_py(), dtype=np.int64)
        yield ids, labels, codes, np.split(values, ends[:-1]) if width else []


def to_blocks(vectors: DataFrame, width: int, scale: int = SCALE) -> DataFrame:
    """Blocks of ``vectors`` (__i, __l, __v), each with its dictionaries."""
    label = vectors.schema["__l"].dataType.simpleString()
    schema = _BLOCK.format(label=label)
    room = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            labels = pa.concat_arrays([h[1] for h in held])
            codes, values = dictionaries(np.concatenate([h[2] for h in held]))
            whole = pa.array([0, len(ids)], pa.int32())
            return pa.record_batch({
                "ids": pa.ListArray.from_arrays(whole, ids), "labels": pa.ListArray.from_arrays(whole, labels),
                "codes": pa.array([codes.tobytes()], pa.binary()), "sizes": pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                "dictionaries": pa.array([b"".join(v.astype(np.int64).tobytes() for v in values)], pa.binary()),
            })

        for batch in batches:
            vector = batch.column("__v")
            lengths = vector.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            made = integers(vector.flatten().to_numpy(zero_copy_only=False), lengths, width, scale)
            at = 0
            while at < len(made):
                end = min(len(made), at + room - rows)
                held.append((batch.column("__i").slice(at, end - at), batch.column("__l").slice(at, end - at), made[at:end]))
                rows, at = rows + end - at, end
                if rows == room:
                    yield flush()
                    held, rows = [], 0
        if rows:
            yield flush()

    return map_arrow(vectors.select("__i", "__l", "__v"), run, schema)


def _sums(blocks: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts in each entry and the componentwise sum of them, over all blocks. Tasks add up their blocks
    first, so as many rows as the codebooks have numbers leave a task and reach the driver."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, _, codes, values in _read(batch, parts * width):
                chosen, _ = nearest(codes, values, books)
                for p in range(parts):
                    counts[p] += np.bincount(chosen[p], minlength=entries)
                    for k in range(width):
                        d = p * width + k
                        # Sums stay far under 2**53: they are exact.
                        sums[p, :, k] += np.bincount(chosen[p], values[d][codes[d]].astype(np.float64), entries).astype(np.int64)
        flat = np.concatenate([counts.ravel(), sums.ravel()])
        yield pa.record_batch({"at": pa.array(np.arange(len(flat), dtype=np.int32)), "v": pa.array(flat)})

    out = np.zeros(parts * entries * (1 + width), np.int64)
    for r in map_arrow(blocks, run, "at int, v bigint").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out[: parts * entries].reshape(parts, entries), out[parts * entries :].reshape(books.shape)


def learn(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` of assigning all parts and moving each used entry to the floored mean of its parts."""
    for _ in range(rounds):
        counts, sums = _sums(blocks, books)
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
    return books


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    parts, _, width = books.shape
    label = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, codes, values in _read(batch, parts * width):
                chosen, least = nearest(codes, values, books)
                text = chosen.astype(np.uint8).T.tobytes().hex()
                each = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.record_batch({"vec_id": ids, "label": labels, "code": pa.array(each, pa.string()), "error": pa.array(least.sum(axis=0))})

    return map_arrow(blocks, run, f"vec_id bigint, label {label}, code string, error bigint")


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every usable vector, and the codebooks (parts x entries x width).

    Vectors that are null or have a null or non-finite component are left out. Components become
    floor(scale * x); vectors are cut into ``parts`` equal parts. Codebooks start with the vectors of smallest id
    (null ids first; of equal ids the smaller integers first) and move for ``rounds``; a part's code is its
    nearest entry, the lower index of equals. ``error`` is the squared distance over all parts.

    The dimension is that of the longest vector, rounded up to a multiple of ``parts``; components that a
    vector lacks count as 0. Fewer rows than entries make smaller codebooks; repeated rows each get a row; an
    empty table gives no rows and empty codebooks. Components whose squares would not fit in a long are refused
    with an error. Columns other than the three named are not read."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits")
    kept = vectors.select(
        F.col(vec_id).cast("bigint").alias("__i"), F.col(label).alias("__l"), F.col(vector).cast("array<double>").alias("__v")
    ).filter(usable(F.col("__v")))
    dimension = kept.agg(F.max(F.size("__v")).alias("d")).first()["d"] or 0
    step = -(-dimension // parts)
    width = step * parts
    whole = F.transform("__v", lambda x: F.floor(x * scale))
    first = kept.select("__i", whole.alias("whole")).orderBy(F.col("__i").asc_nulls_first(), "whole").limit(entries).collect()
    starts = np.zeros((len(first), width), np.int64)
    for row, r in zip(starts, first):
        row[: len(r["whole"])] = r["whole"]
    books = starts.reshape(len(first), parts, step).transpose(1, 0, 2).copy()
    blocks = to_blocks(kept, width, scale)
    if not len(first):
        return blocks.selectExpr("ids[0] vec_id", "labels[0] label", "'' code", "0L error"), books
    blocks = materialize(blocks, "vector_blocks")
    books = learn(blocks, books, rounds)
    return _coded(blocks, books), books
