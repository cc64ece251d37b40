"""Removal of long word spans that an earlier document also has, by a sparse de Bruijn graph of word k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweave.llm.common import ID_LIMIT, map_arrow, mix, powers, word_hashes
from coinweave.session import materialize

WINDOW = 50
#: Words of a k-mer (edge). Of the k-mers inside a window the one with the smallest hash is its anchor.
K = 10


def kmer_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word hashes."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(h)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` values in a row, the first of equals (on the top 40 bits)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    assert len(values) < 1 << 24
    low = (values & ~np.uint64((1 << 24) - 1)) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)


class Spans:
    """Anchored runs of windows of one text: windows first..last (by first word) that share an anchor."""

    def __init__(self, words: np.ndarray, window: int, k: int):
        self.words, self.window = words, window
        kmers = kmer_hashes(words, k)
        self.anchor_at = np.concatenate(
            [sliding_argmin(kmers[a : a + (1 << 23) + window - k], window - k + 1) + a for a in range(0, max(1, len(kmers) - window + k), 1 << 23)]
        )
        cut = np.flatnonzero(np.diff(self.anchor_at)) + 1
        n = len(self.anchor_at)
        self.first = np.concatenate([[0], cut]).astype(np.int64) if n else np.zeros(0, np.int64)
        self.last = np.concatenate([cut, [n]]).astype(np.int64) - 1 if n else np.zeros(0, np.int64)
        at = self.anchor_at[self.first]
        self.anchor = kmers[at]
        self.offset = at - self.first  # words of the run before its anchor

    def prefix(self) -> np.ndarray:
        """Running polynomial sums over the word hashes, for hashes of any span."""
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * powers(len(self.words), _BASE))])

    def span_hashes(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((total[ends] - total[starts]) * powers(len(self.words) + 1, _INVERSE)[starts] + (ends - starts).astype(np.uint64))


_BASE = 0xC2B2AE3D27D4EB4F | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: bytes | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(words joined by a space, start of each, end of each)."""
    words = text.split() if text else []
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined)) if words else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1]) if words else ends
    return joined, starts, ends


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, dict]]:
    """(d, t, words joined, starts, ends, other columns) of each row."""
    for batch in batches:
        others = {n: batch.column(n) for n in batch.schema.names if n not in ("d", "t", "text")}
        for i, (d, t, text) in enumerate(zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), batch.column("text").cast(pa.binary()))):
            yield d, t, *words_of(text.as_py()), {n: c[i].as_py() for n, c in others.items()}


def _find_runs(window: int, k: int):
    """Task: for each row one summary (no anchor), and one row per anchored run of windows."""
    kinds = [pa.int64()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple] = []
        tails: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal heads, tails, held
            names = ["d", "t", "anchor", "label", "first", "last", "n_words", "sha"]
            if heads:
                d, t, n, sha = zip(*heads)
                empty = [pa.nulls(len(d), x) for x in kinds[:4]]
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), *empty, pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=names)
            if tails:
                d, t, *columns = zip(*tails)
                sizes = [len(c) for c in columns[0]]
                arrays = [np.repeat(np.array(x, np.int64), sizes) for x in (d, t)] + [np.concatenate(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.nulls(sum(sizes), pa.int64()), pa.nulls(sum(sizes), pa.string())], names=names)
            heads, tails, held = [], [], 0

        for d, t, joined, starts, ends, _ in _rows(batches):
            heads.append((d, t, len(starts), hashlib.sha256(joined).hexdigest()))
            if len(starts) >= window:
                s = Spans(word_hashes(joined, starts, ends), window, k)
                label = s.span_hashes(s.prefix(), s.first, s.last + window) ^ mix((s.offset + 1).astype(np.uint64))
                tails.append((d, t, s.anchor.view(np.int64), label.view(np.int64), s.first, s.last))
                held += len(label)
            if held > 100_000 or len(heads) > 10_000:
                yield from flush()
        yield from flush()

    return run


def _find_windows(window: int):
    """Task: the windows of the runs listed with each text, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, t, joined, starts, ends, other in _rows(batches):
            words = word_hashes(joined, starts, ends)
            s = Spans.__new__(Spans)
            s.words, s.window = words, window
            total = s.prefix()
            for at in range(0, len(other["runs"]), 2000):
                runs = other["runs"][at : at + 2000]
                sizes = np.array([r["last"] - r["first"] + 1 for r in runs])
                pos = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs])
                hashes = s.span_hashes(total, pos, pos + window).view(np.int64)
                anchors = np.repeat(np.array([r["anchor"] for r in runs], np.int64), sizes)
                n = len(pos)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, d)), pa.array(np.full(n, t)), pa.array(anchors), pa.array(hashes), pa.array(pos)], names=["d", "t", "anchor", "hash", "pos"]
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: texts without the words inside the listed spans."""
    out: list[tuple] = []
    names = ["d", "t", "n_removed", "kept_sha", "kept"]

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    size = 0
    for d, t, joined, starts, _, other in _rows(batches):
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, [s["a"] for s in other["spans"]], 1)
        np.add.at(edge, [s["b"] for s in other["spans"]], -1)
        gone = np.cumsum(edge)[: len(starts)] > 0
        words = joined.split(b" ") if len(starts) else []
        kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
        out.append((d, t, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        size += len(kept)
        if size > 4_000_000:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any others): doc_id, n_words, n_removed, kept_sha256 and,
    with ``with_text``, kept_text (the kept words joined by one space; null where nothing was removed).

    A word goes if a window of ``window`` words covers it whose words also start in a row of smaller
    doc_id. Null or empty texts have no words; rows of one id do not affect each other; a null id is later
    than all others; an empty table gives no rows.

    The k-mer with the smallest hash inside each window is the window's anchor, so equal windows have equal
    anchors, and only about one k-mer in twenty becomes a node of the graph. Windows in a row that share an
    anchor form a run, an edge path labelled with the hash of its whole word span. Where all runs at a node
    have one label the path does not branch, and the smallest doc_id of the node decides for all its
    windows at once; likewise for equal labels at a branching node. Only the first bearers of each label at
    branching nodes are read again, by their source coordinates, and compared window by window. Nodes and
    labels are told apart by 128 bits of hash together. Hot nodes are aggregated before the shuffle and
    joined back with one row per node."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(ID_LIMIT)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
    found = materialize(
        map_arrow(keyed, _find_runs(window, k), "d long, t long, anchor long, label long, first long, last long, n_words long, sha string"), "runs"
    )
    runs = found.filter("anchor IS NOT NULL").select("d", "t", "anchor", "label", "first", "last")
    nodes = (
        runs.groupBy("anchor")
        .agg(F.min("d").alias("low"), F.max("d").alias("high"), F.min("label").alias("l0"), F.max("label").alias("l1"))
        .filter("low < high")
        .select("anchor", "low", (F.col("l0") != F.col("l1")).alias("branching"))
    )
    repeated = materialize(runs.join(nodes, "anchor"), "repeated")
    paths = repeated.filter("branching").groupBy("anchor", "label").agg(F.min("d").alias("path_low"))
    branching = repeated.filter("branching").join(paths, ["anchor", "label"])
    judged = materialize(
        repeated.filter("NOT branching").select("d", "t", "anchor", "first", "last", F.col("low").alias("path_low"), "branching")
        .unionAll(branching.select("d", "t", "anchor", "first", "last", "path_low", "branching")),
        "judged",
    )
    touched = judged.filter("branching OR d > path_low").select("d", "t").distinct()
    texts = materialize(keyed.join(touched, ["d", "t"], "left_semi").dropDuplicates(["d", "t"]), "texts")

    open_runs = judged.filter("branching AND d = path_low").groupBy("d", "t").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("runs"))
    windows = materialize(map_arrow(texts.join(open_runs, ["d", "t"]), _find_windows(window), "d long, t long, anchor long, hash long, pos long"), "windows")
    lows = windows.groupBy("anchor", "hash").agg(F.min("d").alias("low"), F.max("d").alias("high")).filter("low < high")
    late = windows.join(lows, ["anchor", "hash"]).filter("d > low")

    spans = judged.filter("d > path_low").select("d", "t", F.col("first").alias("a"), (F.col("last") + window).alias("b")).unionAll(
        late.select("d", "t", F.col("pos").alias("a"), (F.col("pos") + window).alias("b"))
    )
    spans = spans.groupBy("d", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cut = map_arrow(texts.join(spans, ["d", "t"]), _cut, "d long, t long, n_removed long, kept_sha string, kept string")
    if not with_text:
        cut = cut.drop("kept")
    summary = found.filter("anchor IS NULL").select("d", "t", "n_words", "sha")
    return summary.join(cut, ["d", "t"], "left").select(
        F.nullif("d", F.lit(ID_LIMIT)).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"), *([F.col("kept").alias("kept_text")] if with_text else []),
    )
