"""Hierarchical packing of documents into windows of several lengths."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coinweave.llm.common import map_arrow, slices
from coinweave.llm.tokens import vocabulary, word_encoder
from coinweave.session import materialize

WINDOW = 4096
#: The window lengths documents are routed to; shorter ones only take what is left at the end of a task.
SHORTEST_TIER = 512
END_ID = 2
#: Tokens that wait in one task before they are packed.
HELD_TOKENS = 1_000_000
#: Tokens of one training step: as many windows of a tier as come to this many tokens.
STEP_TOKENS = 8 * WINDOW
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int64()), ("tier_index", pa.int64())]
)


class Tiers:
    """Open pieces by tier. A piece is [doc_id, ids, start, length]; tier t holds lengths up to t."""

    def __init__(self, window: int, shortest: int):
        self.sizes = [window]
        while self.sizes[-1] // 2 >= shortest:
            self.sizes.append(self.sizes[-1] // 2)
        self.open: dict[int, deque] = {t: deque() for t in self.sizes}

    def add(self, piece: list) -> None:
        fit = next((t for t in reversed(self.sizes) if piece[3] <= t), None)
        self.open[fit].append(piece)

    def take(self, room: int) -> list | None:
        """A piece of at most ``room`` tokens: the next of the longest tier that surely fits, else part of the
        next piece of the shortest tier in use (its rest is routed again)."""
        for t in self.sizes:
            if t <= room and self.open[t]:
                return self.open[t].popleft()
        for t in reversed(self.sizes):
            if self.open[t]:
                piece = self.open[t].popleft()
                if piece[3] > room:
                    self.add([piece[0], piece[1], piece[2] + room, piece[3] - room])
                    piece = [*piece[:3], room]
                return piece
        return None

    def tokens(self) -> int:
        return sum(p[3] for q in self.open.values() for p in q)

    def fill(self, last: bool) -> Iterator[tuple[int, list[list]]]:
        """Full windows, longest tier first; gaps behind a tier's own piece are filled from shorter tiers.
        Without ``last`` what cannot fill the longest window waits for more."""
        left = self.tokens()
        for t in self.sizes:
            while self.open[t] and left >= (t if last else self.sizes[0]):
                pieces, room = [self.open[t].popleft()], t
                room -= pieces[0][3]
                while room:
                    pieces.append(self.take(room))
                    room -= pieces[-1][3]
                left -= t
                yield t, pieces
        size = self.sizes[0]
        while last and left:
            while size > left:
                size //= 2
            pieces, room = [], size
            while room:
                pieces.append(self.take(room))
                room -= pieces[-1][3]
            left -= size
            yield size, pieces


def pack_partition(docs: Iterator[tuple[int | None, bytes]], window: int, shortest: int, first_id: int) -> Iterator[tuple]:
    """Pieces of a task's documents (id, 4-byte ids). Every window comes out full: whole windows are cut from
    long documents, the rest is routed to tiers, and a task's last tokens, fewer than the shortest tier
    holds, go to windows of falling powers of two."""
    tiers, held, sequence, index = Tiers(window, shortest), 0, first_id, {}

    def rows(size: int, pieces: list[list]) -> Iterator[tuple]:
        nonlocal sequence
        at = 0
        for doc_id, ids, start, length in pieces:
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            yield doc_id, start, length, crc, len(ids) // 4, sequence, at, size, index.get(size, 0)
            at += length
        index[size] = index.get(size, 0) + 1
        sequence += 1

    for doc_id, ids in docs:
        n, start = len(ids) // 4, 0
        while n - start >= window:
            yield from rows(window, [[doc_id, ids, start, window]])
            start += window
        if start < n:
            tiers.add([doc_id, ids, start, n - start])
            held += n - start
        if held >= HELD_TOKENS:
            for full in tiers.fill(False):
                yield from rows(*full)
            held = tiers.tokens()
    for full in tiers.fill(True):
        yield from rows(*full)


def pack(docs: DataFrame, vocabulary_path: str | None = None, window: int = WINDOW, shortest: int = SHORTEST_TIER, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text, any others): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, window (the sequence's length), step_group.

    A document is its ids and the end id; null text is empty, so it is the end id alone. Each input
    partition packs its own documents while they stream through (no shuffle of texts or ids, bounded
    buffers); equal rows are packed as often as they occur, a null doc_id is carried along. Then whole
    windows of a tier are numbered over all partitions, from one count per partition and tier, and dealt
    into step groups of ``step_tokens`` tokens each, so that steps of all tiers weigh the same."""
    path = vocabulary_path or vocabulary("word_bpe_49k.json")
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)

        def ids() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                names = batch.column("doc_id").to_pylist()
                for a, b in slices(texts):
                    yield from ((d, x + end) for d, x in zip(names[a:b], encode(texts[a:b])))

        out: list[tuple] = []
        for row in pack_partition(ids(), window, shortest, TaskContext.get().partitionId() << 32):
            out.append(row)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, tier_index long"
    pieces = materialize(map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema), "pieces")
    part = F.shiftright("sequence_id", 32).alias("part")
    counts = pieces.groupBy("window", part).agg((F.max("tier_index") + 1).alias("n"))
    before = Window.partitionBy("window").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("window", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # Tiers in a row: step groups of one window length never share a number with another's.
    group = F.floor((F.col("earlier") + F.col("tier_index")) * F.col("window") / F.lit(step_tokens)).cast("long")
    return (
        pieces.withColumn("part", part)
        .join(offsets, ["window", "part"])
        .withColumn("step_group", F.concat_ws("-", F.col("window").cast("string"), group.cast("string")))
        .drop("part", "earlier", "tier_index")
    )
