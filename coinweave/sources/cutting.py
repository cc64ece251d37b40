"""Large single files in parallel: one CSV with line breaks in cells, or one JSON array, cut at its record borders.

A block of a file cannot know whether it starts inside a quoted cell or a nested object. So every block is scanned once for each state
it may start in: the scan is a function from the state at its start to the state at its end. The functions of a file's
blocks, one row each, are composed in order, and with the states known the blocks are cut into records by as many tasks as
there are blocks. Records that cross a block border are put together from their fragments, at most two a block."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coinweave.session import materialize


class CutError(ValueError):
    """The file is no sequence of records."""


# ---------------------------------------------------------------- CSV: inside a quoted cell or not


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell. A cell is quoted if a quote is its first character; a doubled quote stands for
    itself, and after the closing quote the cell goes on to the next comma."""
    at = 0
    while True:
        while inside:
            at = line.find('"', at)
            if at < 0:
                return True
            inside = line.startswith('"', at + 1)
            at += 2 if inside else 1
            if not inside:
                at = line.find(",", at) + 1
                if not at:
                    return False
        if line.startswith('"', at):
            inside, at = True, at + 1
        else:
            at = line.find(",", at) + 1
            if not at:
                return False


class CsvScan:
    """State: inside a quoted cell."""

    separator = "\n"
    starts = (False, True)

    @staticmethod
    def step(state: bool, piece: str, first: bool) -> bool:
        return ends_inside(piece, state) if state or '"' in piece else False

    @staticmethod
    def cut(state: bool, base: int, pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, bool]]:
        """(text, complete) of each record or remainder, in order."""
        held: list[str] = []
        for piece, _ in pieces:
            held.append(piece)
            state = CsvScan.step(state, piece, False)
            if not state:
                yield "\n".join(held), True
                held = []
        if held:
            # The line break that the separator took stays in the cell.
            yield "\n".join(held) + "\n", False


# ---------------------------------------------------------------- JSON: inside a string or not, and nesting depth

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)


def scan_json(piece: str, inside: bool) -> tuple[bool, int]:
    """(inside a string at the end, change of depth) of text without closing braces."""
    if inside:
        end = _REST.match(piece)
        if not end:
            return True, 0
        piece = piece[end.end() :]
    plain = _STRING.sub("", piece) if '"' in piece else piece
    opened = plain.find('"')
    if opened >= 0:
        plain = plain[:opened]
    return opened >= 0, plain.count("{") + plain.count("[") - plain.count("]")


class JsonScan:
    """State: (inside a string, depth). Pieces lie between closing braces; a brace counts with the piece behind it."""

    separator = "}"
    starts = ((False, 0), (True, 0))

    @staticmethod
    def step(state: tuple[bool, int], piece: str, first: bool) -> tuple[bool, int]:
        inside, depth = state
        if not first and not inside:
            depth -= 1
        inside, change = scan_json(piece, inside)
        return inside, depth + change

    @staticmethod
    def cut(state: tuple[bool, int], base: int, pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, bool]]:
        held: list[str] = []
        inside, depth = state
        for piece, first in pieces:
            if not first:
                held.append("}")
                if not inside:
                    depth -= 1
                    if depth == base:
                        yield "".join(held), True
                        held = []
            held.append(piece)
            inside, change = scan_json(piece, inside)
            depth += change
        if held:
            yield "".join(held), False


# ---------------------------------------------------------------- both


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.text(path, lineSep=separator).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")
    )


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[str], bool]]:
    """(block, its next pieces, whether they are its first) in reading order."""
    last = None
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in columns]))
        values = batch.column("value").to_pylist()
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            yield keys[at], values[at:end], keys[at] != last
            last, at = keys[at], end


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple[str, bool]]]]:
    """(block, its pieces one by one with whether a piece opens the file), without holding a block."""
    runs = _runs(batches, columns)
    waiting = next(runs, None)
    while waiting is not None:
        key = waiting[0]

        def pieces() -> Iterator[tuple[str, bool]]:
            nonlocal waiting
            first = key[1] == 0
            while waiting is not None and waiting[0] == key:
                for value in waiting[1]:
                    yield value, first
                    first = False
                waiting = next(runs, None)

        yield key, pieces()


def _functions(pieces: DataFrame, scan) -> list:
    """One row a block: its end state for each start state, pieces, bytes, and for a file's first block its first character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, size), each in _grouped(batches, ["file", "start", "size"]):
            states, count, length, head = list(scan.starts), 0, 0, ""
            for value, first in each:
                states = [scan.step(s, value, first) for s in states]
                count, length = count + 1, length + len(value.encode())
                head = head or value.lstrip()[:1]
            ends = [s if isinstance(s, tuple) else (s, 0) for s in states]
            yield pa.record_batch({
                "file": [file], "start": pa.array([start], pa.int64()), "size": pa.array([size], pa.int64()), "pieces": pa.array([count], pa.int64()), "bytes": pa.array([length], pa.int64()),
                "head": [head], "inside0": [ends[0][0]], "depth0": pa.array([ends[0][1]], pa.int64()), "inside1": [ends[1][0]], "depth1": pa.array([ends[1][1]], pa.int64()),
            })

    schema = "file string, start bigint, size bigint, pieces bigint, bytes bigint, head string, inside0 boolean, depth0 bigint, inside1 boolean, depth1 bigint"
    return pieces.mapInArrow(run, schema).collect()


def _states(blocks: list, nested: bool) -> tuple[list[tuple], dict[str, tuple]]:
    """Start state of each block, and for each file its end state, base depth and whether a separator ends it."""
    starts, ends = [], {}
    inside, depth, base, total, count = False, 0, 0, 0, 0
    file = None
    for b in sorted(blocks, key=lambda b: (b["file"], b["start"])):
        if b["file"] != file:
            file, inside, depth, total, count = b["file"], False, 0, 0, 0
            base = 1 if nested and b["head"] == "[" else 0
        starts.append((file, b["start"], inside, depth, base))
        inside, depth = (b["inside1"], depth + b["depth1"]) if inside else (b["inside0"], depth + b["depth0"])
        total, count = total + b["bytes"], count + b["pieces"]
        ends[file] = (inside, depth, base, total + count == b["size"])
    return starts, ends


def cut_records(spark: SparkSession, path: str, scan, clean: Callable[[str, int], str | None], at_end: Callable[[str, tuple], str | None]) -> DataFrame:
    """(file, start, at, record): texts of all records; ``start`` and ``at`` give their order in a file. ``clean`` (text, base
    depth) shapes a record or drops it; ``at_end`` (text, end state) says what the remainder of a file is."""
    pieces = _pieces(spark, path, scan.separator)
    starts, ends = _states(_functions(pieces, scan), isinstance(scan.starts[0], tuple))
    known = spark.createDataFrame(starts, "file string, start bigint, inside boolean, depth bigint, base bigint")
    # A block that the scan did not see would have no state: an outer join and a check, not a silent loss.
    placed = pieces.join(F.broadcast(known), ["file", "start"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, inside, depth, base), each in _grouped(batches, ["file", "start", "inside", "depth", "base"]):
            if inside is None:
                raise CutError(f"{file} changed while it was read")
            state = (inside, depth) if isinstance(scan.starts[0], tuple) else inside
            # A block that starts within a record gives the end of it first.
            head = inside or depth > base
            rows: list[tuple] = []
            for n, (text, complete) in enumerate(scan.cut(state, base, each)):
                kind = ("head" if head else "whole") if complete else ("middle" if head else "tail")
                head = False
                made = clean(text, base) if kind == "whole" else text
                if made is not None:
                    rows.append((file, start, n, kind, base, made))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    names = ["file", "start", "at", "kind", "base", "record"]
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("kind", pa.string()), ("base", pa.int64()), ("record", pa.string())])
    cut = materialize(placed.mapInArrow(run, "file string, start bigint, at bigint, kind string, base bigint, record string"), "records")

    # Fragments in order: tail, middle ..., head. A file's last tail, or all of it, has no head.
    order = Window.partitionBy("file").orderBy("start", "at")
    parts = cut.filter("kind <> 'whole'").withColumn("n", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    together = parts.groupBy("file", "n").agg(
        F.min("start").alias("start"), F.min_by("at", F.struct("start", "at")).alias("at"), F.max("base").alias("base"), F.max((F.col("kind") == "head").cast("int")).alias("closed"),
        F.array_sort(F.collect_list(F.struct("start", "at", "record"))).alias("parts"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = "".join(x["record"] for x in r["parts"])
                made = clean(text, r["base"]) if r["closed"] else at_end(text, ends[r["file"]])
                if made is not None:
                    rows.append({"file": r["file"], "start": r["start"], "at": r["at"], "record": made})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("record", pa.string())]))

    mended = together.mapInArrow(join, "file string, start bigint, at bigint, record string")
    return cut.filter("kind = 'whole'").select("file", "start", "at", "record").unionAll(mended)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files, line breaks in cells as they are (``\\r\\n`` as ``\\n``), empty lines left out."""

    def clean(text: str, base: int) -> str | None:
        return text.replace("\r\n", "\n").removesuffix("\r") or None

    def at_end(text: str, end: tuple) -> str | None:
        raise CutError("a quoted cell is never closed")

    return cut_records(spark, path, CsvScan, clean, at_end)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Objects of JSON files that are one array of objects or one object, each as one line."""

    def clean(text: str, base: int) -> str:
        at = text.find("{")
        if text[:at].strip(" \t\r\n,[" if base else " \t\r\n"):
            raise CutError("something other than an object between the objects of an array")
        return " ".join(text[at:].splitlines())

    def at_end(text: str, end: tuple) -> str | None:
        inside, depth, base, closed = end
        if closed and not base and not inside and depth == 1:
            return clean(text + "}", base)
        if inside or closed or depth or text.strip(" \t\r\n") not in (["]", "[]"] if base else [""]):
            raise CutError("the file ends before its array or object does")
        return None

    return cut_records(spark, path, JsonScan, clean, at_end)
