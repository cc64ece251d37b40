"""Removal of line blocks that a later document shares with an earlier one, by patience alignment of shared line hashes."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweave.llm.common import ID_LIMIT, map_arrow, mix, powers, slices
from coinweave.session import materialize

#: Characters (without white space at line ends) that an aligned block must have to be deleted.
LEAST_CHARS = 30


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], rising in both: common starts and ends, then the longest rising
    sequence of lines that occur once on each side, and the same again between those."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        tops: list[int] = []
        piles: list[tuple[int, int, int]] = []  # (i, j, previous card), and the last card of each pile
        last: list[int] = []
        for i in range(a0, a1):
            x = a[i]
            if in_a[x] == 1 and x in place:
                j = place[x]
                k = bisect_left(tops, j)
                piles.append((i, j, last[k - 1] if k else -1))
                if k == len(tops):
                    tops.append(j)
                    last.append(len(piles) - 1)
                else:
                    tops[k], last[k] = j, len(piles) - 1
        chain, card = [], last[-1] if last else -1
        while card >= 0:
            i, j, card = piles[card]
            chain.append((i, j))
        right_a, right_b = a1, b1
        for i, j in chain:  # from the end to the start
            pairs.append((i, j))
            if i + 1 < right_a and j + 1 < right_b:
                todo.append((i + 1, right_a, j + 1, right_b))
            right_a, right_b = i, j
        if chain and a0 < right_a and b0 < right_b:
            todo.append((a0, right_a, b0, right_b))
    return sorted(pairs)


def join_blocks(first: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first, end) of blocks that overlap, touch or have only blank lines between them (``text``: the next line after the
    block that is not blank), joined, in order."""
    order = np.lexsort((end, first))
    first, end, text = first[order], end[order], text[order]
    reach = np.maximum.accumulate(text)
    starts = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return first[starts], np.maximum.reduceat(end, starts)


def aligned(later: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Which common keys of a later row, (first, end, place in the earlier row, key), patience diff aligns with that row's
    keys; the others are moved or repeated. A key stands at its first place in the earlier row."""
    order = sorted(range(len(later)), key=lambda k: later[k][:2])
    earlier = sorted({(place, end - first, key) for first, end, place, key in later})
    hits = np.zeros(len(later), bool)
    for _, j in patience([key for _, _, key in earlier], [later[k][3] for k in order]):
        hits[order[j]] = True
    return hits


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row: its partners, aligned with one after the other, and all common blocks joined."""
    for batch in batches:
        met = batch.column("met")
        bounds = met.offsets.to_numpy()
        pd_, pt, first, end, text, place, key = (met.values.field(n).to_numpy() for n in ("pd", "pt", "a", "b", "x", "pa", "h"))
        partners, moved, cuts, at = [], [], [], [0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            order = lo + np.lexsort((first[lo:hi], pt[lo:hi], pd_[lo:hi]))
            same = (np.diff(pd_[order]) == 0) & (np.diff(pt[order]) == 0)
            parts = np.split(order, np.flatnonzero(~same) + 1)
            kept = np.concatenate([part[aligned(list(zip(*(c[part].tolist() for c in (first, end, place, key)))))] for part in parts])
            a, b = join_blocks(first[lo:hi], end[lo:hi], text[lo:hi])
            in_order = sum(y - x for x, y in zip(*join_blocks(first[kept], end[kept], text[kept]))) if len(kept) else 0
            partners.append(len(parts))
            moved.append(int((b - a).sum() - in_order))
            cuts.append(np.stack([a, b], 1).ravel())
            at.append(at[-1] + 2 * len(a))
        flat = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("d"), batch.column("t"), pa.array(partners, pa.int64()), pa.array(moved, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))],
            names=["d", "t", "n_partners", "n_moved", "cuts"],
        )


def without_blocks(text: str, cuts: list[int]) -> tuple[str, int]:
    """The text without the lines [cuts[0], cuts[1]), [cuts[2], cuts[3]) ..., and the number of those lines."""
    lines, kept, after = text.split("\n"), [], 0
    for first, end in zip(cuts[::2], cuts[1::2]):
        kept += lines[after:first]
        after = end
    kept += lines[after:]
    return "\n".join(kept), len(lines) - len(kept)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column("text").to_pylist()):
            part = batch.slice(lo, hi - lo)
            made = [without_blocks(x, c) for x, c in zip(part.column("text").to_pylist(), part.column("cuts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(n) for n in ("d", "n_lines", "n_partners", "n_moved")] + [pa.array([n for _, n in made], pa.int64()), pa.array([x for x, _ in made], pa.string())],
                names=["d", "n_lines", "n_partners", "n_moved", "n_removed", "kept_text"],
            )


_BASE = 0x9E3779B97F4A7C15


def block_keys(hashes: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(row, key, first, end, next line that is not blank) of every line with ``least`` characters and of the shortest runs
    of two lines or more with ``least`` characters that start or end at a line. Row r has the lines bounds[r] to
    bounds[r + 1], and places count from there. How far such a run goes depends on its lines alone, so each line of a
    block of ``least`` characters that two rows share is in a key that both have."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    sums = np.concatenate([[0], np.cumsum(sizes)])
    start = np.flatnonzero(sizes > 0)
    end = np.searchsorted(sums, sums[start] + least)
    runs = end <= bounds[1:][row[start]]
    back = np.searchsorted(sums, sums[start + 1] - least, "right") - 1
    ends = (back >= bounds[row[start]]) & (back < start)
    first, last = np.concatenate([start[runs], back[ends]]), np.concatenate([end[runs], start[ends] + 1])
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    first, last = first[new], last[new]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes.view(np.uint64)) * powers(len(hashes), _BASE))])
        own = mix((total[last] - total[first]) * powers(len(hashes) + 1, pow(_BASE, -1, 1 << 64))[first] + (last - first).astype(np.uint64))
    rows = row[first]
    after = np.append(start, len(hashes))[np.searchsorted(start, last)]
    return rows, own.view(np.int64), first - bounds[rows], last - bounds[rows], np.minimum(after, bounds[rows + 1]) - bounds[rows]


def _keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = (batch.column(n) for n in ("hashes", "sizes"))
            bounds = hashes.offsets.to_numpy().astype(np.int64)
            rows, keys, *places = block_keys(hashes.flatten().to_numpy(), sizes.flatten().to_numpy().astype(np.int64), bounds - bounds[0], least)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(at), batch.column("t").take(at), pa.array(keys), *(pa.array(x.astype(np.int32)) for x in places)], names=["d", "t", "h", "a", "b", "x"]
            )

    return run


def remove_common_lines(docs: DataFrame, least: int = LEAST_CHARS, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any others): doc_id, n_lines, n_removed, n_moved, n_partners,
    kept_sha256 and, with ``with_text``, kept_text.

    Lines end at line feeds and are compared without white space at their ends. For every line of ``least``
    characters, and every shortest run of lines from or to a line that has them, the first row with it (by doc_id, null
    last) is a partner of all later ones, however frequent the line is. The later row's keys that have this first row are
    aligned with it by patience diff. What is aligned is deleted, and so are common blocks off the alignment, moved or
    repeated ones (``n_moved`` lines). So a line goes exactly if it lies in a run of lines with ``least`` characters
    together that an earlier row has in the same order without others between. Blank lines go if
    the lines before and after them go; they never pair rows.

    A key is one row of the shuffle and meets one first row, so the work grows with the lines, whatever their frequency
    and the length of a document. Null or empty text is one empty line and stays. Repeated rows are later rows too, all
    but one of rows that agree in id and text count once and get equal results. An empty table gives no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(ID_LIMIT)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    lines = keyed.select("d", "t", F.transform(trimmed, lambda x: F.xxhash64(x)).alias("hashes"), F.transform(trimmed, lambda x: F.char_length(x)).alias("sizes"))
    each = materialize(map_arrow(lines.dropDuplicates(["d", "t"]), _keys(least), "d long, t long, h long, a int, b int, x int"), "keys")

    row = F.struct("d", "t")
    shared = each.groupBy("h").agg(F.min(F.struct("d", "t", "a")).alias("first"), F.max(row).alias("last")).filter("first.d < last.d OR first.t < last.t")
    met = each.join(shared.select("h", F.col("first.d").alias("pd"), F.col("first.t").alias("pt"), F.col("first.a").alias("pa")), "h").filter("NOT (d = pd AND t = pt)")
    gathered = met.groupBy("d", "t").agg(F.collect_list(F.struct("pd", "pt", "a", "b", "x", "pa", "h")).alias("met"))
    cuts = materialize(map_arrow(gathered, _blocks, "d long, t long, n_partners long, n_moved long, cuts array<int>"), "cuts")

    found = keyed.join(cuts, ["d", "t"], "left").withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    none = F.lit(0).cast("long")
    whole = found.filter("cuts IS NULL").select("d", "n_lines", none.alias("n_partners"), none.alias("n_moved"), none.alias("n_removed"), F.col("text").alias("kept_text"))
    cut = map_arrow(found.filter("cuts IS NOT NULL").drop("t"), _cut, "d long, n_lines long, n_partners long, n_moved long, n_removed long, kept_text string")
    return whole.unionByName(cut).select(
        F.nullif("d", F.lit(ID_LIMIT)).alias("doc_id"), "n_lines", "n_removed", "n_moved", "n_partners", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), *(["kept_text"] if with_text else []),
    )
