"""Token counts of sections from one encoding of the whole document, by character offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweave.llm.common import map_arrow, slices
from coinweave.llm.tokens import vocabulary

_ENCODINGS: dict[str, tuple] = {}
COUNTS = pa.schema(
    [("doc_id", pa.int64()), ("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
     ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())]
)


def encoding(path: str) -> tuple:
    """(encoder, bytes of each token id), one in a Python worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODINGS[path]


def token_spans(sizes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character span [start, end) of tokens of ``sizes`` bytes each; ``chars`` is the index of the character
    each byte belongs to. A token of part of a character spans that character."""
    last = np.cumsum(sizes) - 1
    return chars[last - sizes + 1], chars[last] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a border). ``borders`` are the sections' first characters,
    in order, from 0. A token that crosses goes to the section with most of its characters, the earlier
    one of equals."""
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, ends - 1, "right") - 1
    crossing = np.flatnonzero(first < last)
    section = first
    for i in crossing:
        inner = borders[first[i] + 1 : last[i] + 1]
        cuts = np.concatenate([[starts[i]], inner, [ends[i]]])
        section[i] += int(np.argmax(np.diff(cuts)))
    flag = np.zeros(len(starts), bool)
    flag[crossing] = True
    return section, flag


def sections_of(text: bytes, encode, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, tokens, crossing tokens) of each line of a text, line end included, and all its tokens."""
    data = np.frombuffer(text, np.uint8)
    chars = np.cumsum((data & 0xC0) != 0x80) - 1
    total = int(chars[-1]) + 1 if len(chars) else 0
    borders = np.concatenate([[0], chars[np.flatnonzero(data == 10)] + 1])
    if len(borders) > 1 and borders[-1] == total:
        borders = borders[:-1]  # a final line end opens no further section
    if not total:
        return borders[:1], borders[:1], np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    ids = np.asarray(encode(text.decode()), np.int64)
    section, crosses = attribute(*token_spans(sizes[ids], chars), borders)
    n = len(borders)
    return borders, np.append(borders[1:], total), np.bincount(section, minlength=n), np.bincount(section[crosses], minlength=n), len(ids)


def section_tokens(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """One row per section (line) of each row of ``docs`` (doc_id, text, any others): doc_id, section, start,
    end (characters), n_tokens, n_crossing, doc_tokens.

    Every text is encoded once, whole, without special tokens; the tokens' character spans are joined with
    the sections' intervals, and a token over a border goes to the section that has most of its characters,
    the earlier of equals. So the sections of a text add up to its tokens. Null or empty text: one empty
    section without tokens. Equal rows are counted each. No shuffle."""
    path = vocabulary_path or vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = encoding(path)
        for batch in batches:
            texts, names = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                found = [sections_of(t or b"", encoder.encode_ordinary, sizes) for t in texts[a:b]]
                n = np.array([len(f[0]) for f in found])
                at = np.repeat(np.arange(b - a), n)
                columns = [np.concatenate([f[k] for f in found]) for k in range(4)]
                section = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                ids = pa.array(names[a:b], pa.int64()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(section), *map(pa.array, columns), pa.array(np.array([f[4] for f in found], np.int64)[at])], schema=COUNTS
                )

    schema = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
