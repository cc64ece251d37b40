"""Text quality by hashed n-grams: a log-likelihood ratio between a trusted and the raw multinomial.

Two multinomials over hashed unigrams and bigrams are counted: one over trusted documents, one over all documents.
A text's score is the mean, over its n-grams, of the log ratio of the two. Log ratios are fixed-point numbers, so sums are
exact in any order and the verdict on a text depends on nothing but the text and the two models."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweave.llm.common import map_arrow, mix, slices, split_words, word_hashes

#: Buckets of the two multinomials (a power of two); also the size of what scoring broadcasts. With many more, a small
#: corpus would hold a text's own n-grams against it.
BUCKETS = 1 << 13
#: The trusted multinomial is fitted on about this many labelled rows at most, those of smallest id hash.
TRUSTED_DOCS = 40_000
#: Added to the count of every bucket, as a share of the mean count of a bucket.
SMOOTHING = 0.1
#: Texts under this many nats an n-gram go.
THRESHOLD = -0.25
#: One nat in fixed point.
UNIT = 1 << 24
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

_TOKENS = re.compile(r"\w+|[^\w\s]+")
_BIGRAM = np.uint64(0x9FB21C651E98DF25)


def tokens(text: str) -> list[str]:
    """Lower-case runs of word characters and of punctuation."""
    return _TOKENS.findall(text.lower())


def ngrams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram of some texts, text by text, and how many each text has."""
    split = [tokens(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    # Tokens hold no line break, so the breaks of the joined text are their borders.
    joined = "\n".join(["\n".join(s) for s in split if s]).encode("utf-8", "surrogatepass")
    breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
    some = len(joined) > 0
    starts = np.concatenate([[0], breaks + 1]) if some else breaks
    ends = np.concatenate([breaks, [len(joined)]]) if some else breaks
    single = word_hashes(joined, starts, ends)
    owner = np.repeat(np.arange(len(texts)), counts)
    with np.errstate(over="ignore"):
        pair = mix(single[:-1] * _BIGRAM + single[1:]) if len(single) else single
    together = owner[:-1] == owner[1:]
    hashes = np.concatenate([single, pair[together]])
    order = np.argsort(np.concatenate([owner, owner[:-1][together]]), kind="stable")
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return (hashes[order] >> shift).astype(np.int64), counts + np.maximum(counts - 1, 0)


def log_ratio(trusted: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Fixed-point log of the trusted over the raw probability of each bucket. Without any trusted or raw
    n-gram the ratio is 0 everywhere."""
    if not trusted.sum() or not raw.sum():
        return np.zeros(len(raw), np.int64)

    def shares(counts: np.ndarray) -> np.ndarray:
        own = counts + smoothing * counts.sum() / len(counts)
        return own / own.sum()

    return np.rint((np.log(shares(trusted)) - np.log(shares(raw))) * UNIT).astype(np.int64)


def base_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    joined, starts, ends, n = split_words([t.encode("utf-8", "surrogatepass") if t else None for t in texts])
    h = word_hashes(joined, starts, ends)
    owner = np.repeat(np.arange(len(texts)), n)
    repeated = np.zeros(len(h), bool)
    if len(h) > 2:
        with np.errstate(over="ignore"):
            key = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) + mix(owner[:-2].astype(np.uint64) + np.uint64(1))
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        _, which, times = np.unique(key[inside], return_inverse=True, return_counts=True)
        first = inside[times[which] > 1]
        for k in range(3):
            repeated[first + k] = True

    def dup_lines(text: str) -> int:
        seen: set[str] = set()
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        seen.update(lines)
        return len(lines) - len(seen)

    return {
        "n_words": n,
        "word_chars": np.array([len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) if t else 0 for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in texts], np.int64),
        "n_dup_lines": np.array([dup_lines(t) if t else 0 for t in texts], np.int64),
        "n_repeat_words": np.bincount(owner[repeated], minlength=len(texts)).astype(np.int64),
    }


def trusted_sample(trusted: DataFrame, limit: int = TRUSTED_DOCS) -> DataFrame:
    """Distinct non-null doc_ids, about ``limit`` at most: those whose hash lies in the lowest share. Never more than
    twice the limit, so that they can be broadcast."""
    ids = trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    count, space = ids.count(), 1 << 30
    cut = space if count <= limit else space * limit // count
    while True:
        picked = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < cut)
        if count <= limit or picked.count() <= 2 * limit:
            return picked
        cut //= 2


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, limit: int = TRUSTED_DOCS) -> np.ndarray:
    """Fixed-point log ratio of each bucket: all rows of ``docs`` against those that ``trusted`` (doc_id) names. Tasks add
    up their rows first; what reaches the driver has two numbers a bucket, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts, chosen = batch.column("t").to_pylist(), np.array(batch.column("good").to_pylist(), bool)
            for i, j in slices(texts):
                found, n = ngrams(texts[i:j], buckets)
                raw += np.bincount(found, minlength=buckets)
                good += np.bincount(found[np.repeat(chosen[i:j], n)], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.record_batch({"b": pa.array(at.astype(np.int32)), "raw": pa.array(raw[at]), "good": pa.array(good[at])})

    marked = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("t")).join(
        F.broadcast(trusted_sample(trusted, limit).withColumn("good", F.lit(True))), "doc_id", "left"
    ).select("t", F.coalesce("good", F.lit(False)).alias("good"))
    raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in map_arrow(marked, run, "b int, raw bigint, good bigint").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        raw[r["b"]], good[r["b"]] = r["raw"], r["good"]
    return log_ratio(good, raw)


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any others): doc_id, the base counts, n_ngrams, score (nats an n-gram, 0
    without n-grams), base_failed, kept.

    A text with fewer than 50 words, or with over half of its words in repeated three-word windows, fails the base rules
    and goes; every other text stays if its score is at least ``threshold``. Null text counts as empty and so fails;
    repeated rows and null ids get a row each; an empty table gives no rows."""
    buckets, least = len(ratio), round(threshold * UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for i, j in slices(texts):
                part = texts[i:j]
                base = base_counts(part)
                found, n = ngrams(part, buckets)
                # Sums of fixed-point numbers: the same for a text wherever it stands.
                upto = np.concatenate([[0], np.cumsum(ratio[found])])
                end = np.cumsum(n)
                total = upto[end] - upto[end - n]
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(i, j - i), **{k: pa.array(v) for k, v in base.items()}, "n_ngrams": pa.array(n),
                    "score": pa.array(total / (np.maximum(n, 1) * float(UNIT))), "base_failed": pa.array(failed),
                    "kept": pa.array(~failed & (total >= least * n)),
                })

    schema = "doc_id {}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_ngrams bigint, score double, base_failed boolean, kept boolean"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("t")), run, schema.format(kind))
