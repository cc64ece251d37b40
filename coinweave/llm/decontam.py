"""Benchmark decontamination by latent semantic retrieval with subsequence and answer checks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweave.llm.common import map_arrow, ship
from coinweave.session import materialize

#: Words of a passage (a window of an item or of a document). Items of fewer words are met by shorter windows.
#: Windows of an item move by half, those of a document by a quarter of their length.
PASSAGE, SIZES = 32, (8, 16, 32)
#: Benchmark passages of one block: a block's vocabulary and latent vectors are what is broadcast, at most
#: BLOCK * PASSAGE terms of RANK floats. Larger benchmarks are searched block by block. Inside a block each RANK
#: passages have a latent space of their own, so that it holds all of every passage.
BLOCK, RANK, EXTRA = 2048, 256, 8
#: Cosine that makes a candidate; shares of an item's words in a document's span, in order, that decide alone
#: or together with the item's last sentence.
COSINE, SURE, LIKELY, ANSWER = 0.3, 0.8, 0.6, 0.9
#: Share of a passage's squared norm that makes a candidate whatever else the window has: the product with the
#: window is measured by the passage alone, so that foreign words and their weights do not matter. A window that
#: holds the whole passage has at least 1.
COVER = 0.5
#: Items of fewer words count only where they occur word by word.
SHORT = 8
_PUNCTUATION = bytes(32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c for c in range(256))
_SENTENCE = re.compile(rb"[.!?\n]+\s*")


def normal_words(text: bytes | None) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    if not text:
        return []
    return (text.lower() if text.isascii() else text.decode().lower().encode()).translate(_PUNCTUATION).split()


def passage_starts(n: int, size: int, step: int) -> list[int]:
    """Starts of windows that cover ``n`` words; the last ends with them. Fewer words than ``size``: one window."""
    if n <= size:
        return [0] if n else []
    return [*range(0, n - size, step), n - size]


def item_passages(words: list[bytes]) -> list[int]:
    return passage_starts(len(words), PASSAGE, PASSAGE // 2)


def answer_of(text: bytes) -> list[bytes]:
    """Words of the last sentence or line of an item."""
    parts = [w for s in _SENTENCE.split(text) if (w := normal_words(s))]
    return parts[-1] if parts else []


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & masks.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def contains(seq: list[bytes], part: list[bytes]) -> bool:
    n = len(part)
    return any(seq[i : i + n] == part for i in range(len(seq) - n + 1))


class Items:
    """A block of benchmark items: their words, passages, weights and latent vectors."""

    def __init__(self, texts: dict[int, bytes]):
        self.words = {k: normal_words(t) for k, t in texts.items()}
        self.answers = {k: answer_of(t) for k, t in texts.items()}
        sized = [(next((c for c in SIZES if len(w) <= c), PASSAGE), k, s) for k, w in self.words.items() for s in item_passages(w)]
        #: Window length of each passage, in order, and the passage's item and first word.
        self.sizes = np.array([c for c, _, _ in sorted(sized)], np.int64)
        self.passages = [(k, s) for _, k, s in sorted(sized)]
        self.vocabulary = {w: i for i, w in enumerate(sorted(set().union(*map(set, self.words.values())) if self.words else set()))}
        self.spaces = []

    def norm_of(self, passage: int) -> float:
        terms = np.array(list(Counter(self.terms_of(passage)).items()))
        return float(np.linalg.norm(terms[:, 1] * self.idf[terms[:, 0]]))

    def terms_of(self, passage: int) -> list[int]:
        k, s = self.passages[passage]
        return [self.vocabulary[w] for w in self.words[k][s : s + PASSAGE]]

    def weigh(self, idf: np.ndarray, foreign: float, terms: np.ndarray | None = None, queries: np.ndarray | None = None) -> None:
        """Set the terms' weights and the weight of words of no item; with latent vectors of terms and passages,
        one space for all passages."""
        self.idf, self.squares = idf, np.append(idf * idf, foreign * foreign)
        if terms is not None:
            self.add_space(0, terms, queries)

    def add_space(self, first: int, terms: np.ndarray, queries: np.ndarray) -> None:
        """Add the latent vectors of terms and of the passages from ``first`` on."""
        used = np.flatnonzero(terms.any(axis=1))
        at = np.full(len(self.vocabulary) + 1, len(used), np.int32)
        at[used] = np.arange(len(used))
        vectors = np.vstack([terms[used] * self.idf[used, None], np.zeros((1, terms.shape[1]))]).astype(np.float32)
        #: For each window length its passages, their vectors and norms, their terms, and the most that a term adds
        #: to the product with any of them over its norm and over its square; the last place stands for all other words.
        parts = []
        for size in SIZES:
            a, b = first + np.searchsorted(self.sizes[first : first + len(queries)], [size, size + 1])
            if a < b:
                own = np.zeros(len(self.vocabulary) + 1, bool)
                most, norms = np.zeros((2, len(self.vocabulary) + 1)), np.array([self.norm_of(p) for p in range(a, b)])
                for p, norm in zip(range(a, b), norms):
                    for t, c in Counter(self.terms_of(p)).items():
                        own[t] = True
                        x = c * self.squares[t] / norm
                        most[:, t] = np.maximum(most[:, t], [x, x / norm])
                parts.append((size, a, queries[a - first : b - first].astype(np.float32), norms.astype(np.float32), own, most))
        self.spaces.append((at, vectors, parts))

    def verdict(self, item: int, offset: int, start: int, words: list[bytes]) -> tuple[float, bool, bool]:
        """(share of the item's words found in order, answer found, contaminated) where a window at ``start`` of a
        document's words looks like the item's passage at ``offset``."""
        own = self.words[item]
        slack = PASSAGE // 4 + 4 + len(own) // 4
        span = words[max(0, start - offset - slack) : start - offset + len(own) + slack]
        inside = set(span)
        if sum(w in inside for w in own) < LIKELY * len(own):
            return 0.0, False, False
        share = common_subsequence(own, span) / len(own)
        answer = self.answers[item]
        answered = bool(answer) and common_subsequence(answer, span) >= ANSWER * len(answer)
        if len(own) < SHORT:
            return share, answered, contains(span, own)
        return share, answered, share >= SURE or (share >= LIKELY and answered)

    def candidates(self, words: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """(item, passage offset, window start, cosine) of windows near a passage, or that cover it together with
        the words up to the next window's end: any copy of a passage lies whole in one such span. The norm of a
        window counts all its words. A window in which the terms of its length's passages weigh too little to
        reach the cosine or the cover is passed over: no projection of it is longer than they are, and no product
        larger than the sum of what each term adds at most."""
        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        squares = self.squares[ids]
        mass = np.concatenate([[0.0], np.cumsum(squares)])
        for at, vectors, parts in self.spaces:
            local = np.append(at[ids], len(vectors) - 1)
            for size, first, queries, norms, own, most in parts:
                step = size // 4
                inside = np.concatenate([[0.0], np.cumsum(squares * own[ids])])
                near_sum, cover_sum = (np.concatenate([[0.0], np.cumsum(m[ids])]) for m in most)
                starts = np.append(np.arange(0, max(0, n - size), step), max(0, n - size))
                ends, far = np.minimum(starts + size, n), np.minimum(starts + size + step, n)
                total = mass[ends] - mass[starts]
                near = (inside[ends] - inside[starts] >= COSINE * COSINE * total) & (near_sum[ends] - near_sum[starts] >= (COSINE - 1e-6) * np.sqrt(total))
                near = np.flatnonzero(near | (cover_sum[far] - cover_sum[starts] >= COVER - 1e-6))
                for i in range(0, len(near), 128):
                    w = near[i : i + 128]
                    places = np.minimum(starts[w][:, None] + np.arange(size + step), n)
                    rows = vectors[local[places]]
                    latent = rows[:, :size].sum(axis=1)
                    cover = (latent + rows[:, size:].sum(axis=1)) @ queries.T / norms
                    # Repeated words: the norm is at least that of the projection.
                    norm = np.sqrt(np.maximum(total[w], (latent * latent).sum(axis=1)))
                    cosine = latent @ queries.T / np.maximum(norm, 1e-9)[:, None]
                    for row, p in zip(*np.nonzero((cosine >= COSINE) | (cover >= COVER))):
                        yield *self.passages[first + p], int(starts[w[row]]), min(1.0, float(cosine[row, p]))


def _vectors_of(frame: pd.DataFrame, name: str) -> np.ndarray:
    return np.stack(frame[name].to_numpy()) if len(frame) else np.zeros((0, 0))


def _times(entries: DataFrame, vectors: DataFrame, to: str, by: str, blocks: int) -> DataFrame:
    """(to, v): sums of a * v over the entries (p, t, a) of each ``to``, with the vectors of ``by``."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(pdf[to].to_numpy(), return_inverse=True)
        out = np.zeros((len(keys), len(pdf["v"].iloc[0])))
        np.add.at(out, at, _vectors_of(pdf, "v") * pdf["a"].to_numpy()[:, None])
        return pd.DataFrame({to: keys, "v": list(out)})

    joined = entries.join(vectors, by).withColumn("block", F.pmod(F.xxhash64(to), F.lit(blocks)))
    return materialize(joined.groupBy("block").applyInPandas(add, f"{to} long, v array<double>"), "product")


def _gram(vectors: DataFrame) -> np.ndarray:
    """Sum of v v' over all vectors; each task sends one small square."""

    def square(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                x = _vectors_of(f, "v")
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel()]})

    parts = [np.array(r["g"]) for r in vectors.select("v").mapInPandas(square, "g array<double>").toLocalIterator()]
    size = int(len(parts[0]) ** 0.5)
    return sum(parts).reshape(size, size)


def _turned(vectors: DataFrame, turn: np.ndarray, key: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({key: f[key], "v": list(_vectors_of(f, "v") @ turn)})

    return vectors.mapInPandas(run, f"{key} long, v array<double>")


def _orthonormal(vectors: DataFrame, key: str) -> DataFrame:
    values, basis = np.linalg.eigh(_gram(vectors))
    good = values > max(values.max() * 1e-10, 1e-300)
    return _turned(vectors, basis[:, good] / np.sqrt(values[good]), key)


def latent_terms(entries: DataFrame, terms: int, passages: int, rank: int = RANK) -> np.ndarray:
    """(terms x rank) right singular vectors of a sparse matrix given as (p, t, a), by a randomised range
    finder with one power step (Halko, Martinsson and Tropp, 2011). The products run as joins and grouped
    sums over blocks of rows; only squares of side rank + EXTRA and the term vectors reach the driver."""
    width = min(rank + EXTRA, max(1, min(passages, terms)))
    blocks = max(1, min(64, passages // 64))

    def random(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"t": f["t"], "v": [np.random.Generator(np.random.Philox(key=int(t) + 1)).standard_normal(width) for t in f["t"]]})

    start = entries.select("t").distinct().mapInPandas(random, "t long, v array<double>")
    left = _orthonormal(_times(entries, start, "p", "t", blocks), "p")
    left = _orthonormal(_times(entries, _times(entries, left, "t", "p", blocks), "p", "t", blocks), "p")
    small = _times(entries, left, "t", "p", blocks)
    values, basis = np.linalg.eigh(_gram(small))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > max(values.max() * 1e-10, 1e-300)]
    found = _turned(small, basis[:, keep] / np.sqrt(values[keep]), "t").toArrow()
    out = np.zeros((terms, len(keep)), np.float32)
    out[found.column("t").to_numpy()] = np.array(found.column("v").to_pylist(), np.float32)
    return out


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Rows of ``docs`` with each benchmark term, and rows, over all documents: a task sends one row a term."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, rows = shared.value, Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for t in batch.column("text").cast(pa.binary()):
                counts.update(terms.intersection(normal_words(t.as_py())))
        counts[None] = rows
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["term", "n"])

    found = map_arrow(docs.select(F.col("text").cast("string")), run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out, rows = np.zeros(len(vocabulary), np.int64), 0
    for term, n in zip(found.column("term").to_pylist(), found.column("n").to_pylist()):
        if term is None:
            rows = n
        else:
            out[vocabulary[term]] = n
    return out, rows


def _prepare(docs: DataFrame, texts: dict[int, bytes]) -> Items:
    """The block's weights, from all documents, and latent vectors."""
    spark, items = docs.sparkSession, Items(texts)
    seen, rows = document_frequencies(docs, items.vocabulary)
    idf, foreign = np.log((rows + 2) / (seen + 1)), float(np.log(rows + 2))
    items.weigh(idf, foreign)
    for first in range(0, len(items.passages), RANK):
        grams = []
        for p in range(first, min(first + RANK, len(items.passages))):
            counts = Counter(items.terms_of(p))
            a = np.array(list(counts.values())) * idf[list(counts)]
            grams.append(pd.DataFrame({"p": p - first, "t": list(counts), "a": a / max(np.sqrt(a @ a), 1e-9)}))
        table = pd.concat(grams)
        entries = materialize(spark.createDataFrame(table, "p long, t long, a double").repartition(1, "p"), "entries")
        terms = latent_terms(entries, len(items.vocabulary), len(grams))
        queries = np.zeros((len(grams), terms.shape[1]))
        np.add.at(queries, table["p"].to_numpy(), terms[table["t"].to_numpy()] * table["a"].to_numpy()[:, None])
        items.add_space(first, terms, queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9))
    return items


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, text_hash (xxhash64 of the text; with the id it names the
    document), item_id, cosine, share, answer_found, start (word of the window). ``docs`` has doc_id and text, ``benchmark`` item_id and text, both any others.

    Windows of 8, 16 or 32 words (as the items have) of every whole text are compared with the benchmark's passages in a latent space: a
    randomised SVD of the TF-IDF matrix of each RANK passages, document frequencies from all of ``docs``. Candidates of
    enough cosine, or that cover enough of a passage, are checked against the item's words: the longest common subsequence with the span where
    the item would lie, and the item's last sentence as its answer. Texts or items that are null or have no
    word match nothing; a null id is an id like any other; rows that agree in id and text count once; items under eight words must
    occur word by word. The benchmark is the query set: it is read in blocks of bounded size, each block
    broadcast, and documents are neither shuffled nor joined."""
    ship(docs.sparkSession)
    wanted = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"))
    # Passages of an item by its length, so that blocks are bounded; an item over the bound is a block of its own.
    parts = wanted.groupBy("item_id", "text").agg(F.lit(1).alias("one"))
    out = None
    for texts in _blocks(parts):
        items = _prepare(docs, texts)
        found = _search(docs, items)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return docs.limit(0).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.lit(None).cast(t).alias(n) for n, t in _FOUND[1:]])
    best = F.max_by(F.struct("cosine", "share", "answer_found", "start"), F.struct("share", "cosine", -F.col("start"))).alias("b")
    return out.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "b.*")


_FOUND = [("doc_id", "long"), ("text_hash", "long"), ("item_id", "long"), ("cosine", "double"), ("share", "double"), ("answer_found", "boolean"), ("start", "long")]


def _blocks(items: DataFrame) -> Iterator[dict[int, bytes]]:
    """Items in blocks of about BLOCK passages, read one Spark partition at a time. Of items with one id the
    texts are joined, as one item."""
    block, size = {}, 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        text = r["text"].encode()
        if not normal_words(text):
            continue
        n = len(item_passages(normal_words(text)))
        if block and size + n > BLOCK and r["item_id"] not in block:
            yield block
            block, size = {}, 0
        block[r["item_id"]] = block[r["item_id"]] + b"\n" + text if r["item_id"] in block else text
        size += n
    if block:
        yield block


def _search(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text").cast(pa.binary())):
                words = normal_words(text.as_py())
                best: dict[int, tuple] = {}
                for item, offset, start, cosine in items.candidates(words) if words else ():
                    share, answered, bad = items.verdict(item, offset, start, words)
                    if bad and (item not in best or (share, cosine) > best[item][:2]):
                        best[item] = share, cosine, answered, start
                rows.extend((doc_id, text_hash, item, cosine, share, answered, start) for item, (share, cosine, answered, start) in best.items())
            columns = zip(*rows) if rows else [[]] * len(_FOUND)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[n for n, _ in _FOUND])

    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return map_arrow(slim, run, ", ".join(f"{n} {t}" for n, t in _FOUND))
