"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweave.llm.common import map_arrow, mix, slices
from coinweave.session import materialize

ORDER = 5
#: Labelled rows to learn from and to calibrate on, for each language: those with the smallest hashes of the id.
TRAIN_DOCS = 1500
#: A text goes as rejected where its cross-entropy exceeds this quantile of the calibration rows of its language
#: times the slack, and by the room in any case (decimal digits a symbol). All lean towards keeping.
KEEP_QUANTILE, SLACK, ROOM = 0.999, 1.5, 0.5
#: Characters of evidence at which the score saturates.
EVIDENCE = 40
REMEMBERED = 300_000
UNKNOWN = "und"
START, END = "\x02", "\x03"
_WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Lower-case runs of letters; number signs such as \u00bd, \u00b2 or \u2167 are none."""
    words = _WORDS.findall(text.lower()) if text else []
    if not text or text.isascii():
        return words
    out = []
    for w in words:
        out.extend([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())
    return out


def padded(word: str) -> str:
    return START * (ORDER - 1) + word + END


def gram_hash(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of rows of code points."""
    h = np.full(len(codes), 0x243F6A8885A308D3, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            h = mix((h ^ codes[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return h


class Model:
    """Log10 probabilities and back-off weights of all languages, each kind one sorted array of hashes."""

    def __init__(self, languages: list[str], floor: list[float], tables: dict, limits: list[float]):
        self.languages, self.floor, self.tables, self.limits = languages, floor, tables, limits

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, values = table
        if not len(hashes):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return hashes[at] == keys, values[at]

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages) log10 probability of each word with its end, and symbols of each word."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        text = np.frombuffer("".join(padded(w) for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        grams = text[at[:, None] + np.arange(ORDER)]
        keys = [gram_hash(grams[:, ORDER - k :]) for k in range(1, ORDER + 1)]
        contexts = [None] + [gram_hash(grams[:, ORDER - k : -1]) for k in range(2, ORDER + 1)]
        out = np.empty((len(words), len(self.languages)))
        begin = np.cumsum(sizes) - sizes
        for j in range(len(self.languages)):
            found, value = self._find(self.tables[j, 1, "p"], keys[0])
            value = np.where(found, value, self.floor[j])
            for k in range(2, ORDER + 1):
                known, weight = self._find(self.tables[j, k, "w"], contexts[k - 1])
                found, own = self._find(self.tables[j, k, "p"], keys[k - 1])
                value = np.where(found, own, value + np.where(known, weight, 0.0))
            out[:, j] = np.add.reduceat(value, begin)
        return out, sizes


class Scorer:
    """Scores of texts; the scores of repeated words are remembered inside a worker."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.scores, self.sizes = np.zeros((1024, len(model.languages))), np.zeros(1024, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) log10 probability, and symbols of each text (0: no letter)."""
        split = [letters(t) for t in texts]
        fresh = set().union(*split) - self.place.keys() if split else set()
        if len(self.place) + len(fresh) > REMEMBERED:
            self.place.clear()
            fresh = set().union(*split)
        new = list(fresh)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            scores, sizes = self.model.word_scores(part)
            base = len(self.place)
            if base + len(part) > len(self.sizes):
                room = max(2 * len(self.sizes), base + len(part))
                self.scores = np.concatenate([self.scores, np.zeros((room - len(self.scores), self.scores.shape[1]))])
                self.sizes = np.concatenate([self.sizes, np.zeros(room - len(self.sizes), np.int64)])
            self.scores[base : base + len(part)], self.sizes[base : base + len(part)] = scores, sizes
            self.place.update(zip(part, range(base, base + len(part))))
        counts = np.array([len(s) for s in split], np.int64)
        get = self.place.__getitem__
        at = np.fromiter((get(w) for s in split for w in s), np.int64, int(counts.sum()))
        totals, symbols = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        some = np.flatnonzero(counts)
        if len(some):
            begin = (np.cumsum(counts) - counts)[some]
            totals[some] = np.add.reduceat(self.scores[at], begin)
            symbols[some] = np.add.reduceat(self.sizes[at], begin)
        return totals, symbols


def training_rows(docs: DataFrame, may_learn: Column, limit: int) -> DataFrame:
    """(doc_id, text, lang, fold) of at most ``limit`` labelled rows of each language. Their ids are picked
    first (a rank limit, applied before the shuffle too); four in five are for counts, the fifth to calibrate."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    usable = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.coalesce("lang", F.lit("")) != UNKNOWN))
    picked = usable.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    picked = picked.select("doc_id", "lang", (F.col("place") % 5 == 0).alias("calibrate")).dropDuplicates(["doc_id", "lang"])
    return materialize(usable.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(picked, ["doc_id", "lang"]), "labelled")


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, g, c): n-grams of the highest order, counted by task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(langs, texts):
                for w in letters(text):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
            grams: dict[tuple[str, str], int] = {}
            for (lang, w), n in counts.items():
                p = padded(w)
                for i in range(len(w) + 1):
                    key = lang, p[i : i + ORDER]
                    grams[key] = grams.get(key, 0) + n
            keys = list(grams)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "g": pa.array([k[1] for k in keys], pa.string()), "c": pa.array(grams.values(), pa.int64())})

    return map_arrow(rows.select("lang", "text"), run, "lang string, g string, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, k, kind, g, v): interpolated probabilities ``p`` of n-grams and weights ``w`` of contexts, for
    orders 1 to ORDER. Lower orders count the distinct symbols before an n-gram; the discount of an order
    is n1 / (n1 + 2 n2)."""
    levels = {ORDER: materialize(counts, "grams")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = materialize(levels[k + 1].groupBy("lang", F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("c")), "grams")
    parts, below = [], None
    for k in range(1, ORDER + 1):
        level = levels[k].withColumn("h", F.substring("g", 1, k - 1))
        discount = level.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("a"), F.count_if(F.col("c") == 2).alias("b")).select(
            "lang", F.greatest(F.lit(0.1), F.coalesce(F.col("a") / F.nullif(F.col("a") + 2 * F.col("b"), F.lit(0)), F.lit(0.5))).alias("d")
        )
        context = level.groupBy("lang", "h").agg(F.sum("c").alias("n"), F.count("*").alias("types")).join(discount, "lang")
        joined = level.join(context, ["lang", "h"])
        weight = F.col("d") * F.col("types") / F.col("n")
        own = (F.col("c") - F.least(F.col("d"), F.col("c"))) / F.col("n")
        if k == 1:
            # The last share goes to one symbol more than was seen.
            out = joined.select("lang", "g", (own + weight / (F.col("types") + 1)).alias("p"))
            parts.append(context.select("lang", F.lit(0).alias("k"), F.lit("p").alias("kind"), F.lit("").alias("g"), (weight / (F.col("types") + 1)).alias("v")))
        else:
            lower = below.select("lang", F.col("g").alias("s"), F.col("p").alias("q"))
            out = joined.withColumn("s", F.substring("g", 2, k - 1)).join(lower, ["lang", "s"]).select("lang", "g", (own + weight * F.col("q")).alias("p"))
            parts.append(context.select("lang", F.lit(k).alias("k"), F.lit("w").alias("kind"), F.col("h").alias("g"), weight.alias("v")))
        below = materialize(out, "orders")
        parts.append(below.select("lang", F.lit(k).alias("k"), F.lit("p").alias("kind"), "g", F.col("p").alias("v")))
    return reduce(DataFrame.unionAll, parts)


def fit(docs: DataFrame, may_learn: Column, limit: int = TRAIN_DOCS) -> Model:
    """Model of the languages among the rows to learn from. The n-grams counted are those of at most ``limit``
    rows a language, so the model that is collected and broadcast is bounded by them, not by the corpus."""
    rows = training_rows(docs, may_learn, limit)
    found = kneser_ney(_gram_counts(rows.filter("NOT calibrate"))).toArrow()
    lang, k, kind = (np.array(found.column(c).to_pylist(), dtype=t) for c, t in (("lang", object), ("k", np.int64), ("kind", object)))
    grams, values = np.array(found.column("g").to_pylist(), dtype=object), np.log10(np.maximum(found.column("v").to_numpy(), 1e-12))
    languages = sorted(set(lang.tolist()))
    tables, floor = {}, []
    for j, name in enumerate(languages):
        mine = lang == name
        floor.append(float(values[mine & (k == 0)][0]))
        for order in range(1, ORDER + 1):
            for kd, size in (("p", order), ("w", order - 1)):
                pick = mine & (k == order) & (kind == kd)
                codes = np.frombuffer("".join(grams[pick]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size) if size and pick.any() else np.zeros((0, 1), np.uint32)
                hashes = gram_hash(codes)
                by = np.argsort(hashes)
                tables[j, order, kd] = hashes[by], values[pick][by] if len(by) else np.zeros(0)
    model = Model(languages, floor, tables, [float("inf")] * len(languages))
    if languages:
        held = predict(rows.filter("calibrate"), model, "lang")
        limits = held.filter("lang_pred = lang").groupBy("lang").agg(F.percentile("entropy", F.lit(KEEP_QUANTILE)).alias("q")).collect()
        limit_of = {r["lang"]: max(SLACK * r["q"], r["q"] + ROOM) for r in limits}
        model.limits = [limit_of.get(name, float("inf")) for name in languages]
    return model


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The ``keep`` columns of ``docs``, then lang_pred, score, entropy, rejected. Only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"__k{i}" for i in range(len(keep))]
    kept = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        languages = pa.array([*model.languages, UNKNOWN], pa.string())
        limits = np.array([*model.limits, -1.0])
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in slices(texts):
                totals, symbols = scorer(texts[a:b]) if model.languages else (np.zeros((b - a, 1)), np.zeros(b - a, np.int64))
                n = np.maximum(symbols, 1)[:, None]
                entropy = -totals / n
                best = np.where(symbols > 0, entropy.argmin(axis=1), len(model.languages))
                least = entropy.min(axis=1)
                share = np.power(10.0, -(entropy - least[:, None]) * np.minimum(n, EVIDENCE)).sum(axis=1)
                score = np.where(symbols > 0, 1 / share, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in names], languages.take(pa.array(best)), pa.array(score),
                     pa.array(np.where(symbols > 0, least, np.nan), from_pandas=True), pa.array((symbols == 0) | (least > limits[best]))],
                    names=[*names, "lang_pred", "score", "entropy", "rejected"],
                )

    types = dict(kept.dtypes)
    out = map_arrow(kept, run, ", ".join([*[f"{c} {types[c]}" for c in names], "lang_pred string", "score double", "entropy double", "rejected boolean"]))
    return out.withColumnsRenamed(dict(zip(names, keep)))


def identify(docs: DataFrame, may_learn: Column, *keep: str, limit: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, any others): the ``keep`` columns (doc_id if none are
    named), lang_pred, score, entropy, rejected.

    Character models of order 5 inside words (runs of letters, lower case) are learned from labelled rows
    with ``may_learn``; a text gets the language of lowest cross-entropy per symbol, ``und`` with score 0
    and rejected where it is null or has no letter. ``rejected`` is also set where the cross-entropy is
    far above what rows of that language have. Without any labelled row every text is ``und``. Whole
    texts are read; ties go to the first language by name; equal rows get equal answers. No shuffle
    besides the bounded training rows."""
    return predict(docs, fit(docs, may_learn, limit), *(keep or ("doc_id",)))
