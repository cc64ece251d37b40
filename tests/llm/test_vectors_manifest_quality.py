"""Vector codes, Merkle manifest, quality rules: each against a direct implementation."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from coinweave.llm.common import crc_mod
from coinweave.llm.merkle import fold, leaf_digest, manifest, proof_text
from coinweave.llm.quality_rules import LEAST_WORDS, UNIT, base_counts, fit, judge, log_ratio, ngrams, tokens, trusted_sample
from coinweave.llm.vector_codes import compress

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, codes string, ids long, __v string, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, "y", 2) for i, v, c in rows], VECTORS)


def kmeans(rows, parts, entries, rounds, scale=4096):
    """The same codes by loops over Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    first = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[:entries]
    cut = lambda v: [(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    cost = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (cost(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[nearest(cut(v)[p], p)].append(cut(v)[p])
            for e, members in got.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    out = []
    for i, v, c in kept:
        chosen = [nearest(x, p) for p, x in enumerate(cut(v))]
        out.append((i, c, "".join(f"{e:02x}" for e in chosen), sum(cost(x, books[p][e]) for p, (x, e) in enumerate(zip(cut(v), chosen)))))
    return out, books


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("parts, entries, rounds", [(4, 3, 3), (2, 16, 2), (3, 2, 1)])
def test_vector_codes_against_loops(spark, parts, entries, rounds):
    rng = random.Random(parts)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [(60, None, 1), (61, [0.5] * 7 + [None], 1), (62, [0.5] * 7 + [NAN], 1), (63, [-INF] + [0.0] * 7, 2), (3, rows[3][1], 9), (3, [0.25] * 8, 9), (None, [-0.125] * 8, 1)]
    rows += [(100 + i, [0.5, -0.5] * 4, 1) for i in range(30)] + [(200, [0.1, -0.2, 0.3], 1), (201, [], 1), (-5, [0.0] * 8, 1)]
    got, books = compress(vectors(spark, rows), parts=parts, entries=entries, rounds=rounds)
    want, made = kmeans(rows, parts, entries, rounds)
    assert books.tolist() == made
    assert order((r.vec_id, r.label, r.code, r.error) for r in got.collect()) == order(want)


def test_vector_codes_of_few_or_no_vectors(spark):
    got, books = compress(vectors(spark, [(1, None, 1), (2, [NAN], 1)]))
    assert got.columns == ["vec_id", "label", "code", "error"] and got.count() == 0 and books.size == 0
    rows = [(7, [0.1] * 16, None), (7, [0.1] * 16, None), (9, [0.2] * 16, 1)]
    got, _ = compress(vectors(spark, rows))
    assert order(tuple(r) for r in got.collect()) == order(kmeans(rows, 8, 16, 6)[0])
    assert {r.error for r in got.collect()} == {0}


def test_vector_codes_refuse_what_overflows(spark):
    with pytest.raises(Exception, match="overflow"):
        compress(vectors(spark, [(1, [1e30] * 8, 1)]))[0].collect()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests, fanout):
    """(root, siblings before and after each leaf on its way up)."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for way, i in zip(ways, at):
            first = i // fanout * fanout
            way.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], ways


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def proofs(rows, fanout):
    groups = defaultdict(list)
    for doc_id, source, text in rows:
        groups[source].append((doc_id is not None, doc_id or 0, sha(field(doc_id), field(source), field(text)), doc_id, source, text))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([m[2] for m in sorted(groups[s], key=lambda m: m[:3])], fanout) for s in names]
    root, tops = tree([t[0] for t in trees], fanout)
    out = []
    for s, (subroot, ways), top in zip(names, trees, tops):
        for m, way in zip(sorted(groups[s], key=lambda m: m[:3]), ways):
            digest = sha(field(m[3]), field(s), field(m[5] and m[5].replace("A", "a")))
            for left, right in way + top:
                digest = sha(left, digest, right)
            out.append((m[3], m[2], subroot, root, sha(*[x + y for x, y in way + top]), digest))
    return out


MANIFEST = "doc_id long, source string, text string, tree int, level int, pos long, g string, digest string, members string, i int"


def proved(spark, rows, fanout):
    docs = spark.createDataFrame([(*r, 1, 2, 3, "g", "d", "m", 4) for r in rows], MANIFEST)
    fields = [F.col("doc_id"), F.col("source")]
    found = manifest(docs, "doc_id", "source", leaf_digest(*fields, F.col("text")), leaf_digest(*fields, F.replace("text", F.lit("A"), F.lit("a"))), fanout)
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256), fold(F.col("other_leaf"), F.col("path"))).collect()]


@pytest.mark.parametrize("fanout, sources", [(2, 5), (3, 11), (16, 20)])
def test_manifest_against_a_recursive_tree(spark, fanout, sources):
    rng = random.Random(fanout)
    rows = [(i, "hot" if rng.random() < 0.4 else f"s{rng.randrange(sources)}", rng.choice([None, "", "A é", "plain", "tAt" * 50])) for i in range(300)]
    rows += [(1000, "alone", "A"), (1001, None, "x"), (None, None, "y"), (None, "hot", None), (1002, "", "empty name"), (1003, "é", "A"), (1004, "zz", None)]
    rows += [rows[3], rows[3], (5, "hot", "tie"), (5, "hot", "A tie"), (-7, "hot", "long " * 30_000)]
    got = proved(spark, rows, fanout)
    assert order(got) == order(proofs(rows, fanout))
    assert any(r[5] == r[3] for r in got) and any(r[5] != r[3] for r in got)


@pytest.mark.parametrize("rows", [[(1, "s", "A")], [(i, "s", "x") for i in range(16)], [(i, "s", "x") for i in range(17)], [(i, f"s{i}", "x") for i in range(17)], [(1, None, None)] * 3])
def test_manifest_of_small_tables(spark, rows):
    assert order(proved(spark, rows, 16)) == order(proofs(rows, 16))


def test_manifest_of_no_rows(spark):
    assert proved(spark, [], 16) == []


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def word_hash(word):
    data, base = word.encode(), 0x9E3779B97F4A7C15
    own = sum(mixed((b + 1) * 0x2545F4914F6CDD1D % 2**64) * pow(base, k, 2**64) for k, b in enumerate(data))
    return mixed((own + len(data) * 0xD1342543DE82EF95) % 2**64)


def buckets_of(text, buckets):
    words = [word_hash(w) for w in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
    pairs = [mixed((a * 0x9FB21C651E98DF25 + b) % 2**64) for a, b in zip(words, words[1:])]
    return [h // (2**64 // buckets) for h in words + pairs]


def direct_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dups = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def judged_texts():
    rng = random.Random(11)
    clean = [(i, " ".join(cases.words(rng, rng.randrange(40, 200), 60))) for i in range(80)]
    junk = [(100 + i, " | ".join(cases.words(rng, rng.randrange(60, 120), 60)) + " ###") for i in range(30)]
    odd = [(200, None), (201, ""), (202, " \n\t"), (203, "a b c " * 40), (204, "a\n\na\n a\na\n"), (None, clean[3][1]), (205, "é ß ½ ² | <x> a_b\x1cc"), (3, clean[3][1]), (206, "long text " * 40_000)]
    return clean + junk + odd + cases.texts()


def test_base_counts_against_a_direct_count():
    rows = [t for _, t in judged_texts()]
    got = base_counts(rows)
    assert [tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(rows))] == [direct_counts(t) for t in rows]


def test_ngrams_against_a_direct_hash():
    rows = ["One two, two ÉÉ\n\n##x", None, "", "...", "a"]
    found, n = ngrams(rows, 1 << 10)
    assert n.tolist() == [len(buckets_of(t, 1 << 10)) for t in rows]
    assert found.tolist() == [b for t in rows for b in buckets_of(t, 1 << 10)]
    assert tokens("It's x_1--Y") == ["it", "'", "s", "x_1", "--", "y"]


def test_judgement_against_a_direct_ratio(spark):
    rows, size = judged_texts(), 1 << 10
    docs = cases.frame(spark, rows)
    good = {i for i, _ in rows if i is not None and i < 60}
    trusted = spark.createDataFrame([(i,) for i in [*good, 5, 5, None, 999]], "doc_id long")
    got = judge(docs, fit(docs, trusted, size), -0.2).collect()
    raw, own = np.zeros(size), np.zeros(size)
    for i, t in rows:
        for b in buckets_of(t, size):
            raw[b] += 1
            own[b] += i in good
    share = lambda c: (c + 0.1 * c.sum() / size) / (c + 0.1 * c.sum() / size).sum()
    ratio = np.log(share(own) / share(raw))
    want = []
    for i, t in rows:
        base, grams = direct_counts(t), buckets_of(t, size)
        score = sum(ratio[b] for b in grams) / max(1, len(grams))
        failed = base[0] < LEAST_WORDS or 2 * base[4] > base[0]
        want.append((i, *base, failed, not failed and score >= -0.2, round(score, 4)))
    assert order((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 4)) for r in got) == order(want)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[100 + i] for i in range(30)) and sum(kept[i] for i in range(60, 80)) > 10


def test_judgement_without_rows_or_trust(spark):
    none = spark.createDataFrame([], "doc_id long")
    empty = cases.frame(spark, [])
    assert judge(empty, fit(empty, none)).count() == 0
    docs = cases.frame(spark)
    assert not fit(docs, none).any()
    got = judge(docs, fit(docs, none))
    assert got.count() == len(cases.texts()) and got.filter("kept = base_failed").count() == 0
    assert not log_ratio(np.zeros(4), np.ones(4)).any() and UNIT > 1 << 20


def test_trusted_sample_is_bounded(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert trusted_sample(ids, 5000).count() == 5000
    some = trusted_sample(ids, 500)
    assert 300 < some.count() <= 1000 and sorted(some.collect()) == sorted(trusted_sample(ids.union(ids), 500).collect())


def test_crc_of_ids(spark):
    got = {r.id: r.c for r in spark.range(50).select("id", crc_mod(F.col("id"), 5).alias("c")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}
