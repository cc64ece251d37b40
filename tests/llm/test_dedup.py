"""Exact dedup, line dedup, substring dedup, near-duplicate join."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import frame, texts
from coinweave.llm.exact_dedup import exact_dedup, fuse_build, fuse_probe
from coinweave.llm.line_dedup import aligned, block_keys, join_blocks, patience, remove_common_lines, without_blocks
from coinweave.llm.ngram_join import choose_boundary, jaccard_components, least_overlap, subset_sizes
from coinweave.llm.substring_dedup import remove_repeats, sliding_argmin

LAST = 1 << 62


def place(i):
    return LAST if i is None else i


def test_fuse_filter_holds_all_its_keys():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 100, 3000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        built = fuse_build(keys)
        if n:
            assert fuse_probe(keys, *built).all()
            others = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
            assert fuse_probe(others, *built).mean() < 0.02


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_against_brute_force(spark, weak):
    # A digest of three values puts different texts into one bucket; their bytes keep them apart.
    digest = (lambda c: F.pmod(F.xxhash64(c), F.lit(3))) if weak else F.xxhash64
    got = exact_dedup(frame(spark), F.col("doc_id") % 2 == 0, digest, shard_keys=4).collect()
    groups = defaultdict(list)
    for i, x in texts():
        groups[re.sub("[\x20\x09-\x0d]", "", x or "")].append((-len(x or ""), place(i)))
    want = []
    for norm, members in groups.items():
        for k, m in enumerate(sorted(members)):
            want.append((m[1], sorted(members)[0][1], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted((place(r.doc_id), place(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)
    assert {r.origin for r in got} <= {"snapshot", "both", "batch"}


@pytest.mark.parametrize("in_snapshot", [True, False])
def test_exact_dedup_without_batch_or_snapshot(spark, in_snapshot):
    got = exact_dedup(frame(spark), F.lit(in_snapshot))
    assert got.count() == len(texts())


def test_exact_dedup_is_decided_by_the_screen(spark, monkeypatch):
    from coinweave.llm import exact_dedup as module

    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "c"), (5, "c "), (6, "d")]
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.origin) for r in exact_dedup(frame(spark, rows), F.col("doc_id").isin(1, 6)).collect()}
    assert found[1] == (3, 3, False, "both") and found[3] == (3, 3, True, "both") and found[2] == (3, 3, False, "both")
    assert found[5] == (5, 2, True, "batch") and found[4] == (5, 2, False, "batch") and found[6] == (6, 1, True, "snapshot")
    # Filters that answer yes to everything cost time and change nothing.
    monkeypatch.setattr(module, "screen", lambda digests, filters, shards: digests.select("h").distinct())
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.origin) for r in exact_dedup(frame(spark, rows), F.col("doc_id").isin(1, 6)).collect()}
    assert again == found


def test_exact_dedup_keeps_one_of_identical_rows(spark):
    rows = [(None, "same")] * 300 + [(7, None)] * 5
    got = exact_dedup(frame(spark, rows), F.col("doc_id") == 7).collect()
    assert len(got) == 305 and sum(r.kept for r in got) == 2
    assert {(r.doc_id, r.keep_id, r.group_size, r.origin) for r in got} == {(None, None, 300, "batch"), (7, 7, 5, "snapshot")}


def test_patience_aligns_equal_lines_in_order():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert patience([1, 2, 3, 9], [7, 1, 2, 3, 8]) == [(0, 1), (1, 2), (2, 3)]


def test_aligned_keys_and_joined_blocks():
    # Keys 6, 7, 8, 9 at places 0 to 3 of the earlier row; the later row has 9 first and 8 twice.
    later = [(0, 1, 3, 9), (2, 3, 0, 6), (3, 4, 1, 7), (4, 5, 2, 8), (6, 7, 2, 8)]
    assert aligned(later).tolist() == [False, True, True, True, False]
    assert aligned([(5, 6, 0, 1)]).tolist() == [True]
    first, end = join_blocks(np.array([8, 0, 2, 5]), np.array([9, 2, 3, 6]), np.array([9, 2, 5, 7]))
    assert list(zip(first, end)) == [(0, 6), (8, 9)]
    assert without_blocks("a\nb\nc\nd", [0, 1, 2, 3]) == ("b\nd", 2) and without_blocks("a", [0, 1]) == ("", 1)


def test_line_dedup(spark):
    copies = [(100 + i, "same first line of all\nsame second line of all") for i in range(50)]
    rows = [*texts(), *copies]
    got = {(r.doc_id, r.kept_text): r for r in remove_common_lines(frame(spark, rows), least=10).collect()}
    assert sum(1 for _ in got) <= len(rows)
    assert (53, "own\nrest") in got and got[53, "own\nrest"].n_removed == 2
    assert (100, copies[0][1]) in got and all((100 + i, "") in got for i in range(1, 50))
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got.values())
    assert got[0, ""].n_lines == 1 and got[0, ""].n_removed == 0
    assert got[49, dict(texts())[49]].n_removed == 0


def test_line_dedup_of_frequent_blocks_and_runs_against_brute_force(spark):
    rng = random.Random(8)
    # Blocks in one order, each of many rows: a long line, short lines that only together are long enough.
    blocks = [["a long line of more than ten characters"], ["s1 ab", "", "s2 cd", "s3 ef"], ["u1", "u2", "u3", "u4", "u5", "u6"], ["rare1 rare1 rare1"]]
    rows = [(i, line) for i, line in enumerate(["s1 ab", "s2 cd", "s3 ef", "u1", "u2", "u3", "u4", "u5", "u6"])]
    for i in range(10, 90):
        lines = [f"own {i} start"]
        for k, block in enumerate(blocks):
            if rng.random() < 0.6 and (k < 3 or i % 30 == 0):
                lines += [*block, f"own {i} after {k}"]
        rows.append((i, "\n".join(lines)))
    rows += [(90, "\n".join(["own 90", *blocks[0], "x", *blocks[3]])), (91, "\n".join(["own 91", *blocks[0], "y", *blocks[3]]))]
    seen, want = set(), {}
    for i, text in rows:
        lines, gone, new = text.split("\n"), set(), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(map(len, lines[a:b])) >= 10:
                    new.add(tuple(lines[a:b]))
                    if tuple(lines[a:b]) in seen:
                        gone.update(range(a, b))
        seen |= new
        want[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    got = {r.doc_id: r.kept_text for r in remove_common_lines(frame(spark, rows), least=10).collect()}
    assert got == want


def test_block_keys_reach_the_ends_of_blocks():
    # Rows (29, 5), (29, 5, 3), (7, 29, 5, 3) characters: the last two share a line that the first has not.
    hashes, sizes = np.array([1, 2, 1, 2, 3, 4, 1, 2, 3]), np.array([29, 5, 29, 5, 3, 7, 29, 5, 3])
    rows, keys, first, end, text = block_keys(hashes, sizes, np.array([0, 2, 5, 9]), 30)
    own = [set(keys[rows == i].tolist()) for i in range(3)]
    assert (own[1] & own[2]) - own[0]
    assert {(int(x), int(y)) for x, y in zip(first[rows == 2], end[rows == 2])} == {(0, 2), (1, 3), (1, 4)}


def deleted(rows, least):
    """Kept texts: a line goes if a run of lines with ``least`` characters that holds it is one of an earlier row;
    blank lines inside such a run or between lines that go, go too."""
    seen, want = set(), []
    for text in rows:
        lines = text.split("\n")
        new, gone = set(), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if lines[a].strip() and lines[b - 1].strip() and sum(len(x.strip()) for x in lines[a:b]) >= least:
                    run = tuple(x.strip() for x in lines[a:b])
                    new.add(run)
                    if run in seen:
                        gone.update(range(a, b))
        seen |= new
        for j, x in enumerate(lines):
            before = [i for i in range(j) if lines[i].strip()]
            after = [i for i in range(j + 1, len(lines)) if lines[i].strip()]
            if not x.strip() and before and after and before[-1] in gone and after[0] in gone:
                gone.add(j)
        want.append("\n".join(x for j, x in enumerate(lines) if j not in gone))
    return want


def test_line_dedup_of_repeated_and_moved_blocks_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["aa", "bb", "cc", "dd", "", " ", "a line of ten", "another long line", "e e"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(120)]
    two, three = "second line of a block of lines", "third line of a block of lines"
    rows += [(200, f"first\n{two}\n{three}"), (201, f"own\n{two}\n{three}\nown 5\n{two}\n{three}\nown 6"), (202, f"{three}\nown 7\n{two}")]
    got = {r.doc_id: r for r in remove_common_lines(frame(spark, rows), least=10).collect()}
    assert [got[i].kept_text for i, _ in rows] == deleted([x for _, x in rows], 10)
    assert got[201].kept_text == "own\nown 5\nown 6" and got[201].n_removed == 4 and got[201].n_partners == 1
    assert got[202].kept_text == "own 7" and got[202].n_moved == 1


def test_line_dedup_of_a_long_document(spark):
    # 20,000 lines, each of another first document: the pairs carry what they share, not both documents.
    lines = [f"line number {i} of the long document" for i in range(20_000)]
    rows = [(i, x) for i, x in enumerate(lines)] + [(20_000, "\n".join([*lines, "end"])), (20_001, "\n".join(reversed(lines)))]
    got = {r.doc_id: r for r in remove_common_lines(frame(spark, rows)).filter("doc_id >= 20000").collect()}
    assert got[20_000].kept_text == "end" and got[20_000].n_partners == 20_000 and got[20_001].n_removed == 20_000


def test_sliding_argmin():
    rng = np.random.default_rng(1)
    for n in (1, 5, 41, 300):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for w in (1, 2, 7, 41):
            assert sliding_argmin(x, w).tolist() == [i + int(np.argmin(x[i : i + w])) for i in range(n - w + 1)]


@pytest.mark.parametrize("window,k", [(50, 10), (5, 2), (6, 6)])
def test_substring_dedup_against_brute_force(spark, window, k):
    rows, first = [(i, (x or "").encode().split()) for i, x in texts()], {}
    for i, w in rows:
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            first[key] = min(first.get(key, LAST + 1), place(i))
    want = []
    for i, w in rows:
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < place(i):
                gone.update(range(a, a + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((place(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = remove_repeats(frame(spark), window, k).collect()
    assert sorted((place(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert all(r.kept_text is None or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components_against_brute_force(spark, width, percent):
    rows = [(i, shingles(x, width)) for i, x in texts()]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[top(k)] = min(low.get(top(k), LAST), place(i))
    want = sorted((place(i), len(s), low[top(k)]) for k, (i, s) in enumerate(rows))
    got = jaccard_components(frame(spark), width, percent).collect()
    assert sorted((place(r.doc_id), r.n_shingles, place(r.component_id)) for r in got) == want


def test_subset_sizes_cover_every_linked_pair():
    for percent in (85, 80, 50):
        for n in range(1, 40):
            for m in range(n, 80):
                need = least_overlap(n + m, percent)
                if need <= n:
                    assert need in subset_sizes(n, percent) and need in subset_sizes(m, percent)
    assert 0 <= choose_boundary({5: 100, 9: 100, 20: 50}) <= 24


def random_set(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))


@pytest.mark.parametrize("seeds", [4, 1])
@pytest.mark.parametrize("percent", [85, 80, 50])
def test_linked_sets_share_a_slice_key(percent, seeds, monkeypatch):
    from coinweave.llm import ngram_join

    monkeypatch.setattr(ngram_join, "SEEDS", seeds)
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), 90, 333, 1500]:
        for gone in range(n):
            x = random_set(rng, n)
            more = max((k for k in range(2 * n) if 100 * (n - gone) >= percent * (n + k)), default=-1)
            if more < 0:
                break
            for k in {0, more // 2, more}:
                y = np.unique(np.concatenate([rng.permutation(x)[gone:], random_set(rng, k)]))
                assert len(np.intersect1d(ngram_join.slice_keys(x, percent), ngram_join.slice_keys(y, percent)))


def test_sets_that_share_passages_share_few_lists():
    from coinweave.llm.ngram_join import slice_keys

    rng = np.random.default_rng(5)
    passages = [random_set(rng, 80) for _ in range(40)]
    sets = [np.unique(np.concatenate([passages[i] for i in rng.choice(40, 12, replace=False)])) for _ in range(60)]
    keys = [slice_keys(s) for s in sets]
    pairs = [(a, b) for a in range(60) for b in range(a)]
    common = sum(len(np.intersect1d(sets[a], sets[b])) for a, b in pairs)
    assert 2 * sum(len(np.intersect1d(keys[a], keys[b])) for a, b in pairs) < len(pairs) < common / 100


@pytest.mark.parametrize("rounds", [6, 1])
def test_jaccard_components_of_long_texts(spark, rounds, monkeypatch):
    """Chains of near copies at the bound, texts made of shared passages, lists that the rounds leave open."""
    from coinweave.llm import ngram_join

    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rng = np.random.default_rng(8)
    passages = [" ".join(f"p{i}w{k}" for k in range(60)) for i in range(12)]
    rows = []
    for start in range(4):
        words = [f"c{start}w{k}" for k in range(150 + 90 * start)]
        for _ in range(14):
            rows.append(" ".join(words))
            for at in rng.choice(len(words), max(1, len(words) // 55), replace=False):
                words[at] = f"n{rng.integers(0, 1 << 40)}"
    rows += [" ".join(passages[i] for i in rng.choice(12, 7, replace=False)) for _ in range(25)]
    sets = [shingles(x, 4) for x in rows]
    low = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if low[a] != low[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(low))


@pytest.mark.parametrize("run", [lambda d: exact_dedup(d, F.col("doc_id") > 3), remove_common_lines, remove_repeats, jaccard_components])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_parity_maps_never_exceed_the_distance():
    from coinweave.llm.ngram_join import apart, parity_map

    rng = np.random.default_rng(2)
    for n, m, size, other in ((50, 60, 512, 512), (900, 800, 1024, 512), (5, 5000, 512, 8192)):
        x, y = (np.unique(rng.integers(0, 6000, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (n, m))
        assert apart(parity_map(x, size), parity_map(y, other)) <= len(np.setxor1d(x, y))
        assert apart(parity_map(x, size), parity_map(x, size)) == 0


def test_equal_sets_have_their_keys_once_a_task():
    import pyarrow as pa

    from coinweave.llm.ngram_join import _signatures

    long, short = " ".join(f"w{i}" for i in range(60)), "a b c d e f"
    texts = [long, long.upper(), short, long, short, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(range(7)), pa.array(texts)], names=["d", "t", "text"])
    out = pa.Table.from_batches(_signatures(4, 85, 5)(iter([batch]))).to_pylist()
    assert [len(r["slices"]) > 0 for r in out] == [True] + [False] * 6
    assert [len(r["subsets"]) > 0 for r in out] == [False, False, True] + [False] * 4
    assert len({r["c"] for r in out if r["n"]}) == 2


def test_key_lists_do_not_stay_on_disk(spark):
    from pathlib import Path

    from coinweave.session import scratch_dir

    folder = Path(f"{scratch_dir(spark)}/coinweave-{spark.sparkContext.applicationId}")
    before = set(folder.iterdir()) if folder.exists() else set()
    jaccard_components(frame(spark)).collect()
    left = [spark.read.parquet(str(p)) for p in set(folder.iterdir()) - before]
    assert left and not any("slices" in df.columns for df in left)
    assert sum("token" in df.columns for df in left) <= 2
