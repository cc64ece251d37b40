"""Token counts, packing, language models, language identification, page text, decontamination, pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import frame, texts, words
from coinweave.llm import packing
from coinweave.llm.common import crc_mod, mix, power_threshold, split_words, word_hashes
from coinweave.llm.decontam import COSINE, Items, _prepare, common_subsequence, contaminated, latent_terms
from coinweave.llm.html_render import extract_text, render
from coinweave.llm.langid import fit, identify, letters
from coinweave.llm.lm_scoring import codes_of, fit_tree, score_texts, stream_of
from coinweave.llm.token_counts import attribute, encoding, section_tokens
from coinweave.llm.tokens import WordEncoder, vocabulary


def test_word_hashes_depend_on_the_word_alone():
    joined, starts, ends, counts = split_words([b"a bb a", None, b"", b"bb ccc\x0bA", b"\xc3\xa9 a"], lower=True)
    h = word_hashes(joined, starts, ends)
    seen = [joined[s:e] for s, e in zip(starts, ends)]
    assert counts.tolist() == [3, 0, 0, 3, 2] and seen[:2] == [b"a", b"bb"]
    assert len({(w, x) for w, x in zip(seen, h.tolist())}) == len(set(seen)) == len(set(h.tolist()))


def test_power_threshold(spark):
    counts = spark.createDataFrame([(1,)] * 50 + [(4,)] * 10 + [(100,)], "n long")
    assert power_threshold(counts, "n", 11, 2) == 2 and power_threshold(counts, "n", 5, 2) == 8 and power_threshold(counts, "n", 0) > 64


def test_word_encoder_equals_whole_text():
    encode = WordEncoder(vocabulary("word_bpe_49k.json"))
    odd = "a. b, İx. é., 10. 0 x0y <|endoftext|> a<|endoftext|>. Σας ΣΑΣ. ½ .́ 'S it's. l'a. b \x1c. don't., É. ₀ ٠ ０"
    for text in [odd, "", "The THE the. the, " * 3]:
        assert np.frombuffer(encode([text.encode()])[0], "<u4").tolist() == encode._ids(text)
    assert encode([None]) == [b""]


def test_packing_is_a_round_trip_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "HELD_TOKENS", 700)
    got = packing.pack(frame(spark), window=64, shortest=16, step_tokens=256).collect()
    encode = WordEncoder(vocabulary("word_bpe_49k.json"))
    want, have, sequences = Counter(), defaultdict(list), defaultdict(list)
    for i, x in texts():
        ids = encode([x.encode() if x else None])[0] + (2).to_bytes(4, "little")
        want[i, len(ids) // 4] += 1
        have[i, len(ids) // 4].append(ids)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length, r.window))
    assert pieces.keys() == want.keys()
    for key, n in want.items():
        assert sum(x[1] for x in pieces[key]) == n * key[1]
        for start, length, crc in pieces[key]:
            assert crc in {zlib.crc32(ids[4 * start : 4 * (start + length)]) for ids in have[key]}
    for parts in sequences.values():
        at = 0
        for offset, length, window in sorted(parts):
            assert offset == at
            at += length
        assert at == window <= 64 and window & (window - 1) == 0
    steps = Counter()
    for r in got:
        steps[r.step_group] += r.length
    assert max(steps.values()) <= 256
    assert packing.pack(frame(spark, [])).count() == 0


def test_token_attribution():
    section, crosses = attribute(np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 7]))
    assert section.tolist() == [0, 1, 1] and crosses.tolist() == [False, True, True]  # 1 of 3, then 2 of 4: the earlier


def test_section_tokens_add_up(spark):
    encode = encoding(vocabulary("byte_bpe_multi_50k.tiktoken"))[0].encode_ordinary
    rows = [(1, "éa\n\n b中\n"), (2, None), (3, ""), (4, "x " * 5000), (None, "one\ntwo"), (1, "éa\n\n b中\n")]
    got = section_tokens(frame(spark, rows)).collect()
    for i, x in rows:
        mine = [r for r in got if r.doc_id == i]
        times = sum(1 for r in rows if r[0] == i)
        assert sum(r.n_tokens for r in mine) == times * len(encode(x or "")) and max(r.end for r in mine) == len(x or "")
    assert sorted((r.section, r.start, r.end) for r in got if r.doc_id is None) == [(0, 0, 4), (1, 4, 7)]
    assert section_tokens(frame(spark, [])).count() == 0


def test_tree_distributions_sum_to_one(spark):
    tokens = [w.split() for w in (b"the cat sat", b"the dog sat", b"", b"the the the")] * 20
    codes, n = np.unique(codes_of(*stream_of(tokens, 4), 4), return_counts=True)
    tree = fit_tree(spark.createDataFrame([(int(c), int(k)) for c, k in zip(codes, n)], "code long, n long"), 4, 1e-6, 3.0)
    assert sum(len(c[0]) for c in tree.contexts) > 3
    for context in (b"\n\n\n\n", b"the ", b" sat", b"zzzz", b"\xff\x00 t"):
        base = int.from_bytes(context, "big") << 8
        assert abs(tree.probabilities(base + np.arange(256)).sum() - 1) < 1e-9


def test_scores_against_brute_force(spark):
    rows = texts()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    got = score_texts(frame(spark), crc_mod(F.col("doc_id"), 5) == 1, frequent=20).collect()
    tokens = [(i, [*(x or "").encode().lower().split(), b"\n"]) for i, x in rows]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and -1e6 < r.score < 0 for r in got)
    # Learned copies are likelier than other texts of the same length.
    per = {r.doc_id: r.score / r.n_tokens for r in got}
    assert per[50] > per[12]
    nothing = score_texts(frame(spark), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in nothing)
    assert score_texts(frame(spark, []), F.lit(False)).count() == 0


def test_language_identification(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "to", "mi", "shi", "no"], "bb": ["sch", "ung", "ein", "lich", "ge"], "cc": ["eau", "oi", "qu", "ent", "re"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(("aa", "bb", "cc")[i % 3], 40), ("aa", "bb", "cc")[i % 3]) for i in range(240)]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 34!", "bb"), (903, make("bb", 20_000), None), (904, "KATO", None), (905, "q" * 400, None), (None, make("cc", 30), "cc"), rows[0]]
    docs = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, rejected boolean, __k0 int")
    got = identify(docs, crc_mod(F.col("doc_id"), 4) != 2, "doc_id", limit=60).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == lang and not by[i].rejected for i, _, lang in rows[:240])
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (900, 901, 902))
    assert by[903].lang_pred == "bb" and by[904].lang_pred == "aa" and by[None].lang_pred == "cc"
    assert by[905].rejected and all(0 <= r.score <= 1 for r in got)
    none = identify(docs, F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert identify(docs.limit(0), F.lit(True)).count() == 0


def test_character_model_sums_to_one(spark):
    docs = spark.createDataFrame([(i, "ab ba abc " * 3, "xx") for i in range(20)], "doc_id long, text string, lang string")
    model = fit(docs, F.lit(True))
    letters = [chr(c) for c in range(97, 123)]
    # All words of up to two letters of the alphabet seen, and the rest of the mass elsewhere.
    scores, _ = model.word_scores([*letters, *[a + b for a in letters for b in letters]])
    assert 0.3 < (10.0 ** scores[:, 0]).sum() <= 1 + 1e-9


PAGE = """<head><title>no</title></head><p>a<p>b <b>c</b><ul><li>x<li>y<ol start=3><li>q<li>z</ol><li>w</ul>after
<table><caption>cap<tr><th>h1<th>head2<tr><td>v<td>1<br>2<tr><td colspan=2>wide wide wide</table>t<div hidden>no</div>
<div style='display: none'>no</div><pre>
 a
  b</pre>x &amp; y<script>if(a<b){'</p>'}</script> <a href='x>y'>link</a> < 3"""


def test_page_text():
    assert render(PAGE).split("\n") == [
        "a", "", "b c", "", "- x", "- y", "  3. q", "  4. z", "- w", "", "after", "", "cap", "h1 | head2", "v  | 1", "   | 2", "wide wide wide", "",
        "t", "", " a", "  b", "", "x & y link < 3",
    ]
    assert render(None) == render("") == render("<!-- x") == render("<script>x") == ""
    assert render("<div>" * 3000 + "deep") == "deep" and render("<p hidden>x</p>y") == "y"
    assert render('<table><tr><td rowspan=2>a<td>b<tr><td>c</table>') == "a | b\n  | c"


def test_pages_table(spark):
    rows = [(1, "<p>a<p>b", 5), (2, None, 5), (3, "", 5), (None, "x", 5), (1, "<p>a<p>b", 5), (4, "<p>" + "long " * 50_000, 5)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.n_lines, r.n_chars) for r in got) == [(-1, 1, 1), (1, 3, 4), (1, 3, 4), (2, 0, 0), (3, 0, 0), (4, 1, 249_999)]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([bytes([rng.randrange(97, 102)]) for _ in range(rng.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        assert common_subsequence(a, b) == row[-1]


def test_latent_terms_equal_the_exact_decomposition(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 5)) @ rng.normal(size=(5, 40))
    entries = spark.createDataFrame([(p, t, float(a[p, t])) for p in range(30) for t in range(40)], "p long, t long, a double")
    v = latent_terms(entries, 40, 30, rank=5)
    assert np.allclose(a @ v @ v.T, a, atol=1e-4) and np.allclose(v.T @ v, np.eye(5), atol=1e-4)


def leaks():
    rng = random.Random(9)
    bench = [(i, " ".join(words(rng, n, 3000)) + ". " + " ".join(words(rng, 4, 3000)) + ".") for i, n in enumerate([30, 12, 70, 20, 33, 8])]
    bench += [(6, "tiny item"), (7, None), (8, ""), (9, "?!"), (None, "no id at all here")]
    docs, want = [(i, " ".join(words(rng, 200, 3000))) for i in range(20)], set()
    for i, (item, text) in enumerate(b for b in bench[:6]):
        docs.append((100 + i, " ".join(words(rng, 90, 3000) + [text.upper()] + words(rng, 40, 3000))))
        edited = text.split()
        for k in range(3, len(edited) - 6, 9):
            edited[k] = "changed"
        docs.append((200 + i, " ".join(words(rng, 35, 3000) + edited + words(rng, 40, 3000))))
        docs.append((300 + i, " ".join(words(rng, 35, 3000) + edited[: len(edited) // 4] + words(rng, 40, 3000))))
        want |= {(100 + i, item), (200 + i, item)}
    docs += [(400, "see the Tiny, item!"), (401, None), (402, ""), (None, bench[0][1]), (100, docs[20][1])]
    return bench, docs, want | {(400, 6)}


def test_decontamination_finds_planted_items_only(spark):
    bench, docs, want = leaks()
    items = spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, doc_id int")
    got = contaminated(frame(spark, docs), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    assert all(COSINE <= r.cosine <= 1.001 and 0.5 < r.share <= 1 for r in got)
    assert contaminated(frame(spark, []), items).count() == 0 and contaminated(frame(spark, docs), items.limit(0)).count() == 0


def test_latent_search_recall_against_brute_force(spark):
    bench, docs, _ = leaks()
    texts_of = {i: x.encode() for i, x in bench if i is not None and x and i < 6}
    items = _prepare(frame(spark, docs), texts_of)
    # Brute force: cosines of the full TF-IDF vectors, without the projection.
    full = np.zeros((len(items.passages), len(items.vocabulary)))
    for p, (k, s) in enumerate(items.passages):
        for w in items.words[k][s : s + 32]:
            full[p, items.vocabulary[w]] += items.idf[items.vocabulary[w]]
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    exact = Items(texts_of)
    exact.weigh(items.idf, math.sqrt(items.squares[-1]), np.eye(len(items.vocabulary)), full)
    hits = total = 0
    for _, x in docs:
        ws = (x or "").lower().replace(".", " ").encode().split()
        brute = {c[:3] for c in exact.candidates(ws)} if ws else set()
        found = {c[:3] for c in items.candidates(ws)} if ws else set()
        hits, total = hits + len(brute & found), total + len(brute)
    assert total > 20 and hits >= 0.9 * total


def test_documents_are_named_by_id_and_text(spark, tmp_path):
    rng = random.Random(21)
    item = " ".join(words(rng, 40, 900))
    other = [" ".join(words(rng, 60, 900)) for _ in range(30)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, t) for i, t in enumerate(other)] + [(None, item + " " + other[0]), (3, other[1] + " " + item), (None, None), (None, other[2]), (50, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, __d string, text_hash int")
    found = contaminated(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.item_id) for r in found) == [(False, 3, 1), (True, None, 1)]
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept = corpus_pipeline.keep_uncontaminated(spark, docs.drop("__d"), str(tmp_path))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, rows[:30] + rows[32:]))


def test_number_signs_are_no_letters():
    assert letters("\u00b2 \u00bd \u2167 \u2460") == [] and letters("a\u00bdb \u00c9t\u00e9 x1") == ["a", "b", "\u00e9t\u00e9", "x"]


def test_verbatim_copies_of_a_large_benchmark_are_found(spark):
    rng = random.Random(4)
    # Few common words and many rare ones, as in texts.
    draw = lambda n: [f"v{int(3 * 20_000 ** rng.random())}" for _ in range(n)]
    bench = [(i, " ".join(draw(rng.randrange(32, 61)))) for i in range(1000)]
    docs = [(i, " ".join([*draw(rng.randrange(40, 80)), bench[i][1], *draw(rng.randrange(40, 80))])) for i in range(1000)]
    got = contaminated(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(i, i) for i in range(1000)} <= {(r.doc_id, r.item_id) for r in got}


@pytest.mark.parametrize("rows", [1_000, 10_000_000])
def test_verbatim_short_items_are_candidates_at_any_corpus_size(rows):
    rng = random.Random(6)
    texts_of = {i: " ".join(f"i{rng.randrange(60)}" for _ in range(n)).encode() for i, n in enumerate([1, 2, 5, 8, 9, 12, 15, 17, 20, 24, 31, 33, 50])}
    items = Items(texts_of)
    # The items' words are common, all words around them foreign: these have the top weight.
    idf = np.log((rows + 2) / (np.linspace(0.02, 0.6, len(items.vocabulary)) * rows + 1))
    full = np.zeros((len(items.passages), len(items.vocabulary)))
    for p, (k, s) in enumerate(items.passages):
        for w in items.words[k][s : s + 32]:
            full[p, items.vocabulary[w]] += idf[items.vocabulary[w]]
    items.weigh(idf, math.log(rows + 2), np.eye(len(idf)), full / np.linalg.norm(full, axis=1, keepdims=True))
    for k, own in items.words.items():
        for before in range(40):
            doc = [b"foreign%d" % x for x in range(before)] + own + [b"other%d" % x for x in range(50)]
            assert any(items.verdict(*c[:3], doc)[2] for c in items.candidates(doc) if c[0] == k)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    bench, docs, want = leaks()
    rng = random.Random(1)
    clean = [(i, " ".join(words(rng, 80, 5000))) for i in range(1000, 1040)]
    twin = clean[0][1].split()
    twin[5] = "other"
    rows = [*clean, *docs, (2000, clean[1][1]), (2001, " ".join(twin)), (2002, "123 456"), (2003, None)]
    table = spark.createDataFrame([(i, x, "en", "s", len(x or ""), 7) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    found = table
    for name, stage in corpus_pipeline.STAGES:
        found = corpus_pipeline.materialize(stage(spark, found, str(tmp_path)), name)
        if name != "packing":
            assert found.columns == table.columns
        seen[name] = {r.doc_id for r in found.select("doc_id").distinct().collect()}
    assert {i for i, _ in clean} <= seen["packing"]
    assert not seen["language_id"] & {2002, 2003, 402, 401} and 2000 in seen["language_id"] and 2000 not in seen["exact_dedup"]
    assert 2001 in seen["exact_dedup"] and 2001 not in seen["ngram_jaccard"]
    assert not seen["decontamination"] & {d for d, _ in want}
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(seen["packing"])


@pytest.mark.parametrize("value", [0, 1, (1 << 63) - 1])
def test_mix_is_a_permutation_of_samples(value):
    x = np.arange(1000, dtype=np.uint64) + np.uint64(value)
    assert len(np.unique(mix(x))) == 1000
