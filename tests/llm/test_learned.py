"""Learned operators: exact parts by brute force, the rest by held-out accuracy; and the pipeline."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coinloom.llm import gam, langid, quality_rules, queries
from coinloom.llm.common import crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n ", "12 34 !!", "a", "É", "word " * 3000, "x" * 9000, "a b c d e f g h " * 9, "l1 x\nl1 x\n\n \nl1 x \nl1 x", "$ | < & é*é\n$ | < & é*é"]
BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "c") for i, t in enumerate(ODD)] + [(None, "null id", "c"), (4, "a", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def plain_measures(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_measures_match_plain_counts(spark, odd):
    blank = (np.zeros(quality_rules.GROUPS << quality_rules.BITS, np.float32), 0.0, 0.0, 50.0)
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    for frame in (odd, docs, docs.limit(0)):
        want = Counter((r.doc_id, *plain_measures(r.text)) for r in frame.collect())
        rows = quality_rules.apply_rules(quality_rules.measure(frame, blank)).collect()
        assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed) for r in rows)


def thue_morse(n, a="a", b="b"):
    word = [a if i.bit_count() % 2 == 0 else b for i in range(n)]
    return word, [b if x == a else a for x in word]


def test_hashes_tell_long_spans_apart(spark):
    one, two = map("".join, thue_morse(4096))
    texts = [f"{one}\n{two}", f"{one} {two} {one} {two} x y z w {two} {one} {two} {one} x y z w", f"{one}\n{one}", f"{one.upper()} {two}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blank = (np.zeros(quality_rules.GROUPS << quality_rules.BITS, np.float32), 0.0, 0.0, 50.0)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.measure(frame, blank).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def plain_grams(text):
    """The regression's features without hashing: byte n-grams by place, words and pairs, each with its share."""
    data = (text or "").encode()
    words = [bytes(w).lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    groups = [[data[i : i + n] for i in range(len(data) - n + 1)] for n in (3, 4)] + [words, list(zip(words, words[1:]))]
    return [{(g, x): c / len(grams) for x, c in Counter(grams).items()} for g, grams in enumerate(groups)]


def test_regression_features_and_fit_match_a_plain_version():
    texts = [t or "" for t in ODD] + ["good words in a row %d" % i for i in range(20)] + ["b@d $$ || %d" % i for i in range(20)]
    from coinloom.llm.textbatch import blocks

    (_, _, block), = blocks(pa.array(texts))
    index, share, offsets = quality_rules.text_features(block)
    for k, t in enumerate(texts):
        want = {x: s for group in plain_grams(t) for x, s in group.items()}
        got = dict(zip(index[offsets[k] : offsets[k + 1]].tolist(), share[offsets[k] : offsets[k + 1]]))
        if len(got) == len(want):  # no two features of this text share a place
            assert np.allclose(sorted(got.values()), sorted(want.values()))
        assert abs(sum(got.values()) - sum(want.values())) < 1e-3
    labels = np.array([1] * len(ODD) + [1] * 20 + [0] * 20)
    w, bias, slope, intercept = quality_rules.fit(index, share, offsets, labels)
    # a plain gradient descent's own steps, row by row
    learn = [i for i in range(len(labels)) if i % 5 != 4]
    weight = {1: 0.5 / sum(labels[i] for i in learn), 0: 0.5 / sum(1 - labels[i] for i in learn)}
    v, b = np.zeros(len(w)), 0.0
    m, q = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    rows = [(index[offsets[i] : offsets[i + 1]], share[offsets[i] : offsets[i + 1]].astype(float)) for i in range(len(labels))]
    for step in range(1, 41):
        g = np.append(1e-4 * v / len(v), 0.0)
        for i in learn:
            f, s = rows[i]
            wrong = weight[labels[i]] * (1 / (1 + math.exp(-(b + v[f] @ s))) - labels[i])
            g[f] += wrong * s
            g[-1] += wrong
        m, q = 0.9 * m + 0.1 * g, 0.99 * q + 0.01 * g * g
        d = 0.6 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)
        v, b = v - d[:-1], b - d[-1]
    margins = np.array([b + v[f] @ s for f, s in rows])
    mine = quality_rules.margins(block, block.words(), w, bias)
    assert np.allclose(mine, margins, atol=1e-2) and slope > 0
    told = slope * mine + intercept > 0
    assert (told == labels.astype(bool)).mean() > 0.9


def plain_gam(model, row):
    """A score by walking the tables one by one."""
    total = model["base"]
    for i, cuts in enumerate(model["cuts"]):
        total += model["tables"][i][sum(row[i] > c for c in cuts)]
    for i, j, table in model["pairs"]:
        total += table[sum(row[i] > c for c in model["pair_cuts"][i])][sum(row[j] > c for c in model["pair_cuts"][j])]
    return 1 / (1 + math.exp(-total))


def plain_tree(g, h, leaves=3):
    """Best-first tree by trying every cut of every leaf."""
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = max(((gain(a, c) + gain(c, b) - gain(a, b), -k, -c) for k, (a, b) in enumerate(spans) for c in range(a + 1, b)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            break
        a, b = spans.pop(-best[1])
        spans += [(a, -best[2]), (-best[2], b)]
    return [next(sum(g[a:b]) / (sum(h[a:b]) + 1) for a, b in spans if a <= i < b) for i in range(len(g))]


def test_gam_matches_plain_tables_and_trees(spark, odd):
    rng = np.random.default_rng(2)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9)
        assert np.allclose(gam.tree(g, h), plain_tree(g, h))
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = gam.train(docs, spark.read.parquet(f"{BIG}/labels.parquet"))
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    few = spark.read.parquet(f"{BIG}/labels.parquet").where("doc_id < 400")
    assert len(gam.train(named(docs), named(few))["pairs"]) == gam.PAIRS  # ids of any type
    assert len(model["pairs"]) == gam.PAIRS and all(np.abs(t).max() > 0 for _, _, t in model["pairs"])
    from coinloom.llm.textbatch import blocks

    texts = [r.text for r in odd.collect()] + [r.text for r in docs.limit(100).collect()]
    x = np.concatenate([gam.features(b) for _, _, b in blocks(pa.array(texts, pa.string()))])
    assert np.allclose(gam.predict(model, x), [plain_gam(model, row) for row in x])
    rows = gam.score(odd, model).collect()  # a trained model on odd texts
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and gam.score(odd.limit(0), model).count() == 0
    # boosting lowers the loss of the model without tables
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    pairs = [(r.score, labels[r.doc_id]) for r in gam.score(docs, model).collect() if labels.get(r.doc_id) is not None]
    loss = lambda p: -np.mean([math.log(s if y else 1 - s) for s, y in p])
    assert loss(pairs) < 0.2 * loss([(np.mean([y for _, y in pairs]), y) for _, y in pairs])


def test_quality_rules_on_labels(spark):
    rows = {r.doc_id: r for r in queries.op5_quality_rules(spark, BIG).collect()}
    labels = spark.read.parquet(f"{BIG}/labels.parquet").where(crc_mod("doc_id", 3) == 1).collect()
    right = [rows[r.doc_id].kept == bool(r.quality) for r in labels if rows[r.doc_id].n_words >= 20]
    assert np.mean(right) > 0.95


def test_gam_on_held_out_labels(spark, odd):
    rows = {r.doc_id: r for r in queries.op10_gam(spark, BIG).collect()}
    labels = spark.read.parquet(f"{BIG}/labels.parquet").where(crc_mod("doc_id", 3) == 1).collect()
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in labels]) > 0.95
    assert all(rows[r.doc_id].held_out and 0 <= rows[r.doc_id].score <= 1 for r in labels)
    none = gam.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in gam.score(odd, none).collect()] == [0.5] * odd.count()


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    pieces = {"▁a": 0.2, "▁ab": 0.1, "a": 0.3, "b": 0.1, "ab": 0.2, "ba": 0.05, "▁": 0.05}
    model = langid.LanguageModel(["x", "y"], {p: [v, v / 2] for p, v in pieces.items()})
    words = ["▁" + "".join(rng.choice(list("ab"), n)) for n in range(1, 8) for _ in range(5)]
    got = model.word_log_probs(words)
    for word, row in zip(words, got):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[at:i])
                    at = i
            parts.append(word[at:])
            total += math.prod(pieces.get(p, langid.FLOOR if len(p) == 1 else 0) for p in parts)
        assert abs(row[0] - math.log(total)) < 1e-9


def test_forward_sums_long_runs_and_trains_on_them():
    from fractions import Fraction

    rng = np.random.default_rng(1)
    pieces = {"▁a": 1e-3, "a": 3e-3, "b": 1e-3, "ab": 2e-3, "ba": 5e-4, "▁": 5e-3, "abab": 1e-4}
    model = langid.LanguageModel(["x", "y"], {p: [v, v / 64] for p, v in pieces.items()})
    words = ["▁" + "".join(rng.choice(list("abc"), n)) for n in (30, 39, 40, 41, 100, 300)] + ["▁" + "c" * 38]

    def plain(word, share):
        sums = [Fraction(1)]
        for j in range(1, len(word) + 1):
            parts = {word[i:j]: i for i in range(max(0, j - 4), j)}
            sums.append(sum(sums[i] * Fraction(pieces[p] / share if p in pieces else langid.FLOOR) for p, i in parts.items() if p in pieces or len(p) == 1))
        return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)

    for word, row in zip(words, model.word_log_probs(words)):
        assert abs(row[0] - plain(word, 1)) < 1e-6 and abs(row[1] - plain(word, 64)) < 1e-6, word
    for word in ("▁" + "ab" * 5, "▁" + "abcab" * 60):  # the shares of the arcs of each position add up to one
        arcs = [(i, j, word[i:j]) for i in range(len(word)) for j in range(i + 1, min(len(word), i + 4) + 1) if j == i + 1 or word[i:j] in pieces]
        shares = list(langid._piece_shares(len(word), arcs, {a[2]: pieces.get(a[2], 1e-8) for a in arcs}))
        assert abs(sum(s * len(p) for p, s in shares) - len(word)) < 1e-6
    learned = langid.learn_pieces({"▁" + "cd" * 600: 1, "▁ab": 2}, ["ab", "cdcdcdcdcdcdcdcdcdcdcd"])
    assert learned["cdcdcdcdcdcdcdcdcdcdcd"] > 0.01


def test_more_languages_than_a_block(spark):
    langs = [f"l{i:03d}" for i in range(7)]
    rows = [(i * 10 + k, f"{x}{x} word{x} " * 9, x) for i, x in enumerate(langs) for k in range(3)]
    frame = spark.createDataFrame([(d, t.translate(str.maketrans("0123456789", "ghijklmnop")), x) for d, t, x in rows], "doc_id long, text string, lang string")
    told = [sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.classify(frame, langid.train(frame, ["wo", "rd"], block_langs=n)).collect()) for n in (2, 200)]
    assert told[0] == told[1] and all(p == langs[d // 10] for d, p, _ in told[0])
    assert langid.classify(frame.limit(0), langid.train(frame, ["wo"])).count() == 0


def test_store_forgets_long_chunks():
    model = langid.LanguageModel(["x"], {"a": [0.5]})
    texts = ["a" * 500 + " a aa", "aa", "a" * 500, "", "a" * 500 + " a aa"]
    want = [langid.LanguageModel(["x"], {"a": [0.5]}).text_log_probs([t])[0][0, 0] for t in texts]
    got = np.concatenate([model.text_log_probs(texts[:2])[0], model.text_log_probs(texts[2:])[0]])[:, 0]
    assert np.allclose(got, want) and set(model.words) == {"a", "aa"} and len(model.scores) == 2


def test_languages_held_out(spark, odd):
    rows = queries.op6_langid(spark, BIG).collect()
    lang = {r.doc_id: (r.lang, len(WORD.findall(r.text))) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id][0] for r in held]) > 0.97
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    out = langid.classify(odd, queries.learn_languages(docs)).collect()
    assert [r.lang_pred == "und" for r in out] == [not re.search(r"[^\W\d_]", r.text or "") for r in out]
    assert all(r.score == 0 for r in out if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.classify(odd, langid.train(docs.limit(0), ["a"])).collect()} == {"und"}


def test_features_take_any_text():
    from coinloom.llm.textbatch import blocks

    whole = np.concatenate([gam.features(b) for _, _, b in blocks(pa.array(ODD))])
    single = np.concatenate([gam.features(b) for _, _, b in blocks(pa.array(ODD), max_bytes=1)])
    assert np.isfinite(whole).all() and np.allclose(whole, single)


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as p

    names = [n for n, _ in p.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() > 0, name
        docs = out
    rows = p.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect()) and all(r.n_tokens == len(r.token_ids) for r in rows)
    some = odd.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars")
    for name, stage in p.STAGES[1:]:
        for frame in (some, some.limit(0)):
            stage(spark, frame, "/root/testdata/sf0.001").collect()


def test_language_stage_without_labels(spark, odd):
    import corpus_pipeline as p

    frame = odd.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars")
    out = p.language_id(spark, frame, "")
    want = [r.text for r in frame.collect() if any(c.isalpha() for c in r.text or "")]
    assert want and sorted(r.text for r in out.collect()) == sorted(want) and out.columns == frame.columns
    empty = p.language_id(spark, frame.limit(0), "")
    assert empty.isEmpty() and empty.columns == frame.columns
