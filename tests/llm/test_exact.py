"""Operators with exact results, held against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from coinloom.llm import bpe, linededup, mixing, queries, sharding, similar, simhash, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a b", "same text here", "same text here", "x" * 5000, "word " * 4000, "İstanbul ΣΑΣ ǅ ﬁ é́   z", "it's we'll 12½ ²Ⅷ <|endoftext|>a<|startoftext|> b", "\x00\x1c\x7f\x85 tab\tend", "日本語のテキスト 😀😀", "é Å ẛ̣"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else f"src{i % 3}", "x") for i, t in enumerate(ODD)] + [(None, "no id", None, "x"), (3, "again", "src0", "y"), (3, "again", "src0", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_file("word_bpe_49k.json"))


def test_bpe_is_the_librarys(spark, docs, sf_dir):
    lib, model = library(), bpe.load_model(queries.tokenizer_json())
    rng = random.Random(1)
    letters = "abcdeéßñ thinger'ABΣ.,!$1"
    texts = [t or "" for t in ODD] + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500)] + ["".join(rng.choices("aab", k=40)) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = bpe.encode_texts(model, texts, {})
    want = lib.encode_batch(texts, add_special_tokens=False)
    for t, g, w in zip(texts, got, want):
        assert np.frombuffer(g, np.int32).tolist() == w.ids, t[:200]
    spec = queries.tokenizer_json()
    rows = bpe.decode(bpe.encode(docs, spec, keep=("doc_id", "size")), spec).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.decoded == lib.decode(r.token_ids, skip_special_tokens=False)


def test_bpe_trie_shares_splits_and_ends_anywhere():
    lib, model = library(), bpe.load_model(queries.tokenizer_json())
    words = ["a", "an", "ant", "ants", "anthem", "b", "zebra", "zebrafish", "q", "qqqqqqqq"]
    for some in (words, words[::-1], words[3:5], words[-1:]):
        got = model.encode_words(some)
        assert {w: np.frombuffer(x, np.int32).tolist() for w, x in got.items()} == {w: lib.encode(w, add_special_tokens=False).ids for w in some}
    assert model.encode_words([]) == {}


def test_bpe_splits_at_the_librarys_white_space():
    lib, model = library(), bpe.load_model(queries.tokenizer_json())
    texts = [f"a{chr(c)}b" for c in [*range(0x3100), *range(0xA000, 0xAC00), *range(0x10000, 0x20000, 3)]]
    got = bpe.encode_texts(model, texts, {})
    bad = [hex(ord(t[1])) for t, g, w in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False)) if np.frombuffer(g, np.int32).tolist() != w.ids]
    assert not bad


def test_bpe_composes_marks_as_the_library():
    import unicodedata

    lib, model = library(), bpe.load_model(queries.tokenizer_json())
    marks = [c for c in range(0x300, 0x110000) if unicodedata.category(chr(c))[0] == "M"]
    others = [c for c in range(0x300, 0x20000) if unicodedata.category(chr(c)) == "Cn"]
    texts = [s for c in map(chr, marks + others) for s in (f"e{c}\u0301", f"a{c}\u0323", f"\u00e9{c}", f"a\u0301{c}\u0323", f"{c}\u0301\u0323")]
    texts += ["\U00011935\U00011930", "\U00011938\u0301", "x\U00011935\u0323\U00011930"]
    newer = [c for c in map(chr, range(0x20000)) if bpe._NEWER.fullmatch(c)]
    rng = random.Random(2)
    texts += [f"e{a}{b}" for a, b in (rng.sample(newer, 2) for _ in range(6000))] + ["\u0eba\u1715", "\u1ac9\u1aca\u0301", "\u089c\u1df9e\u0323\u0301", "\u089e\u0301\u0d3b"]
    got = bpe.encode_texts(model, texts, {})
    assert not [t for t, g, w in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False)) if np.frombuffer(g, np.int32).tolist() != w.ids]


def test_bpe_leaves_the_collector_on(spark):
    import gc

    spec = queries.tokenizer_json()
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bpe.encode(frame, spec).count()
    assert all(r.on for r in frame.mapInPandas(lambda it: (f.assign(on=gc.isenabled())[["on"]] for f in it), "on boolean").collect())


def test_sharding_law_rows(spark, docs):
    for frame in (docs, docs.limit(0), spark.range(1000).selectExpr("id doc_id", "cast(id % 3 as string) text")):
        out = sharding.shard(frame, 7, bucket_bytes=100).toPandas()
        assert len(out) == frame.count()
        if len(out):
            per = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
            assert per["count"].max() - per["count"].min() <= 1 and (per["min"] == 0).all() and (per["max"] + 1 == per["count"]).all() and (per["nunique"] == per["count"]).all()
            again = sharding.shard(frame, 7, bucket_bytes=100).toPandas()
            key = ["doc_id", "text", "shard", "slot"]
            assert again[key].sort_values(key).reset_index(drop=True).equals(out[key].sort_values(key).reset_index(drop=True))
    order = out.sort_values(["shard", "slot"]).doc_id.to_numpy()
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.15


def test_sharding_places_are_uniform(spark):
    """Over 8 seeds rows of every eighth of the input meet every eighth of the places about equally often, and neighbours part."""
    frame = spark.range(640).selectExpr("id doc_id", "cast(id as string) text").coalesce(1)
    counts, apart = np.zeros((8, 8)), 0
    for seed in range(8):
        rows = sharding.shard(frame, 1, bucket_bytes=1500, seed=seed).toPandas().sort_values("doc_id")
        np.add.at(counts, (rows.doc_id // 80, rows.slot // 80), 1)
        apart += (np.abs(np.diff(rows.slot)) > 80).sum()
    assert ((counts - 80) ** 2 / 80).sum() < 95  # chi-square with 49 degrees of freedom
    assert abs(apart / (8 * 639) - 0.766) < 0.03


def test_sharding_in_two_passes(spark):
    """Pass 1 makes folders of coarse buckets, neighbouring buckets in one; pass 2 reads one folder and keeps its buckets' places."""
    frame = spark.range(3000).selectExpr("id doc_id", "cast(id as string) text").repartition(3)
    rows = sharding.scatter(frame, 40, 5, 4)
    assert rows.count() == 3000 and len({f.split("__coarse=")[1][0] for f in rows.inputFiles()}) == 4
    assert rows.where("__coarse <> __bucket div 10").isEmpty()
    table = sharding.bucket_table(rows.select("__coarse", "__bucket"))
    for c in range(4):
        one = rows.where(rows["__coarse"] == c)
        part = sharding.permuted(one, table.where(table["__coarse"] == c), 3, 9)
        places = sorted(r["__place"] for r in part.collect())
        first = table.where(table["__coarse"] == c).agg({"__offset": "min"}).first()[0]
        assert places == list(range(first, first + len(places)))
    assert sharding.coarse_buckets(1) == 1 and sharding.coarse_buckets(64) == 8 and sharding.coarse_buckets(65) == 9 and sharding.coarse_buckets(400_000) == 128


def test_sharding_spreads_alike_rows_and_writes(spark, tmp_path):
    rows = [(1, "same", "a", 1)] * 600 + [(i, f"t{i}", None, i) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, law string, slot long").repartition(4)
    buckets = [r["count"] for r in sharding.scatter(frame, 20, 1).groupBy("__bucket").count().collect()]
    assert len(buckets) == 20 and max(buckets) < 70
    dealt = sharding.shard(frame, 7, bucket_bytes=500)
    assert dealt.columns == ["doc_id", "text", "law", "shard", "slot", "grown_shard"]
    sharding.write_shards(dealt, f"file://{tmp_path}/s")
    for i in range(7):
        back = spark.read.parquet(f"file://{tmp_path}/s/shard={i}").collect()
        assert len(back) == 100 and sorted(r.slot for r in back) == list(range(100)) and {r.law for r in back} == {"rows"}
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 700


def test_op3_columns(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_sharding(spark, sf_dir).collect()
    assert len(rows) == len(text) and {r.shard for r in rows} == set(range(24))
    assert all(r["size"] == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps, radius=3):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    distinct = sorted(fps)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash_matches_all_pairs(spark, docs, sf_dir):
    for frame in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 4000"), docs.limit(0)):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in frame.select("doc_id", "text").collect()]
        roots = plain_components({f for _, f in rows})
        least = {}
        for d, f in rows:
            if d is not None:
                least[roots[f]] = min(least.get(roots[f], d), d)
        want = Counter((d, f, least.get(roots[f])) for d, f in rows)
        assert want == Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame).collect())


@pytest.mark.parametrize("cap", [8, 1024])
def test_simhash_links_full_buckets(spark, cap):
    rng = random.Random(cap)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(40)}
    frame = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    roots = plain_components(fps)
    parts = defaultdict(set)
    for f, r in roots.items():
        parts[r].add(f)
    got = defaultdict(set)
    for r in simhash.components(simhash.links(frame, bucket_cap=cap)).collect():
        got[r.root].add(r.node % 2**64)
    assert sorted(map(sorted, got.values())) == sorted(sorted(p) for p in parts.values() if len(p) > 1)


def test_covering_masks_cover():
    masks, rng = [m % 2**64 for m in simhash.covering_masks()], random.Random(2)
    assert len(masks) == 15 and all(any(not d & m for m in masks) for d in (sum(1 << x for x in rng.sample(range(64), 3)) for _ in range(20000)))


def test_line_dedup_matches_all_windows(spark, docs):
    rng = random.Random(4)
    runs = [rng.choices("abcdef", k=rng.choice([3, 7, 12])) for _ in range(8)]
    texts = {}
    for i in range(80):
        words = [w for _ in range(rng.randint(0, 5)) for w in (rng.choice(runs) if rng.random() < 0.6 else rng.choices("abcdefghij", k=rng.randint(1, 9)))]
        texts[i] = "".join(w + rng.choice(["  ", " ", " ", "\n", "\n\n"]) for w in words)
    texts |= {100: "z " * 40, 101: "q w e r t y u i\no p", 102: "1 2 q w e r t\ny u i o p 3"}
    seen, gone = set(), set()
    for d in sorted(texts):
        words = texts[d].split()
        for a in range(len(words) - 5):
            if (part := tuple(words[a : a + 6])) in seen:
                gone |= {(d, j) for j in range(a, a + 6)}
            seen.add(part)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    out = {r.doc_id: r for r in linededup.drop_repeated_runs(frame, min_words=6).collect()}
    assert len(out) == len(texts) and len(gone) > 200
    for d, text in texts.items():
        assert out[d].text.split() == [w for j, w in enumerate(text.split()) if (d, j) not in gone], d
        assert out[d]["__deleted_words"] == sum(x == d for x, _ in gone)
    assert out[102].text == "1 2\n3" and out[102]["__deleted_lines"] == 0
    kept = linededup.drop_repeated_runs(docs).collect()
    assert len(kept) == docs.count() and {r.text for r in kept if r.doc_id is None} == {"no id"} and any(r.text is None for r in kept)
    assert linededup.drop_repeated_runs(docs.limit(0)).count() == 0


def test_op7_cuts_a_passage_inside_lines(spark, tmp_path):
    passage = [f"w{i}" for i in range(54)]
    one = "x y " + " ".join(passage[:12]) + "\n" + " ".join(passage[12:36]) + "\n" + " ".join(passage[36:])
    two = "other " + " ".join(passage) + " end"
    spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in queries.op7_line_dedup(spark, f"file://{tmp_path}").collect()} == {1: one, 2: "other end"}


def test_line_dedup_of_rows_that_share_an_id(spark):
    run, other, lone = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, run), (5, run), (5, lone), (6, other), (6, other), (None, run), (None, None), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in linededup.drop_repeated_runs(frame).collect())
    assert got == Counter([(1, run), (5, ""), (5, lone), (6, other), (6, other), (None, run), (None, None), (7, None)])


def test_line_dedup_needs_the_extension(spark, monkeypatch):
    run = [f"w{i}" for i in range(55)]
    frame = spark.createDataFrame([(1, " ".join(["a", "b", *run, "c"])), (2, " ".join(["d", *run, "e", "f"]))], "doc_id long, text string")
    cut = lambda: {r.doc_id: r.text for r in linededup.drop_repeated_runs(frame).collect()}[2]
    assert cut() == "d e f"
    whole = linededup.extend
    monkeypatch.setattr(linededup, "extend", lambda docs, ranges, n: whole(docs, ranges, n).limit(0))
    assert len(cut().split()) > 3


def test_line_dedup_splits_common_fingerprints(spark):
    from coinloom.llm.common import join_by_count

    rows = spark.createDataFrame([(1 if i % 3 == 0 else i, i) for i in range(900)], "k long, v long")
    unique = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k % 2 = 1")
    for share in (2, 500):
        for how in ("inner", "left_semi"):
            assert {r.v for r in join_by_count(rows, unique, ["k"], how, share).collect()} == {i for i in range(900) if i % 3 == 0 or i % 2}


def similar_frame(spark, groups, copies, seed=6):
    rng = random.Random(seed)
    texts = {0: None, 1: "", 2: "a b", 3: "A  b"}
    for g in range(groups):
        base = rng.choices([f"w{i}" for i in range(500)], k=rng.randint(60, 300))
        for _ in range(copies):
            texts[len(texts)] = " ".join(w if rng.random() > g / (30 * groups) else rng.choice("xyz") for w in base)
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_similar_groups_hold_all_similar_pairs(spark, docs):
    texts, frame = similar_frame(spark, 30, 4)
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() for w in [(t or "").lower().split()]}
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in texts for b in texts if a < b and sets[a] & sets[b]}
    assert 60 < sum(j >= 0.8 for j in pairs.values()) < 180
    group = {r.doc_id: r.component_id for r in similar.similar_groups(frame).collect()}
    close = [group[a] == group[b] for (a, b), j in pairs.items() if j >= 0.8]
    assert sum(close) >= 0.95 * len(close) and all(group[a] == group[b] for (a, b), j in pairs.items() if j >= 0.9)
    assert group[0] == group[1] and group[2] == group[3]
    members = defaultdict(set)
    for d, c in group.items():
        members[c].add(d)
    for c, m in members.items():  # what is linked is near: every member to some other
        assert c == min(m) and all(len(m) == 1 or max(pairs.get((min(a, b), max(a, b)), 0) for b in m if b != a) >= 0.8 for a in m if a > 3)
    assert similar.similar_groups(docs.limit(0)).count() == 0 and similar.similar_groups(docs).count() == docs.count()


def test_full_buckets_link_the_same_groups(spark):
    _, frame = similar_frame(spark, 4, 60, 7)
    groups = lambda cap: {(r.doc_id, r.component_id) for r in similar.similar_groups(frame, cap).collect()}
    assert groups(5) == groups(similar.CAP)


def test_keep_first_of_repeated_rows(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a, "s"), (5, a, "s"), (2, b, "s"), (5, b, "t"), (None, b, "s"), (None, c, "s"), (None, c, "s"), (7, c.upper(), "u"), (9, None, "s"), (8, "", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id string")
    out = corpus_pipeline.near_dedup(spark, frame, "").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(5, a), (2, b), (7, c.upper()), (8, "")])
    assert corpus_pipeline.near_dedup(spark, frame.limit(0), "").count() == 0


def test_linked_sets_are_components():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, (5, 2), np.uint64)[rng.integers(0, 5, 120)]
    for _ in range(9):
        words[np.arange(120), rng.integers(0, 2, 120)] ^= np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)
    label = similar.linked_sets(words, 12)
    near = np.bitwise_count(words[:, None] ^ words[None]).sum(2) <= 12
    reach = near.copy()
    for _ in range(7):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert (label == reach.argmax(1)).all() and 1 < len(set(label)) < 60


def test_tables_meet_as_often_as_planned():
    rng = np.random.default_rng(4)
    masks = np.array(simhash.covering_masks(3, 34), np.int64).view(np.uint64)
    p = similar.differing_share()
    flips = (rng.random((20_000, 34)) < p) @ (np.uint64(1) << np.arange(34, dtype=np.uint64))
    assert abs((flips[:, None] & masks == 0).any(1).mean() - similar.meets(34, p)) < 0.06  # places are dealt evenly, not at random


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)


def test_mixing_contract(spark, docs, sf_dir):
    for frame in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), docs.limit(0)):
        out = mixing.mix(frame).toPandas()
        assert len(out) == frame.count()
        source = out.source.astype(object).where(out.source.notna(), None)
        sizes = defaultdict(int)
        for s, t, n in zip(source, out.text, out["size"]):
            assert n == len(WORD.findall(t or ""))
            sizes[s] += n
        if not sizes:
            continue
        want = plain_targets(dict(sizes))
        taken, largest = defaultdict(int), defaultdict(int)
        for s, n, t, c, all_ in zip(source, out["size"], out.target, out.copies, out.source_size):
            assert abs(t - want[s]) < 1e-6 * max(1, want[s]) and 0 <= c <= 2 and all_ == sizes[s]
            taken[s] += c * n
            largest[s] = max(largest[s], n)
        assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
        copies = mixing.take(mixing.mix(frame))
        assert copies.count() == out.copies.sum() and set(frame.columns) - {"size"} <= set(copies.columns)


def test_mixing_cuts_bins_again(spark):
    """However often the cutting bin is cut, the documents taken are those of one sort by key; any weights, null and not a number too."""
    rng = random.Random(3)
    weights = [0.01, 0.25, 1.0, None, float("nan"), 0.0, -2.0, 1e9]
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", None]), rng.choice(weights)) for i in range(1500)]
    rows += [(7000, "same words here", "a", 0.5)] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, grade double").repartition(3)
    weight = mixing.F.col("grade")
    taken = lambda n: Counter((r.doc_id, r.text, r.copies) for r in mixing.mix(frame, weight=weight, cut_rows=n).collect())
    whole, cut = taken(10**9), taken(2)
    assert whole == cut and len({c for *_, c in whole}) > 1
    draw = frame.select(mixing.F.col("source").alias("__from"), mixing.word_count().alias("size"), (mixing.F.rand(1) * 1e-4 + 8).alias("__step"))
    held, level = mixing.cuts(draw, 20)
    assert level == 2
    for r in held.collect():
        mine = draw.where(draw["__from"].eqNullSafe(mixing.F.lit(r.source)))
        under = mine.where(mixing.bin_at(level) < r["__cut"]).agg({"size": "sum"}).first()[0] or 0
        assert under == r["__paid"] <= r["__left"] and mine.where(mixing.bin_at(level) == r["__cut"]).count() <= 20


def test_mixing_bins_hold_few(spark):
    """A weight of any size leaves a bin no more than about a thousandth of the documents."""
    keys = spark.range(200_000).select((mixing.F.log2(-mixing.F.log(mixing.F.rand(5)) / mixing.F.when(mixing.F.col("id") % 2 == 0, 0.003).otherwise(1.0)) * mixing.STEPS).alias("__step"))
    assert keys.groupBy(mixing.bin_at(0)).count().agg({"count": "max"}).first()[0] < 1.4 * 200_000 * 0.001


def plain_top(rows, k=10):
    """All scores of the valid rows; a query's own are all rows with its id."""
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(w, v)), j) for i, w in ok if i == q for j, v in ok if j != q and len(v) == len(w) and v)
        out += [(q, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_mixing_reruns_agree_on_repeated_ids(spark):
    rng = random.Random(12)
    rows = [(rng.choice([None, 1, 2]), " ".join("abc"[i % 3] * rng.randint(1, 12) for _ in range(rng.randint(1, 40))), rng.choice(["x", "y", None])) for i in range(400)]
    rows += rows[:50]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [Counter((r.doc_id, r.text, r.source, r.copies) for r in mixing.mix(frame.repartition(n)).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]
    assert len({c for *_, c in runs[0]}) > 1


def test_topk_matches_all_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.1, (700, 16)).astype(np.float32)
    x[50:90] = x[100]
    x[300] *= 1000  # an outlier
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [float("nan")] * 16), (9003, [float("inf")] * 16), (9004, [None] * 16), (9005, [1.0]), (None, [1.0] * 16)]
    rows += [(5, x[5].tolist()), (7, x[9].tolist()), (100, x[3].tolist()), (8000, [1.0, 2.0]), (8001, [3.0, -1.0]), (8002, [3.0, -1.0]), (8100, []), (8200, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    for block in (3, 4096):
        got = topk.top_k(frame, frame.where("vec_id % 100 = 0"), query_block=block).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(rows)
    few = spark.createDataFrame([(100, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk.top_k(few, few.where("vec_id = 100")).orderBy("rank").collect()] == [(1, 2 << 20), (2, 2 << 20)]
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0 and topk.top_k(frame, frame.limit(0)).count() == 0


def test_topk_of_a_common_vector(spark):
    rows = [(i, [0.5, 0.25] if i % 3 else [float(i % 7), 1.0]) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.least_ids(topk.integer_vectors(frame), 10)
    assert vectors.where(vectors.v == vectors.v).count() <= 8 * 11
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, frame.where("vec_id % 100 = 0")).collect()) == plain_top(rows)


def test_topk_bounds_hold():
    rng = np.random.default_rng(9)
    v = rng.integers(-5000, 5000, (200, 7)) * rng.integers(0, 50, 7)
    q = rng.integers(-9000, 9000, (20, 7))
    low = v.min(0)
    width = (v.max(0) - low) // topk.CELLS + 1
    lower, upper = topk.bounds(((v - low) // width).astype(np.uint8), low, width, q)
    assert (lower <= q @ v.T).all() and (q @ v.T <= upper).all() and (upper - lower).max() < 0.2 * (np.abs(q) @ np.abs(v.T)).max()


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.0\r\n0\r\n</p>" * 300
    html = [None, "", "a", "\r", "x\r\n", "\r\n\r\n", big, big, big + "\r", big * 20, "q" * 999, "q" * 999, "q" * 1000, "q" * 1000, "😀" * 700]
    rows = [(i, f"http://a.example/{i}\r\nX: y", h, "n") for i, h in enumerate(html)] + [(None, None, big, "n"), (7, "u", big, "n")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    warc.write_archives(frame, f"file://{tmp_path}/w", chunk_chars=100)
    chunks = warc.read_chunks(spark, f"file://{tmp_path}/w").toPandas()
    last = chunks[chunks["last"]]
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        top = max(j for j, _, g, _ in rows if j is not None and g == h) if len(b) >= 1000 else None
        refers = top if top is not None and i != top else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    null = lambda v: None if pd.isna(v) else int(v)
    got = [(null(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, null(r.refers_to)) for r in last.itertuples()]
    assert Counter(got) == Counter(want)
    bodies = chunks[(chunks.record_type == "response") & chunks.page_id.notna()].sort_values("chunk").groupby("page_id").data.apply(b"".join)
    assert all(bodies[i] in ((h or "").encode(), (h or "").encode() * 2) for i, _, h, _ in rows if i in bodies.index)
    raw = b"".join(__import__("gzip").open(p).read() for p in sorted((tmp_path / "w").glob("*.gz")))
    at = 0
    while at < len(raw):  # the standard's own framing
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        at += len(head) + 4 + size
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4
    empty = frame.limit(0)
    warc.write_archives(empty, f"file://{tmp_path}/e")
    assert warc.records(warc.read_chunks(spark, f"file://{tmp_path}/e")).count() == 0
