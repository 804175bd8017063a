import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import pytest

from coinloom.llm import alignment
from coinloom.llm.queries import op12_alignment, tokenizer_pair

ODD = ["", None, " ", "  ", "a ", " a", "a  b", "a\n b", "a \n b\n\n c ", "\ta", "  x", "x   y", "　 x", "▁", "a▁b c", "<0x41> <unk> <s>", "<|endoftext|> x<|endoftext|>", "café 日本語 \U0001f600\U0001f468‍\U0001f469", "ᨨx \n\n a", "a\0b c\0", "﻿ x﻿ y", "ﬁ Å", "é ́ x", "กำ ཀོ", "don't I'll 's", "1234 5 6,7", "x" * 300, "中" * 200, "\U00010480\U00010481 힣", "a\x1c b\x85 c᠎ d​ e", "   lead", "trail   ", "\r\n\r\n x"]


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    spec, model = tokenizer_pair()
    a = Tokenizer.from_str(spec)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=model)


def by_hand(texts):
    """Groups and links of every text from whole encodings and the tokens' bytes alone."""
    a, b = tokenizers()
    aligner = alignment.load_aligner(*tokenizer_pair())
    rows = []
    for text in texts:
        xs = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ys = b.encode(text, out_type=int) if text else []
        data = (" " + text).encode() if text else b""
        if b"".join(aligner.a_bytes[i] for i in xs) != data or b"".join(aligner.b_bytes[i] for i in ys) != data:
            xs, ys = [], []
        ends_a, ends_b = (list(accumulate(len(of[i]) for i in ids)) for of, ids in ((aligner.a_bytes, xs), (aligner.b_bytes, ys)))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, xs[i:k])) + "|" + ",".join(map(str, ys[j:m])))
            links.append((xs[k - 1], ys[m - 1]))
            i, j = k, m
        rows.append((len(xs), len(ys), ";".join(groups), links))
    counts = Counter(x for r in rows for x in r[3])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(na, nb, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups) for na, nb, groups, links in rows]


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = [*"ab \n\t.,'<|>é́中日\U0001f600ก  ​﻿\u0000 ", "  ", "the ", " of", "ing", "हि", "123", "<0x0A>", "\r\n", "▁"]
    return ["".join(rng.choice(parts[: rng.choice([9, 20, len(parts)])]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_chunks_give_what_whole_texts_give(spark):
    texts = ODD + random_texts(5, 3000)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, groups string").repartition(6)
    pair = tokenizer_pair()
    found = alignment.with_counts(alignment.align(df, *pair), *pair).orderBy("doc_id").collect()
    expected = by_hand(texts)
    for text, r, e in zip(texts, found, expected):
        assert (r.n_a, r.n_b, r.n_groups, r.n_best, r.count_sum, r.groups) == e, ascii(text)
    assert any(r.n_a == 0 for r in found) and any(r.n_groups < r.n_b for r in found)


def test_chunks_that_are_not_kept(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_CHUNKS", 20)
    monkeypatch.setattr(alignment, "STEP_CHARS", 50)
    aligner = alignment.Aligner(*tokenizer_pair())
    texts = random_texts(7, 200)
    once = [aligner.align([t])[2][0] for t in texts]
    assert aligner.align(texts)[2] == once
    assert aligner.align([])[2] == []


def test_even_texts_are_cut_alike():
    for text in [t for t in ODD if t] + random_texts(9, 3000):
        assert alignment._chunks(text) == alignment._CUT.split(" " + text), ascii(text)


def test_possible_pairs():
    found = alignment.possible_pairs([b"ab", b"b", b""], [b"b", b"cab", b"ab", b""])
    assert [divmod(k, 1 << 32) for k in found.tolist()] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    aligner = alignment.load_aligner(*tokenizer_pair())
    assert len(aligner.keys) < 2_000_000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    pair = tokenizer_pair()
    assert alignment.with_counts(alignment.align(df, *pair), *pair).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("text").collect()
    found = op12_alignment(spark, sf_dir).orderBy("doc_id").collect()
    digest = lambda n, groups: hashlib.sha256(groups.encode()).hexdigest() if n else ""
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found] == [(na, nb, n, n, best, total, digest(na, groups)) for na, nb, n, best, total, groups in by_hand([d.text for d in docs])]


@pytest.mark.parametrize("column", ["doc_id", "text"])
def test_nulls(spark, column):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").selectExpr(f"IF(doc_id = 1, NULL, {column}) AS {column}", "doc_id" if column == "text" else "text")
    assert alignment.align(df, *tokenizer_pair()).count() == 2
