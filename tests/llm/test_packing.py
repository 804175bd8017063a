import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from coinloom.llm import packing
from coinloom.llm.queries import op13_packing, tokenizer_json, with_ids_crc32


def sequences_of(spans, counts):
    """Lengths by sequence, of a plan; every piece is in one place and offsets have no gaps."""
    out = defaultdict(list)
    number = 0
    for length in sorted(counts):
        for i in range(number, number + counts[length]):
            span = [s for s in spans if s.first <= i][-1]
            assert span.length == length
            turn = i - span.first
            out[span.sequence + turn // span.each].append((span.offset + turn % span.each * length, length))
        number += counts[length]
    for places in out.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
    return out


def best_fit_decreasing(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= x]
        if fits:
            at = min(fits, key=lambda i: (free[i], i))
            free[at] -= x
        else:
            free.append(capacity - x)
    return Counter(capacity - f for f in free)


def fewest(lengths, capacity):
    """Fewest sequences, by search over sets that hold the longest piece left."""
    if not lengths:
        return 0
    longest, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for n in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), n):
            if longest + sum(rest[i] for i in chosen) <= capacity:
                best = min(best, 1 + fewest([x for i, x in enumerate(rest) if i not in chosen], capacity))
    return best


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_by_lengths_is_best_fit_by_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 97])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randint(0, 200))]
    counts = Counter(lengths)
    spans, n = packing.plan(counts, capacity, reduce=False)
    found = sequences_of(spans, counts)
    assert len(found) == n and sorted(found) == list(range(n))
    assert Counter(sum(x for _, x in p) for p in found.values()) == best_fit_decreasing(lengths, capacity)


@pytest.mark.parametrize("seed", range(150))
def test_reduction_never_costs_a_sequence(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 12, 20])
    lengths = sorted((rng.randint(rng.choice([1, 2, 4]), capacity) for _ in range(rng.randint(1, 8))), reverse=True)
    left = dict(Counter(lengths))
    fixed = packing.reduce_dominated(left, capacity)
    used = Counter()
    for times, members in fixed:
        assert sum(members) <= capacity and times > 0
        for x in members:
            used[x] += times
    rest = [x for x in sorted(left, reverse=True) for _ in range(left[x])]
    assert used + Counter(rest) == Counter(lengths)
    assert sum(times for times, _ in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)
    spans, n = packing.plan(Counter(lengths), capacity)
    assert len(sequences_of(spans, Counter(lengths))) == n >= fewest(lengths, capacity)


def test_plan_stays_small():
    counts = {n: 10**9 + n * 7919 for n in range(1, 4097)}
    spans, n = packing.plan(counts, 4096)
    assert len(spans) < 100_000 and sum(counts[x] * x for x in counts) / 4096 <= n


def test_plan_refuses_a_longer_piece(spark):
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 4)
    assert packing.plan({}, 4) == ([], 0)


def rows_by_hand(texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json())
    tok.no_truncation()
    tok.no_padding()
    out = []
    for key, text in texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            out.append((key, piece, at, ids[at : at + capacity]))
    return out


def test_words_are_the_librarys(monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_str(tokenizer_json())
    rng = random.Random(4)
    settled = [chr(c) for c in range(0x530) if packing._SETTLED.fullmatch(chr(c))] + [chr(c) for c in range(0x2010, 0x2035)]
    letters = [*"abzAZ09.,'<|>$_-\x7f\x00\x1c\x1f\x0b\xad\xaa\xb2\xbd\xd7\xf7éñÅßŸſЙёҐ–“ \n\t  ", "'s", "'LL", "ing", "tion", "123"]
    odd = ["İ", "Σ", "日", "ก​", "຺", "é", "\xa0", "　", "<|endoftext|>", "<|startoftext|>", "Й"]
    texts = ["".join(rng.choices(letters if i % 3 else letters + odd, k=rng.randint(0, 30))) for i in range(20_000)]
    texts += ["".join(rng.choices(settled, k=12)) for _ in range(20_000)] + [f"a{c}B{c} {c}9{c}" for c in settled] + ["x" * 200_000, "é" * 100_000, "~" * 70_000, ""]
    model = packing.LibraryModel(tokenizer_json())
    want = [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    for most in (500_000, 300):
        monkeypatch.setattr(packing, "CACHE_WORDS", most)
        for at in range(0, len(texts), 997):
            ids, sizes = model.encode(texts[at : at + 997])
            for text, got, ids_of in zip(texts[at:], np.split(ids, np.cumsum(sizes)[:-1]), want[at:]):
                assert got.tolist() == ids_of, ascii(text[:50])
    ids, sizes = model.encode([])
    assert len(ids) == len(sizes) == 0


def check_places(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_pieces_and_sequences(spark):
    texts = [(1, None), (2, ""), (3, "hello " * 30), (3, "hello " * 30), (None, "x" * 500), (4, "a <|endoftext|> B́ 日本　z"), (5, " \n ")] + [(i, "word " * (i % 13)) for i in range(10, 60)]
    df = spark.createDataFrame([(k, t, 0, "c") for k, t in texts], "doc_id long, text string, sequence_id int, `a.b` string").repartition(5)
    pieces = packing.encode_pieces(df, tokenizer_json(), 16, 1)
    found = sorted((r.doc_id or 0, r.piece, r.start, r.token_ids) for r in pieces.collect())
    assert found == sorted((k or 0, p, s, ids) for k, p, s, ids in rows_by_hand(texts, 16))
    packed = packing.pack(pieces, 16)
    rows = packed.collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.token_ids) for r in rows) == found
    n = check_places([r.asDict() for r in rows], 16)
    assert n <= len(best_fit_decreasing([len(f[3]) for f in found], 16)) or n <= sum(best_fit_decreasing([len(f[3]) for f in found], 16).values())
    whole = packing.sequences(packed).collect()
    assert len(whole) == n
    at = {(r.sequence_id, r.offset): r.token_ids for r in rows}
    for s in whole:
        ends = [*s.boundaries[1:], len(s.token_ids)]
        for a, b in zip(s.boundaries, ends):
            assert s.token_ids[a:b] == at[s.sequence_id, a]


def test_pack_takes_other_tables(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("b", None, "y"), ("c", 0, "z"), ("d", 4, None), ("d", 4, None), ("e", 1, "x")], "k string, n int, `o.p` string")
    found = packing.pack(rows.withColumn("offset", F.lit("theirs")), 4, "n").collect()
    assert Counter((r.k, r.sequence_id is None) for r in found) == Counter({("a", False): 1, ("b", True): 1, ("c", True): 1, ("d", False): 2, ("e", False): 1})
    assert len({r.sequence_id for r in found if r.n}) == 3
    assert packing.pack(rows.limit(0), 4, "n").count() == 0
    with pytest.raises(ValueError):
        packing.pack(rows, 3, "n")


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = op13_packing(spark, sf_dir).collect()
    by_hand = {(k, p): (s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, p, s, ids in rows_by_hand([(d.doc_id, d.text) for d in docs], 4096)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == by_hand and len(rows) == len(by_hand)
    n = check_places([r.asDict() for r in rows], 4096)
    lengths = [r.length for r in rows]
    assert -(-sum(lengths) // 4096) <= n <= sum(best_fit_decreasing(lengths, 4096).values())


def test_crc_of_nothing(spark):
    df = spark.createDataFrame([(1, [])], "k int, token_ids array<int>")
    assert with_ids_crc32(df).first().ids_crc32 == 0
