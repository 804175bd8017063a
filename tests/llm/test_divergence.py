import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from coinloom.llm import divergence
from coinloom.llm.queries import ORACLES, op11_divergence

from ..oracle import connect, same


def by_hand(docs, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in docs]
    inside, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        inside[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, k in inside[lang].items() if k >= least]
        groups = sorted({d[1] for d in docs if d[0] == lang})
        everything = sum((n[lang, s] for s in groups), Counter())

        def rates(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: rates(n[lang, s]) for s in groups}
        q = rates(everything)
        for s in groups:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, value, rank) for part, rows in (("pair", pairs), ("term", terms)) for rank, (value, item) in enumerate(rows, 1)]
    return sorted(out)


def random_docs(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "Été", "Ä", "日本", "a1b", "x-y", "z z", "don't", "q", "w", "e", "r", "t", "y"]
    sources = ["web", "books", None, "", "code", "über", "zz"]
    return [(rng.choice(["en", "de", None, ""]), rng.choice(sources), rng.choice([None, "", "12 3", " ".join(rng.choices(words, k=rng.randint(1, 30)))])) for _ in range(n)]


@pytest.mark.parametrize("least", [1, 3, 10, 10_000])
def test_equals_sums_over_all_terms(spark, least, monkeypatch):
    docs = random_docs(least, 200) + [("xx", "lonely", "one two")]
    df = spark.createDataFrame(docs, "lang string, source string, text string").withColumn("p", F.lit(1)).repartition(5)
    found = sorted(tuple(r) for r in divergence.audit(df, least).collect())
    assert found == by_hand(docs, least, 10)


def test_many_sources_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED_BYTES", 2000)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 50)
    rng = random.Random(3)
    docs = [("en", f"s{rng.randint(0, 90)}", " ".join(rng.choices(["aa", "bb", "cc", "dd", "éé" * 200], k=6))) for _ in range(400)]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    assert sorted(tuple(r) for r in divergence.audit(df, 2, 3).collect()) == by_hand(docs, 2, 3)


def test_large_counts_are_exact(spark):
    # rates of counts whose product with the scale leaves 64 bits
    df = spark.createDataFrame([(10**13, 3 * 10**13, 10**6)], "n long, total long, v long")
    got = df.select(divergence._rate(F.col("n"), F.col("total"), F.col("v")).alias("p")).first().p
    assert got == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 2 * 10**6)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    ours, theirs = same(op11_divergence(spark, sf_dir), connect(sf_dir), ORACLES["op11_divergence"])
    assert ours == theirs
