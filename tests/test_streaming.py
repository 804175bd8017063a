"""Stateful duplicate suppression against the greedy pass, over micro-batches and a restart."""

import random

import pytest

from coinloom.streaming import dedupe

from .test_ledger import MIN, T0, greedy, txns


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(dedupe.PROVIDER, None)
    spark.conf.set(dedupe.PROVIDER, dedupe.ROCKSDB)
    yield
    spark.conf.set(dedupe.PROVIDER, before) if before else spark.conf.unset(dedupe.PROVIDER)


def run(spark, tmp_path, rows, parts, keep_ms=dedupe.KEEP_MS):
    """(rows with kept, state rows) after the parts went in as one file, and so one micro-batch, each."""
    frame = txns(spark, rows, seq=True)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    state = 0
    for n, (first, last) in enumerate(parts):
        frame.where(f"seq >= {first} AND seq < {last}").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n:03d}")
        query = dedupe.dedupe_stream(stream, keep_ms=keep_ms).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.read.parquet(f"file://{tmp_path}/out").collect(), state


def test_stream_equals_batch(spark, tmp_path, rocksdb):
    rng = random.Random(3)
    rows = [(f"n{i}", rng.choice(["in", "out"]), rng.choice([1, 2]), rng.choice(["a", "A", None]), T0 + rng.randint(-120, 120) * MIN) for i in range(120)]
    got, _ = run(spark, tmp_path, rows, [(0, 40), (40, 41), (41, 120)])
    assert len(got) == 120
    assert {r.id for r in got if r.kept} == set(greedy([(*r[:3], r[3] or "", r[4]) for r in rows]))


def test_state_ends(spark, tmp_path, rocksdb):
    rows = [(f"n{i}", "in", 1, "p", T0 + i * 20 * MIN) for i in range(60)]
    got, state = run(spark, tmp_path, rows, [(0, 30), (30, 60)], keep_ms=60 * MIN)
    assert all(r.kept for r in got) and len(got) == 60 and state < 12


def test_needs_its_state_store(spark, tmp_path):
    with pytest.raises(ValueError, match="RocksDB"):
        dedupe.dedupe_stream(txns(spark, [("a", "in", 1, "p", T0)], seq=True))
