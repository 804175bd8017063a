"""Totals that follow a ledger's commits against totals of all its rows."""

import random

from pyspark.sql import functions as F

from coinloom.operators import listing
from coinloom.sources.store import Ledger
from coinloom.streaming.refresh import ingest_stream
from coinloom.streaming.views import LedgerTotals

from .test_ledger import AS_OF, DAY, MIN, T0, txns

ZONE = "Africa/Addis_Ababa"


def agree(ledger, totals):
    rows = ledger.transactions().persist()
    asked = [
        (totals.party_rollup(), listing.party_rollup(rows)),
        (totals.history_totals("out"), listing.history_totals(listing.history(rows, type_="out"))),
        (totals.export_totals(), listing.export_totals(rows)),
        (totals.tiles(T0 + DAY), listing.tiles(rows, T0 + DAY, ZONE)),
    ]
    for ours, plain in asked:
        assert sorted(map(str, ours.collect())) == sorted(map(str, plain.select(*ours.columns).collect()))
    assert [r.party for r in totals.party_ranking().collect()] == [r.party for r in listing.party_ranking(rows).collect()]
    rows.unpersist()


def some(spark, seed, n, first=0):
    rng = random.Random(seed)
    rows = [(f"n{first + i}", rng.choice(["in", "out", "credit", "airtime", None]), rng.choice([1, 20, None]), rng.choice(["a", " a ", "b", "", None]), T0 + rng.randint(0, 6 * 24 * 60) * MIN, rng.choice([True, False, None])) for i in range(n)]
    frame = txns(spark, rows)
    return frame.withColumn("date", F.when(F.col("id").endswith("7"), "no date").otherwise(F.col("date")))


def test_totals_follow_every_kind_of_commit(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    totals = LedgerTotals(ledger, f"file://{tmp_path}/totals", ZONE)
    assert totals.refresh() == 0
    agree(ledger, totals)
    late = some(spark, 3, 25, first=20).withColumn("seq", F.lit(0))
    steps = [
        lambda: ledger.add(some(spark, 1, 40), now=AS_OF),
        lambda: ledger.add(some(spark, 2, 30, first=40), now=AS_OF),
        lambda: ledger.restore(late),
        lambda: ledger.delete(ledger.transactions().where("id LIKE '%1' OR id LIKE '%7'").select("id")),
        lambda: totals.compact(),
        lambda: ledger.compact(),
        lambda: ledger.add(some(spark, 4, 10, first=70), now=AS_OF),
        lambda: ledger.clear(),
    ]
    for step in steps:
        step()
        assert totals.refresh() == totals.version() == ledger.version()
        agree(ledger, totals)
    assert totals.cells().isEmpty()


def test_several_commits_at_once(spark, tmp_path):
    """A row that came and went, and one that came, changed and went back, between two refreshes."""
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    totals = LedgerTotals(ledger, f"file://{tmp_path}/totals", ZONE)
    first = some(spark, 5, 30)
    ledger.add(first, now=AS_OF)
    totals.refresh()
    ledger.add(some(spark, 6, 10, first=30), now=AS_OF)
    ledger.delete(first.sparkSession.createDataFrame([("n3",), ("n33",), ("none",)], "id string"))
    ledger.restore(first.where("id IN ('n3', 'n4')").withColumn("amountSantim", F.lit(9).cast("long")).withColumn("seq", F.lit(0)))
    ledger.restore(first.where("id = 'n4'").withColumn("seq", F.lit(0)))
    before = totals.version()
    totals.refresh()
    assert totals.version() == before + 4
    agree(ledger, totals)
    commits = totals._log.snapshot().version
    totals.refresh()
    assert totals._log.snapshot().version == commits


def test_an_insertion_reads_its_own_files(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    totals = LedgerTotals(ledger, f"file://{tmp_path}/totals", ZONE)
    ledger.add(txns(spark, [(f"d{d}", "in", 1, "p", T0 + d * DAY) for d in range(20)]), now=AS_OF)
    totals.refresh()
    read, plain = [], totals._source.read
    monkeypatch.setattr(totals._source, "read", lambda snapshot, schema: read.append(snapshot.files) or plain(snapshot, schema))
    ledger.add(txns(spark, [("new", "out", 5, "p", T0)]), now=AS_OF)
    totals.refresh()
    assert [len(files) for files in read] == [1] and read[0][0].rows == 1
    agree(ledger, totals)


def test_a_stream_keeps_totals_current(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    totals = LedgerTotals(ledger, f"file://{tmp_path}/totals", ZONE)
    rows = txns(spark, [(f"n{i}", "out", 1 + i % 3, "p", T0 + i * 4 * MIN) for i in range(30)], seq=True)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    for n in range(3):
        rows.where(f"seq % 3 = {n}").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n:03d}")
    ingest_stream(stream, ledger, f"file://{tmp_path}/cp", totals=[totals]).awaitTermination()
    assert totals.version() == ledger.version() == 3
    agree(ledger, totals)
