"""Findings that follow a ledger's commits against the rules over all its rows."""

import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from coinloom.operators import findings as rules
from coinloom.sources.store import Ledger
from coinloom.streaming.findings import LedgerFindings
from coinloom.streaming.refresh import ingest_stream

from .test_ledger import AS_OF, DAY, MIN, T0, txns


def agree(ledger, found, moment):
    plain = rules.all_findings(ledger.transactions(), moment)
    want = plain.collect()
    assert sorted(map(str, found.findings(moment).select(*plain.columns).collect())) == sorted(map(str, want))
    return {r.kind for r in want}


def some(spark, seed, n, first=0):
    rng = random.Random(seed)
    rows = [(f"n{first + i}", rng.choice(["in", "out", "out", "credit", "airtime", None]), rng.choice([0, 0, 1, 20, 2000, 900_000, None]), rng.choice(["a", "A", "a", None]), T0 + rng.randint(0, 480) * 5 * MIN, rng.choice([True, False, None])) for i in range(n)]
    # airtime of eight days, of which the first stands out
    rows = [(*r[:4], T0 + rng.randint(0, 7) * DAY, r[5]) if r[1] == "airtime" else r for r in rows]
    frame = txns(spark, rows)
    spike = (F.col("type") == "airtime") & (F.substring("date", 1, 10) == F.lit(datetime.fromtimestamp(T0 / 1000, timezone.utc).date().isoformat()))
    frame = frame.withColumn("amountSantim", F.when(spike, F.lit(5_000_000).cast("long")).otherwise(F.col("amountSantim")))
    return frame.withColumn("date", F.when(F.col("id").endswith("7"), "no date").otherwise(F.col("date")))


def test_findings_follow_every_kind_of_commit(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    found = LedgerFindings(ledger, f"file://{tmp_path}/findings")
    assert found.refresh() == 0
    agree(ledger, found, T0)
    late = some(spark, 3, 60, first=30).withColumn("seq", F.lit(0))
    steps = [
        lambda: ledger.add(some(spark, 1, 150), now=AS_OF),
        lambda: ledger.add(some(spark, 2, 60, first=150), now=AS_OF),
        lambda: ledger.restore(late),
        lambda: ledger.delete(ledger.transactions().where("id LIKE '%1' OR id LIKE '%7'").select("id")),
        lambda: ledger.compact(),
        lambda: ledger.clear(),
    ]
    kinds = set()
    for step in steps:
        step()
        assert found.refresh() == found.version() == ledger.version()
        kinds |= agree(ledger, found, T0 + 31 * DAY)
    assert kinds == {"duplicate", "large_outflow", "airtime_spike", "aging_credit", "test_before_large"}
    assert found.findings(T0).isEmpty()


def test_a_finding_as_of_the_commit_it_follows(spark, tmp_path):
    """Until refresh the findings are those of the older commit; a row between two others parts and joins pairs."""
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    found = LedgerFindings(ledger, f"file://{tmp_path}/findings")
    ids = lambda: sorted(r.id for r in found.findings(T0 + DAY).collect())
    ledger.add(txns(spark, [("a", "in", 5, "p", T0), ("c", "in", 5, "p", T0 + 8 * MIN)]), now=AS_OF)
    found.refresh()
    assert ids() == ["dup:a:c"]
    ledger.add(txns(spark, [("b", "in", 5, "P", T0 + 4 * MIN)]), now=AS_OF)
    assert ids() == ["dup:a:c"]
    found.refresh()
    assert ids() == ["dup:a:b", "dup:b:c"]
    ledger.delete(spark.createDataFrame([("b",)], "id string"))
    ledger.update(txns(spark, [("c", "in", 5, "p", T0 + 11 * MIN)]))
    found.refresh()
    assert ids() == []


def test_an_insertion_reads_its_days_files(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    found = LedgerFindings(ledger, f"file://{tmp_path}/findings")
    for d in range(6):
        ledger.add(txns(spark, [(f"d{d}", "in", 1, "p", T0 + d * 5 * DAY)]), now=AS_OF)
    found.refresh()
    read, plain = [], ledger.log.read
    monkeypatch.setattr(ledger.log, "read", lambda snapshot, schema: read.append(len(snapshot.files)) or plain(snapshot, schema))
    ledger.add(txns(spark, [("new", "in", 1, "P", T0 + 5 * DAY + MIN)]), now=AS_OF)
    found.refresh()
    assert max(read) == 2 and len(ledger.log.snapshot().files) == 7
    agree(ledger, found, T0 + DAY)


def test_a_stream_keeps_findings_current(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    found = LedgerFindings(ledger, f"file://{tmp_path}/findings", round_unit_santim=1000)
    rows = txns(spark, [(f"n{i}", "out", 1000 if i % 4 else 500_000, "p", T0 + i * 11 * MIN) for i in range(24)], seq=True)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    for n in (2, 0, 1):
        rows.where(f"seq % 3 = {n}").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n:03d}")
    ingest_stream(stream, ledger, f"file://{tmp_path}/cp", totals=[found]).awaitTermination()
    assert found.version() == ledger.version() == 3
    want = rules.all_findings(ledger.transactions(), T0 + DAY).where("kind <> 'test_before_large'").unionByName(rules.probes(ledger.transactions(), 1000))
    got = found.findings(T0 + DAY)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.where("kind = 'test_before_large'").count() > 0


def test_rows_that_went_are_looked_up_once(spark, tmp_path, monkeypatch):
    """Of all tables together one reads the ledger as it was."""
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    found = LedgerFindings(ledger, f"file://{tmp_path}/findings")
    ledger.add(some(spark, 5, 60), now=AS_OF)
    found.refresh()
    ledger.delete(ledger.transactions().where("id LIKE '%1'").select("id"))
    asked, plain = [], ledger.log.at
    monkeypatch.setattr(ledger.log, "at", lambda version: asked.append(version) or plain(version))
    found.refresh()
    assert asked == [1]
    agree(ledger, found, T0 + 31 * DAY)


def test_findings_made_anew_as_a_whole_leave_no_lists(spark, tmp_path):
    """A change in all buckets replaces the table; one in some of them lists the ids that went."""
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    found = LedgerFindings(ledger, f"file://{tmp_path}/findings")
    early, late = ([(f"{name}{i}", "in", 5, "p", T0 + d * DAY + i * 4 * MIN) for i in range(3)] for name, d in (("a", 0), ("b", 5)))
    for rows, lists in (([early[0], late[0], early[2], late[2]], 0), ([early[1], late[1]], 0), ([("c", "in", 5, "p", T0 + 9 * MIN)], 1)):
        ledger.add(txns(spark, rows), now=AS_OF)
        found.refresh()
        assert len(found._pairs._log.snapshot().gone) == lists
        agree(ledger, found, T0 + DAY)
