"""Fixtures with hand-derived results, and property tests of the order-dependent operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from coinloom.functions import scalar
from coinloom.functions.scalar import millis_iso
from coinloom.operators import findings, ingest, listing, ocr, sms
from coinloom.schema import TRANSACTION
from coinloom.sources import store
from coinloom.streaming.refresh import ingest_stream

MIN, DAY = 60_000, 86_400_000
T0 = 1_700_000_000_000
AS_OF = "2026-01-01T00:00:00.000Z"


def txns(spark, rows, seq=False):
    """rows: (id, type, amount, party, ms[, settled])"""
    data = [(r[0], r[1], r[2], r[3], r[4], r[5] if len(r) > 5 else None, i) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(data, "id string, type string, amountSantim long, party string, ms long, settled boolean, seq long")
    frame = frame.select("id", "type", "amountSantim", "party", F.lit("CBE").alias("channel"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast("string").alias("note"), millis_iso(F.col("ms")).alias("date"), "settled", F.lit("").alias("createdAt"), "seq")
    return frame if seq else frame.drop("seq")


CASES = [
    ("Telebirr: You have received ETB 500.00 from Alemu Kebede. Ref: TB123456", "in", "Telebirr", 50000, "Alemu Kebede", "TB123456", False),
    ("Telebirr: You have paid ETB 1,250.75 to Mesfin Getachew on 2026-07-15. Ref: TB999888", "out", "Telebirr", 125075, "Mesfin Getachew", "TB999888", False),
    ("Telebirr: Airtime purchase ETB 100.00 successful.", "airtime", "Telebirr", 10000, "Airtime", None, False),
    ("CBE: Your account has been credited with ETB 2500.00 from Almaz T. on 2026-07-01. Ref: CBE7788", "in", "CBE", 250000, "Almaz T", "CBE7788", False),
    ("CBE: Your account has been debited ETB 400.00 to Water Utility. Ref: CBE0001", "out", "CBE", 40000, "Water Utility", "CBE0001", False),
    *[(f"{b}: Your account credited ETB 100.00 from Test User on 2026-01-01. Ref: X1", "in", b, 10000, "Test User", None, False) for b in ("Awash", "Dashen", "Abyssinia", "Wegagen")],
    ("Payment ETB 10.00 to fromage-shop on 2026-01-01", "out", "Other", 1000, "fromage-shop", None, False),
    ("Some vague alert about ETB 200.00 that happened", "out", "Other", 20000, "Unknown", None, True),
    ("Telebirr received ETB 1,234,567.89 from Big Co.", "in", "Telebirr", 123456789, "Big Co", None, False),
    ("You have received ETB 500.00 from Alemu Kebede via Telebirr. Ref: TB123456", "in", "Other", 50000, "Alemu Kebede via Telebirr", "TB123456", False),
    ("loan repayment received Br. 30", "credit", "Other", 3000, "Unknown", None, False),
    ("Refunded ETB , to x", "out", "Other", 0, "x", "unded", False),
]


def test_single_messages(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    rows = frame.select("i", sms.parse_one(F.col("text"), AS_OF).alias("r")).orderBy("i").collect()
    for case, row in zip(CASES, rows):
        r = row.r
        assert (r.type, r.channel, r.amountSantim, r.party, r.reference, r.needsReview) == case[1:], case[0]
        assert r.ok and r.date == AS_OF and r.raw == case[0]
    bad = spark.createDataFrame([("",), ("hello world",), (None,)], "text string").select(sms.parse_one(F.col("text"), AS_OF).alias("r")).collect()
    assert [r.r.ok for r in bad] == [False] * 3


def test_several_messages(spark):
    a, b = "Telebirr: received ETB 100.00 from Ayele K.", "CBE: credited ETB 200.00 from Zed A. Ref: X1"
    texts = [f"{a}\n\n{b}", f"{a}\n{a.replace('Ayele', 'Beti')}", f"hello\n\n{a}\n\nbye", f"x\n \n{b}\n\n{a}\n\ny", "", "nothing\n\nhere", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = sms.parse_many(frame, "text", AS_OF).orderBy("i", "pos").collect()
    assert [[r.ok for r in rows if r.i == i] for i in range(len(texts))] == [[True, True], [True, True], [True], [False, True, True, False], [], [False, False], []]
    assert next(r for r in rows if r.i == 2).raw == texts[2]
    dropped = sms.parse_many(frame, "text", AS_OF, boilerplate=lambda t: t == "hello").where("i = 2").count()
    assert dropped == 1


def test_screenshots(spark):
    text = "Refill History\n===\nAlmaz Abebe\n2026-01-05 1:05 PM\n2,500.00 Birr\n-\nKebede T 12\n2026-01-0612:30 AM\n-500.00 Birr\n9 Jan 2026\n1,000.00\nSara\n45%\nBirr"
    rows = ocr.match_lines(text, "Africa/Addis_Ababa")
    assert [(r["party"], r["amountSantim"], r["date"], r["needsReview"]) for r in rows] == [
        ("Almaz Abebe", 250000, "2026-01-05T10:05:00.000Z", False),
        ("Kebede T", 50000, "2026-01-05T21:30:00.000Z", True),
        ("Sara", 100000, "2026-01-08T21:00:00.000Z", False),
    ]
    assert rows[0]["note"] == "EVD refill to Almaz Abebe — 05/01/2026, 13:05:00"
    assert ocr.read_amount("50,000 Birr") is None and ocr.read_amount("1500.00") == (50000, False) and ocr.read_amount("2,050.00") is None
    assert ocr.read_date("2026-13-32 99:99 PM").isoformat() == "2027-02-05T16:39:00" and ocr.read_date("1 Foo 2026") is None
    frame = spark.createDataFrame([(1, text), (2, "short"), (3, text + " credited"), (4, None)], "d long, text string")
    assert [(r.d, r.pos) for r in ocr.parse_ocr(frame, "d", "text").collect()] == [(1, 0), (1, 1), (1, 2)]


def test_rule_boundaries(spark):
    dup = lambda *mins: findings.duplicates(txns(spark, [(f"t{m}", "in", 5, "P", T0 + int(m * MIN)) for m in mins])).count()
    assert dup(0, 5, 14) == 2 and dup(0, 10) == 1 and dup(0, 10.001) == 0
    as_of = T0 + DAY
    large = lambda *a: findings.large_outflows(txns(spark, [(f"t{i}", "out", x, "P", T0 + i) for i, x in enumerate(a)]), as_of).count()
    assert large(100, 100, 100, 301) == 1 and large(100, 100, 100, 300) == 0 and large() == 0
    spike = lambda days, big: findings.airtime_spikes(txns(spark, [(f"t{i}", "airtime", 2000 if i else big, "P", T0 + i * DAY) for i in range(days)])).count()
    assert spike(3, 10**9) == 0 and spike(4, 10**6) == 1 and spike(5, 6001) == 0
    for age, want in ((30 * DAY, []), (30 * DAY + 1, ["medium"]), (60 * DAY + 1, ["high"])):
        assert [r.severity for r in findings.aging_credits(txns(spark, [("c", "credit", 1, "P", as_of - age), ("s", "credit", 1, "P", as_of - age, True)]), as_of).collect()] == want
    probe = lambda a, gap: findings.probes(txns(spark, [("a", "out", a, "P", T0), ("b", "out", 10**6, "P", T0 + gap)])).count()
    assert probe(0, 30 * MIN - 1) == 1 and probe(0, 30 * MIN) == 0 and probe(10_000, 1) == 0
    rows = txns(spark, [("a", "out", 10_000, "P", T0), ("b", "out", 10**6, "P", T0 + 1)])
    assert findings.probes(rows, round_unit_santim=10_000).count() == 1


def greedy(rows, existing=()):
    taken, kept = {}, []
    for _, t, a, p, ms in existing:
        taken.setdefault((t, a, p.lower()), []).append(ms)
    for i, t, a, p, ms in rows:
        near = taken.setdefault((t, a, p.lower()), [])
        if all(abs(ms - x) > 10 * MIN for x in near):
            near.append(ms)
            kept.append(i)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_dedupe_matches_greedy(spark, seed):
    rng = random.Random(seed)
    make = lambda n, k: [(f"{k}{i}", rng.choice(["in", "out"]), rng.choice([1, 2]), rng.choice(["a", "A"]), T0 + rng.randint(-300, 300) * MIN) for i in range(n)]
    new, old = make(150, "n"), make(20, "o")
    got = ingest.dedupe(txns(spark, new, seq=True), txns(spark, old)).where("kept").collect()
    assert {r.id for r in got} == set(greedy(new, old))


def test_dedupe_keeps_0_and_16(spark):
    rows = txns(spark, [(str(m), "in", 1, "p", T0 + m * MIN) for m in (0, 8, 16)], seq=True)
    marked = ingest.dedupe(rows)
    assert {r.id for r in marked.where("kept").collect()} == {"0", "16"} and tuple(ingest.ingest_counts(marked).first()) == (2, 1)
    assert ingest.dedupe(rows.withColumn("date", F.lit("no date"))).where("kept").count() == 3


def test_dedupe_of_a_key_that_never_pauses(spark):
    rng = random.Random(8)
    rows = [(f"n{i}", "in", 1, None if i % 2 else "p", T0 + i * 1000) for i in range(3000)]
    rng.shuffle(rows)
    got = ingest.dedupe(txns(spark, rows, seq=True)).where("kept").collect()
    assert {r.id for r in got} == set(greedy([(*r[:3], r[3] or "", r[4]) for r in rows]))


@pytest.mark.parametrize("within", [0, 1, 7])
def test_accepted_in_small_windows(within):
    import pyarrow as pa

    rng = random.Random(within)
    times = [rng.randint(-40, 40) for _ in range(60)]
    n = len(times)
    names = [*ingest.KEY, "__island", "__seq", "__ms", "__row"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (["in"] * n, [1] * n, ["p"] * n, ["c"] * n, [0] * n, range(n), times, map(str, range(n)))], names)
    got = [r for b in ingest.accepted(iter([batch.slice(0, 25), batch.slice(25)]), within) for r in b.column(0).to_pylist()]
    near, want = [], []
    for i, ms in enumerate(times):
        if all(abs(ms - x) > within for x in near):
            near.append(ms)
            want.append(str(i))
    assert got == want


def test_bucketed_neighbours_match_global_lag(spark):
    rng = random.Random(5)
    rows = [(f"t{i}", "out", 1, "p", T0 + rng.randint(0, 2000) * MIN) for i in range(300)]
    got = findings.with_previous(findings.with_key(txns(spark, rows)), (), 30 * MIN, ("id",)).collect()
    line = sorted(((r[4], r[0]) for r in rows))
    assert {(r.prev_id, r.id) for r in got} == {(a[1], b[1]) for a, b in zip(line, line[1:]) if b[0] - a[0] <= 30 * MIN}


def test_exact_median(spark):
    rng = random.Random(6)
    import statistics

    for values in ([], [3], [1, 2], [1, 2, 10, 11], [rng.randint(0, 10**6) for _ in range(101)], [5] * 4 + [10**9] * 4):
        frame = spark.createDataFrame([(v,) for v in values], "v long")
        assert findings.exact_median(frame, "v").first().median == (statistics.median(values) if values else 0)


def test_rollup_names(spark):
    rows = txns(spark, [(str(i), "in", 1, p, T0 + i) for i, p in enumerate([" Abebe ", "Abebe", "abebe", "  ", " \t"])])
    assert {(r.party, r.n) for r in listing.party_rollup(rows).collect()} == {("Abebe", 2), ("abebe", 1), ("Unknown", 2)}


def test_four_meanings_of_out(spark):
    rows = txns(spark, [("a", "in", 1, "p", T0), ("b", "out", 2, "p", T0), ("c", "airtime", 4, "p", T0), ("d", "credit", 8, "p", T0), ("e", "credit", 16, "p", T0, True), ("f", "airtime_evd", 32, "p", T0)])
    assert listing.history_totals(rows).first().out_sum == 62 and listing.export_totals(rows).first().out_sum == 2
    r = listing.party_rollup(rows).first()
    assert (r.in_sum, r.out_sum, r.credit_sum, r.n) == (1, 54, 8, 6)
    t = listing.tiles(rows, T0, "UTC").first()
    assert (t.in_today, t.out_today, t.airtime_today, t.open_credit) == (1, 2, 4, 8)


def test_scalars(spark):
    f = lambda e, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "x string").select(e("x")).collect()]
    assert f(scalar.csv_cell, "=SUM(A1)", 'a"b', "x,y", "-5", None, "a\rb", "a\nb") == ["'=SUM(A1)", '"a""b"', '"x,y"', "'-5", "", "a\rb", '"a\nb"']
    assert f(scalar.text_to_santim, "1,234.5", " 1.005 ", "", ",", "abc") == [123450, 100, 0, 0, None]
    assert f(scalar.entry_to_santim, "ETB 1,000.50", "-5", "", ".", "1.2.3") == [100050, 500, None, None, None]
    assert f(scalar.trim_all, "   x y　\t") == ["x y"]
    r = spark.sql("select 123456789L a, -5L b, 5L c").select(scalar.format_etb("a"), scalar.format_etb("c", False), scalar.signed_etb(F.col("b") >= 0, "b"), scalar.type_label(F.lit("zz")), scalar.round_half_up(F.lit(-2.5))).first()
    assert list(r) == ["1,234,567.89 ETB", "0.05", "−0.05 ETB", None, -2]


def test_history_search(spark):
    rows = txns(spark, [("a", "in", 1, "Abebe", T0)]).withColumn("note", F.lit("Lunch"))
    assert [listing.history(rows, q).count() for q in ("ABEBE", "abebe  lunch", "abebe lunch", "", "   ", "x.*")] == [1, 1, 0, 1, 1, 0]


def test_store(spark, tmp_path):
    ledger = store.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.transactions().count() == 0 and ledger.ignored().count() == 0
    rows = txns(spark, [("a", "in", 1, "p", T0), ("b", "in", 1, "p", T0 + MIN), ("c", "credit", 2, "q,", T0 + DAY)], seq=True)
    assert ledger.add_deduped(rows) == (2, 1)
    ledger.set_ignored(spark.createDataFrame([("x",), ("x",), ("y",)], "id string"))
    again = txns(spark, [("a", "out", 7, "p", T0), ("a", "out", 9, "p", T0), ("z", "in", 3, "p", T0)], seq=True)
    assert ledger.restore(again) == 3
    assert {(r.id, r.amountSantim) for r in ledger.transactions().collect()} == {("a", 9), ("c", 2), ("z", 3)}
    store.write_csv(ledger.transactions(), f"file://{tmp_path}/csv")
    lines = [line for p in sorted((tmp_path / "csv").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[0] == store.CSV_HEADER and lines[1].endswith(',credit,0.02,"q,",CBE,,,no') and len(lines) == 4
    document = store.backup_document(ledger.transactions()).first().value
    assert [t["id"] for t in json.loads(document)["transactions"]][0] == "c"
    (tmp_path / "b.json").write_text(document)
    (tmp_path / "list.json").write_text(json.dumps(json.loads(document)["transactions"]))
    for name in ("b.json", "list.json"):
        back = store.read_backup(spark, f"file://{tmp_path}/{name}")
        assert back.drop("seq").columns == TRANSACTION.names and back.count() == 3
    (tmp_path / "none.json").write_text('{"version": 1}')
    assert store.read_backup(spark, f"file://{tmp_path}/none.json").count() == 0
    for bad in ("nonsense", '"text"', '{"transactions": 5}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="Invalid JSON backup"):
            store.read_backup(spark, f"file://{tmp_path}/bad.json").count()
    ledger.add(ledger.transactions().where("id = 'z'").withColumn("id", F.lit("y")).drop("note"))
    assert ledger.version() == 3 and ledger.transactions().count() == 4
    ledger.compact()
    assert ledger.version() == 4 and ledger.transactions().count() == 4
    ledger.delete(spark.createDataFrame([("y",)], "id string"))
    ledger.delete(spark.createDataFrame([("c",), ("none",)], "id string"))
    assert ledger.transactions().count() == 2
    ledger.clear()
    assert ledger.transactions().count() == 0 and ledger.ignored().count() == 2


def test_forms_and_imports(spark):
    entries = spark.createDataFrame([("10", " Abebe ", " ", "n"), ("0", "x", "", ""), ("", "x", "", ""), ("5", "  ", "", "")], "amount string, party string, reference string, note string")
    assert [tuple(r) for r in store.from_form(entries).collect()] == [("Abebe", None, "n", 1000)]
    parsed = sms.parse_many(spark.createDataFrame([("Br 0",), ("nothing",)], "text string"), "text", AS_OF)
    r = store.from_parsed(parsed, AS_OF).collect()
    assert len(r) == 1 and (r[0].party, r[0].channel, r[0].amountSantim) == ("Unknown", "Other", 0)


def test_stream_into_ledger(spark, tmp_path):
    ledger = store.Ledger(spark, f"file://{tmp_path}/ledger")
    rows = txns(spark, [("a", "in", 1, "p", T0), ("b", "in", 1, "p", T0 + MIN), ("c", "in", 1, "p", T0 + 11 * MIN)], seq=True)
    rows.write.parquet(f"file://{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    ingest_stream(stream, ledger, f"file://{tmp_path}/cp", lambda snapshot: seen.append(snapshot.count())).awaitTermination()
    assert {r.id for r in ledger.transactions().collect()} == {"a", "c"} and seen[-1] == 2


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(e.LEDGER) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_backup_parts_restore(spark, tmp_path):
    rows = txns(spark, [(f"i{k}", "in", k, 'q,"\n', T0 + k * DAY) for k in range(100)])
    for name, frame, size in (("many", rows, 9), ("one", rows, 1000), ("none", rows.limit(0), 9)):
        store.write_backup(frame, f"file://{tmp_path}/{name}", size)
        back = store.read_backup(spark, f"file://{tmp_path}/{name}")
        assert sorted(map(tuple, back.drop("seq").collect()), key=str) == sorted(map(tuple, frame.select(*[F.col(c) if c in frame.columns else F.lit(None).alias(c) for c in TRANSACTION.names]).collect()), key=str)
        assert [r.amountSantim for r in back.orderBy("seq").collect()] == sorted((r.amountSantim for r in frame.collect()), reverse=True)
    assert len(list((tmp_path / "many").glob("part-*"))) > 1
    for part in (tmp_path / "many").glob("part-*"):
        assert set(json.loads(part.read_text())) == {"version", "transactions"}
    (tmp_path / "lines.json").write_text('{"id":"a","type":"in"}\n{"id":"b","type":"in"}\n')
    with pytest.raises(Exception, match="Invalid JSON backup"):
        store.read_backup(spark, f"file://{tmp_path}/lines.json").count()


def test_every_order_gives_a_screenshot(spark, sf_dir):
    from coinloom.plans.queries import ORACLES
    from coinloom.sources.adapters import read, screenshots

    orders = {r.o_orderkey for r in read(spark, sf_dir, "orders").select("o_orderkey").collect()}
    assert {r.doc_id for r in screenshots(spark, sf_dir).select("doc_id").collect()} == orders and "% 3" not in ORACLES["ocr_parse"]


SHOT = "Refill History\n===\nAlmaz Abebe\n2026-01-05 1:05 PM\n2,500.00 Birr\n-\nKebede T 12\n2026-01-06 12:30 AM\n-500.00 Birr"


def test_pasted_text_goes_to_screenshots_messages_or_hooks(spark):
    empty_shot = "Birr 2026-01-01 2026-01-02 " + "lots of words without any amount line at all " * 3
    texts = [SHOT, "Telebirr received ETB 5.00 from Abe B.", empty_shot, None, "plain\nlist", "a\n\nb"]
    frame = spark.createDataFrame([(i, t, "kept", "gone") for i, t in enumerate(texts)], "i int, text string, blocks string, type string")
    rows = sms.parse_text(frame, "text", AS_OF).orderBy("i", "pos").collect()
    assert [(r.i, r.ok, r.type) for r in rows] == [(0, True, "airtime_evd"), (0, True, "airtime_evd"), (1, True, "in"), (2, False, None), (4, False, None), (4, False, None), (5, False, None), (5, False, None)]
    assert {r.blocks for r in rows} == {"kept"}
    fixed = lambda text: F.array(sms.parse_one(F.lit("ETB 7 bill"), AS_OF))
    rows = sms.parse_text(frame, "text", AS_OF, is_transfer_list=lambda t: F.contains(t, F.lit("list")), transfer_rows=fixed).where("i >= 4").orderBy("i", "pos").collect()
    assert [(r.i, r.ok, r.amountSantim) for r in rows] == [(4, True, 700), (5, False, None), (5, False, None)]


def test_insertion_gives_ids_and_survives_a_failed_write(spark, tmp_path):
    ledger = store.Ledger(spark, f"file://{tmp_path}/l")
    parsed = sms.parse_text(spark.createDataFrame([(0, SHOT), (1, "CBE debited ETB 4.00\nCBE debited ETB 4.00"), (2, "x")], "i int, text string"), "text", AS_OF)
    rows = store.from_parsed(parsed, AS_OF).withColumn("seq", F.col("i") * 10 + F.col("pos"))
    assert ledger.add_deduped(rows, now=AS_OF) == (3, 1)
    got = ledger.transactions().collect()
    assert len({r.id for r in got}) == 3 and all(r.id and r.createdAt == AS_OF for r in got)
    ledger.add(rows.limit(1).drop("seq"))
    ledger.add(store.from_form(spark.createDataFrame([("5", "p", "", "", "2026-01-05T13:05", "out", "CBE")], "amount string, party string, reference string, note string, date string, type string, channel string"), "Africa/Addis_Ababa"))
    typed = ledger.transactions().where("party = 'p'").first()
    assert (typed.date, typed.type, typed.channel, typed.amountSantim) == ("2026-01-05T10:05:00.000Z", "out", "CBE", 500)
    assert ledger.transactions().count() == 5 == ledger.transactions().select("id").distinct().count()
    left = tmp_path / "l" / "transactions" / "data" / "half"  # what a failed write leaves
    left.mkdir()
    (left / "part-0.parquet").write_bytes(b"half")
    (tmp_path / "l" / "transactions" / "log" / ".4-draft").write_bytes(b"{")
    ledger.update(ledger.transactions().where("party = 'p'").withColumn("note", F.lit("changed")))
    assert ledger.transactions().count() == 5 and ledger.transactions().where("note = 'changed'").count() == 1
    assert ledger.version() == 4


def one_island(n, seed, order, gap=5 * MIN):
    """n rows of one key without a gap above the window, by time, against it or in no order, some at one time."""
    rng = random.Random(seed)
    times, at = [], T0
    for _ in range(n):
        at += rng.choice([0, 1000, MIN, gap])
        times.append(at)
    rows = [(f"n{i}", "in", 1, "p", ms) for i, ms in enumerate(times)]
    return {"time": rows, "back": rows[::-1], "none": rng.sample(rows, n)}[order]


@pytest.mark.parametrize("order", ["time", "back", "none"])
def test_one_island_is_many_tasks(spark, order, monkeypatch):
    monkeypatch.setattr(ingest, "SEGMENT_WINDOWS", 5)
    rows = one_island(700, 1, order) + [(f"x{i}", "out", i % 7, None, T0 + i * MIN) for i in range(200)]
    old = [("o0", "in", 1, "P", rows[300][4]), ("o1", "out", 3, "q", T0)]
    got = ingest.dedupe(txns(spark, rows, seq=True), txns(spark, old), long_island=150).collect()
    assert len(got) == len(rows)
    assert {r.id for r in got if r.kept} == set(greedy([(*r[:3], r[3] or "", r[4]) for r in rows], old))


def test_long_island_goes_through_segments(spark, monkeypatch):
    called = []
    whole = ingest._through_segments
    monkeypatch.setattr(ingest, "SEGMENT_WINDOWS", 4)
    monkeypatch.setattr(ingest, "_through_segments", lambda *a: called.append(1) or whole(*a))
    regular = [(f"n{i}", "in", 1, "p", T0 + i * MIN) for i in range(600)]  # ways that never meet
    got = ingest.dedupe(txns(spark, regular, seq=True), long_island=200).where("kept").collect()
    assert called and {r.id for r in got} == {f"n{i}" for i in range(0, 600, 11)}


def test_rows_of_one_order_value_stay_one_row_each(spark):
    rows = txns(spark, [("a", "in", 1, "p", T0), ("b", "in", 2, "p", T0), ("c", "in", 1, "p", T0 + MIN), ("d", "in", 1, "p", T0), ("e", "in", 3, "p", T0)], seq=True)
    for seq in (F.lit(7), F.lit(None).cast("long"), F.when(F.col("id") == "c", 5), F.lit("text")):
        got = ingest.dedupe(rows.withColumn("seq", seq)).collect()
        assert sorted(r.id for r in got) == list("abcde")
        kept = [r.id for r in got if r.kept]
        assert len(kept) == 3 and {"b", "e"} < set(kept)
    assert [r.id for r in ingest.dedupe(rows.withColumn("seq", F.when(F.col("id") == "c", 5))).where("kept AND amountSantim = 1").collect()] == ["c"]
    alike = spark.range(4).select(*[F.lit("2026-01-01T00:00:00Z" if c == "date" else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    assert sorted(r.kept for r in ingest.dedupe(alike).collect()) == [False, False, False, True]
    two = ingest.dedupe(rows.withColumn("a.b", F.lit(1)), order=["channel", "seq"])
    assert two.where("kept").count() == 3 and "a.b" in two.columns


def test_interleaved_insertions_insert_once(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    first, second = store.Ledger(spark, path), store.Ledger(spark, path)
    rows = txns(spark, [(None, "in", 1, "p", T0), (None, "in", 2, "p", T0), (None, "in", 1, "p", T0 + MIN)], seq=True)
    put, seen = first._txns.put, []

    def late(version, change):
        if not seen:  # another writer commits between this one's reading and its commit
            seen.append(second.add_deduped(rows))
        return put(version, change)

    first._txns.put = late
    assert first.add_deduped(rows) == (0, 3) and seen == [(2, 1)]
    assert first.transactions().count() == 2 and first.version() == 2


def test_concurrent_insertions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    rows = txns(spark, [(None, "in", i, "p", T0) for i in range(20)], seq=True)
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda _: store.Ledger(spark, f"file://{tmp_path}/l").add_deduped(rows), range(3)))
    ledger = store.Ledger(spark, f"file://{tmp_path}/l")
    assert sorted(done) == [(0, 20), (0, 20), (20, 0)] and ledger.transactions().count() == 20
    log = ledger._txns
    assert log.put(4, log_change := store.Change()) and not log.put(4, log_change) and not log.put(1, log_change)


def test_an_insertion_reads_the_files_of_its_days(spark, tmp_path, monkeypatch):
    ledger = store.Ledger(spark, f"file://{tmp_path}/l")
    for day in range(4):
        ledger.add(txns(spark, [(f"d{day}-{i}", "in", i, "p", T0 + day * DAY + i) for i in range(3)]))
    ledger.add(txns(spark, [("undated", "in", 1, "p", T0)]).withColumn("date", F.lit("never")))
    opened = []
    read = ledger._txns.read
    ledger._txns.read = lambda snapshot, schema: opened.append([f.path for f in snapshot.files]) or read(snapshot, schema)
    assert ledger.add_deduped(txns(spark, [("x", "in", 1, "p", T0 + 2 * DAY + MIN), ("y", "in", 9, "p", T0 + 2 * DAY)], seq=True)) == (1, 1)
    ms = [row.date for path in opened[0] for row in spark.read.parquet(f"file://{tmp_path}/l/transactions/{path}").collect()]
    assert ms and {d[:10] for d in ms} == {"2023-11-16"}
    assert {r.id for r in ledger.transactions(T0 + DAY, T0 + 2 * DAY - 1).collect()} == {f"d1-{i}" for i in range(3)}
    assert {r.id for r in ledger.transactions(T0 + 2 * DAY).collect()} == {*(f"d2-{i}" for i in range(3)), *(f"d3-{i}" for i in range(3)), "y"}
    assert ledger.transactions().count() == 14


def test_updates_and_deletions_write_what_they_change(spark, tmp_path):
    ledger = store.Ledger(spark, f"file://{tmp_path}/l")
    ledger.add(txns(spark, [(f"i{k}", "in", k, f"party {k}", T0 + k * MIN) for k in range(20_000)]))
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    before = size()
    ledger.update(txns(spark, [("i7", "out", 70, "new", T0)]))
    ledger.delete(spark.createDataFrame([("i8",), ("none",), (None,)], "id string"))
    assert size() - before < before / 20
    got = {r.id: r.amountSantim for r in ledger.transactions().where("amountSantim < 100").collect()}
    assert got["i7"] == 70 and "i8" not in got and ledger.transactions().count() == 19_999
    ledger.update(txns(spark, [("i8", "out", 8, "back", T0)]))
    ledger.update(txns(spark, [("i7", "out", 71, "again", T0)]))
    again = ledger.transactions().where("id IN ('i7', 'i8')").collect()
    assert sorted((r.id, r.amountSantim) for r in again) == [("i7", 71), ("i8", 8)]
    ledger.compact()
    assert sorted((r.id, r.amountSantim) for r in ledger.transactions().where("id IN ('i7', 'i8')").collect()) == [("i7", 71), ("i8", 8)] and ledger.transactions().count() == 20_000


def test_rows_to_restore_without_ids_are_new_rows(spark, tmp_path):
    ledger = store.Ledger(spark, f"file://{tmp_path}/l")
    rows = txns(spark, [(None, "in", 1, "p", T0), (None, "in", 1, "p", T0), ("a", "in", 2, "p", T0), ("a", "in", 3, "p", T0)], seq=True)
    assert ledger.restore(rows) == 4
    got = ledger.transactions().collect()
    assert len({r.id for r in got}) == 3 == len(got) and all(r.id for r in got) and [r.amountSantim for r in got if r.id == "a"] == [3]
    assert ledger.restore(rows.drop("id")) == 4 and ledger.transactions().count() == 7
    new = rows.drop("createdAt")
    assert ingest.upsert(txns(spark, [("a", "in", 9, "p", T0)]), new, "seq").count() == 3


def test_pasted_texts_of_many_messages(spark, tmp_path):
    ledger = store.Ledger(spark, f"file://{tmp_path}/l")
    texts = ["\n".join(f"CBE debited ETB {k}.00" for k in range(start, start + 12)) for start in (1, 13, 1)]
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "n int, `the.text` string, pos int")
    assert ledger.paste(frame, "the.text", AS_OF, "n") == (24, 12)
    got = ledger.transactions().collect()
    assert len(got) == 24 == len({r.id for r in got}) and {r.amountSantim for r in got} == {100 * k for k in range(1, 25)}
    assert ledger.paste(frame.withColumn("n", F.lit(None).cast("int")), "the.text", AS_OF, "n") == (0, 36)


def test_a_batch_again_inserts_nothing(spark, tmp_path):
    ledger = store.Ledger(spark, f"file://{tmp_path}/l")
    rows = txns(spark, [(None, "in", 1, "p", T0), (None, "in", 2, "p", T0)], seq=True).drop("id").withColumn("date", F.lit("no date"))
    assert ledger.add_deduped(rows, batch=("s", 0)) == (2, 0)
    assert ledger.add_deduped(rows, batch=("s", 0)) == (0, 2)
    assert ledger.add_deduped(rows, batch=("s", 1)) == (2, 0) and ledger.add_deduped(rows, batch=("t", 0)) == (2, 0)
    ledger.compact()
    assert ledger.add_deduped(rows, batch=("s", 1)) == (0, 2) and ledger.transactions().count() == 6


def test_long_texts_are_parsed_in_time(spark):
    import time

    filler = "telebirr CBE Awash account notice paid received credited debited " * 1600
    frame = spark.createDataFrame([(filler,), (filler + " ETB 5.00 from Abe B.",)], "text string").repartition(2)
    sms.parse_many(frame.limit(0), "text", AS_OF).collect()
    began = time.perf_counter()
    rows = sms.parse_many(frame, "text", AS_OF).collect()
    assert sorted((r.ok, r.amountSantim) for r in rows) == [(False, None), (True, 500)] and time.perf_counter() - began < 20
