"""Queries against their SQL where ids don't come in the order of time."""

import json
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from coinloom.functions.scalar import iso_millis, millis_iso
from coinloom.operators import ingest, ocr, sms
from coinloom.operators.ocr import match_lines
from coinloom.schema import TRANSACTION
from coinloom.sources import document
from coinloom.sources.log import TableLog

from .oracle import connect, same


@pytest.fixture(scope="module")
def turned(tmp_path_factory, sf_dir):
    """Events in which later numbers are of earlier times, half of them a few minutes after another one of their key."""
    path = str(tmp_path_factory.mktemp("turned"))
    duckdb.connect().execute(f"""COPY (SELECT 9999 - event_id AS event_id, ts, user_id, event_type, value, props FROM '{sf_dir}/events.parquet'
        UNION ALL SELECT 19999 - event_id, ts + to_microseconds(420017000), user_id + 14, event_type, value, props FROM '{sf_dir}/events.parquet') TO '{path}/events.parquet'""")
    return path


@pytest.mark.parametrize("name", ["ingest_counts", "ingest_dedupe", "ingest_dedupe_known", "ledger_concurrent_insert"])
def test_order_is_that_of_time(spark, turned, name):
    found, expected = same(entry.queries()[name](spark, turned), connect(turned), entry.oracle_sql()[name])
    assert found == expected


def test_long_list_takes_linear_time():
    """Four times the entries of one screenshot take about four times as long."""

    def seconds(n):
        text = "Refill History\n" + "".join(f"2024-01-01 1:05 PM\nAlmaz Abebe\n{i // 100},{i % 1000:03}.37 Birr\n" for i in range(1, n + 1))
        begun = time.process_time()
        assert match_lines(text, "Africa/Addis_Ababa")
        return time.process_time() - begun

    seconds(8_000)
    assert seconds(8_000) < 9 * seconds(2_000)


def test_single_writer_of_a_document_sorts_nothing(spark, tmp_path, monkeypatch):
    """The task that writes the one file gets the ranges as files that other tasks sorted."""
    given = []
    monkeypatch.setattr(document, "_write_one", lambda spark, files, folder, write=document._write_one: (given.extend(files), write(spark, files, folder)))
    rows = spark.range(5_000, numPartitions=8).selectExpr("'n' || id AS id", "id AS amountSantim", "'2024-01-' || lpad(1 + id % 28, 2, '0') AS date")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        document.write_document(rows, f"file://{tmp_path}/a.json")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(given) == 4
    found = [(r["date"], r["id"]) for r in json.loads((tmp_path / "a.json").read_text())["transactions"]]
    assert found == sorted(sorted(found, key=lambda x: x[1]), key=lambda x: x[0], reverse=True)
    assert len(set(found)) == len(found) == 5_000


def test_rows_of_one_time_are_written_by_many_tasks(spark, tmp_path):
    """Pasted messages all have the moment of the import."""
    table = TableLog(spark, f"file://{tmp_path}/table")
    rows = spark.range(20_000, numPartitions=4).selectExpr("'n' || id AS id", "1L AS amountSantim", "'2024-01-01' AS date")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = table.write(rows, TRANSACTION, iso_millis("date"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(files) == 4 and max(f.rows for f in files) < 10_000 and sum(f.rows for f in files) == 20_000


def test_short_islands_are_decided_without_a_task_in_order(spark, monkeypatch):
    """Only rows of islands longer than the window go one by one."""
    rows = spark.range(400).selectExpr("'n' || id AS id", "'in' AS type", "id % 100 AS amountSantim", "'p' AS party", "'CBE' AS channel", "id AS seq", "timestamp_millis(1700000000000 + (id div 100) * if(id % 100 < 90, 150000, 400000)) AS at")
    rows = rows.withColumn("date", millis_iso(F.unix_millis("at"))).drop("at")
    given, plain = [], ingest._in_order
    monkeypatch.setattr(ingest, "_in_order", lambda islands, within: given.append(islands.count()) or plain(islands, within))
    kept = sorted(int(r.id[1:]) for r in ingest.dedupe(rows).where("kept").collect())
    assert kept == [*range(100), *range(290, 300)]
    assert given == [40]


def test_screenshots_of_one_layout_are_laid_out_once():
    """Lists of other names, days and amounts, but of the same kinds of lines, share the search for what belongs together."""
    shot = lambda i: "Refill History\n" + "".join(f"2024-01-0{h} {h}:05 PM\n{n} Abebe\n{i}1,000.{h}7 Birr\n" for h, n in ((1, "Almaz"), (2, "Sara")))
    before = ocr._known_places.cache_info().misses
    found = [[(r["party"], r["amountSantim"], r["date"]) for r in match_lines(shot(i), "UTC")] for i in range(1, 10)]
    assert found == [[("Almaz Abebe", i * 1_000_000 + 100_017, "2024-01-01T13:05:00.000Z"), ("Sara Abebe", i * 1_000_000 + 100_027, "2024-01-02T14:05:00.000Z")] for i in range(1, 10)]
    assert ocr._known_places.cache_info().misses <= before + 1


def test_patterns_are_searched_only_in_texts_with_all_their_words(spark):
    """Every rule's words: a text without one of them can't have the rule's finding, whatever else it says."""
    for rule in sms.RULES:
        for words in rule.guard:
            assert len(min(words, key=len)) > 1 and all(re.search(word, rule.pattern, re.I) for word in words)
    texts = ["TELEBIRR you SENT etb 5 To Abel. Ref: AB12", "cbe PAID birr 7", "Dashen withdrawn Br. 9 to A B, ok", "telebirr airtime received", "br 3 FROM Zed"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", sms.parse_one(F.col("text"), "2024").alias("r")).orderBy("i").collect()
    assert [(r.r.ok, r.r.type, r.r.amountSantim, r.r.party, r.r.channel) for r in rows] == [
        (True, "out", 500, "Abel", "Telebirr"),
        (False, None, None, None, None),
        (True, "out", 900, "A B", "Dashen"),
        (False, None, None, None, None),
        (True, "in", 300, "Zed", "Other"),
    ]
