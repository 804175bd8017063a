"""JSON documents cut into blocks of any size, against a JSON parser."""

import json
import random

import pytest

from coinloom.schema import TRANSACTION
from coinloom.sources.document import read_document, write_document

from .test_ledger import MIN, T0, txns

TEXTS = ['plain', '{"id":"no record"}', 'a } b { c', 'quote " and \\ and \\" {', '\\\\{', '"},{"id":"x"', "\n{\r\n", "ሰላም {", "", None]


@pytest.fixture(params=[24, 97, 700, 1 << 20])
def blocks(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def records(n, seed):
    rng = random.Random(seed)
    return [{"id": f"n{i}", "amountSantim": i, "note": rng.choice(TEXTS), **({"party": rng.choice(TEXTS)} if i % 3 else {}), **({"more": {"in": [{"a": "}"}], "b": {}}} if i % 4 == 1 else {})} for i in range(n)]


def check(spark, path, rows):
    found = read_document(spark, f"file://{path}").orderBy("seq").collect()
    assert [(r.id, r.amountSantim, r.note, r.party) for r in found] == [(r["id"], r["amountSantim"], r["note"], r.get("party")) for r in rows]


def test_blocks_of_any_size_give_the_records(spark, tmp_path, blocks):
    rows = records(40, blocks)
    text = json.dumps({"version": 1, "transactions": rows, "exportedAt": "}{"}, ensure_ascii=False, indent=1 if blocks > 50 else None)
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(json.dumps(rows[:7]))
    (tmp_path / "c.json").write_text(' {"version": 1} ')
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "e.json").write_text("")
    check(spark, tmp_path, rows + rows[:7])


@pytest.mark.parametrize(
    "text", ['{"version":1,"transactions":[{"id":"a"}', '[{"id":"a"', '[{"id":"a}]', "hello", '{"id":"a","type":"in"}', '{"id":"a"}\n{"id":"b"}', '{"other":[{"id":"a"}],"transactions":[]}', '{"transactions":[{"unknown":1}]}', '{"transactions":[{"id":}]}']
)
def test_what_is_no_backup_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="Invalid JSON backup"):
        read_document(spark, f"file://{tmp_path}/a.json").collect()


def test_a_document_is_one_file_newest_first(spark, tmp_path):
    rows = [(f"n{i:02d}", "in", i, f'p"{i}{{', T0 + (i * 7 % 30) * MIN) for i in range(30)]
    path = f"file://{tmp_path}/backup.json"
    for part in (rows, rows[:20]):  # the second takes the first one's place
        frame = txns(spark, part).repartition(5)
        write_document(frame, path)
        body = json.loads((tmp_path / "backup.json").read_text())
        assert body["version"] == 1 and [t["date"] for t in body["transactions"]] == sorted((r.date for r in frame.collect()), reverse=True)
        found = read_document(spark, path)
        assert sorted(map(str, found.select(*TRANSACTION.names).collect())) == sorted(map(str, frame.select(*TRANSACTION.names).collect()))
    write_document(txns(spark, rows).limit(0), path)
    assert json.loads((tmp_path / "backup.json").read_text()) == {"version": 1, "transactions": []}
    assert read_document(spark, path).isEmpty()
