"""The ledger, and text, JSON and CSV in and out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import DAY_MS, csv_cell, entry_to_santim, iso_millis, santim_to_etb, trim_all
from ..operators.ingest import WINDOW_MS, decide, ingest_counts, last_by_id, numbered
from ..operators.sms import parse_text
from ..schema import TRANSACTION
from .log import Change, DataFile, TableLog
from .scratch import scratch

CSV_HEADER = "date,type,amount_etb,party,channel,reference,note,settled"
#: Transactions of one file of a backup; read_backup reads a file as one text.
BACKUP_ROWS = 50_000
IGNORED = T.StructType([T.StructField("id", T.StringType())])


class Ledger:
    """Transactions and dismissed findings under one path, each a table under a log of commits.

    Writers work against a snapshot and commit after it. What depends on the rows there
    (duplicate suppression, compaction) is done again if another commit came first, so that
    two imports of the same rows insert them once; insertion, upsert and deletion hold after
    any other commit. An upsert or deletion writes what it changes: rows of listed ids are
    left out on reading, until compact() makes one commit of all. A failed write changes
    nothing and readers keep what they read.

    Rows without an id get one, rows without createdAt get `now`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._txns, self._ignored = TableLog(spark, f"{self.path}/transactions"), TableLog(spark, f"{self.path}/ignored")

    @property
    def log(self) -> TableLog:
        """The transactions' commits and files."""
        return self._txns

    def version(self) -> int:
        """Number of the newest commit of the transactions."""
        return self._txns.snapshot().version

    def transactions(self, first_ms: int | None = None, last_ms: int | None = None) -> DataFrame:
        """All transactions, or those of dates between two times (both included)."""
        snapshot = self._txns.snapshot()
        if first_ms is None and last_ms is None:
            return self._txns.read(snapshot, TRANSACTION)
        first, last = -(1 << 63) if first_ms is None else first_ms, (1 << 63) - 1 if last_ms is None else last_ms
        return self._txns.read(snapshot.within([(first, last)]), TRANSACTION).where(iso_millis("date").between(first, last))

    def _files(self, rows: DataFrame) -> tuple[DataFile, ...]:
        return self._txns.write(rows, TRANSACTION, iso_millis("date"))

    def add(self, rows: DataFrame, now: str | None = None) -> None:
        self._txns.commit(Change(self._files(with_ids(rows, now))))

    def compact(self) -> None:
        """The same rows in files of one commit, by time."""
        done = False
        while not done:
            snapshot = self._txns.snapshot()
            change = Change(self._files(self._txns.read(snapshot, TRANSACTION)), replaces=True)
            done = self._txns.put(snapshot.version + 1, change)

    def add_deduped(self, rows: DataFrame, order: str | Sequence[str] = "seq", now: str | None = None, batch: tuple[str, int] | None = None) -> tuple[int, int]:
        """(inserted, skipped). Only files that may hold rows in reach are read. A micro-batch (stream, number) that is in the table already, or an older one, inserts nothing."""
        now, new = now or _now(), numbered(rows)
        ranges = _reach(new)
        while True:
            snapshot = self._txns.snapshot()
            if batch and dict(snapshot.batches).get(batch[0], -1) >= batch[1]:
                return 0, new.count()
            near = snapshot.within(ranges)
            marked = decide(new, self._txns.read(near, TRANSACTION) if near.files else None, order=order)
            counts = ingest_counts(marked).first()
            files = self._files(with_ids(marked.where("kept"), now)) if counts.inserted else ()
            if self._txns.put(snapshot.version + 1, Change(files, batch=batch)):
                return counts.inserted, counts.skipped

    def paste(self, texts: DataFrame, text_col: str, as_of: str, order: str | Sequence[str] = "seq", tz: str = "Africa/Addis_Ababa", now: str | None = None, **hooks) -> tuple[int, int]:
        """(inserted, skipped) of all messages and screenshots in pasted texts, in the order of the texts and of the places in them."""
        orders = [order] if isinstance(order, str) else list(order)
        place = [F.col(c).alias(f"__order_{i}") for i, c in enumerate(orders)]
        parsed = parse_text(texts.select(*place, F.col(f"`{text_col}`").alias("__text")), "__text", as_of, tz, **hooks)
        return self.add_deduped(from_parsed(parsed, as_of).drop("__text"), [f"__order_{i}" for i in range(len(orders))] + ["pos"], now or as_of)

    def update(self, row: DataFrame) -> None:
        """One whole record in the place of that with its id, or as a new one."""
        self.restore(row.withColumn("seq", F.lit(0)))

    def restore(self, rows: DataFrame, order: str = "seq") -> int:
        """Upsert by id; the number of rows given, repeated ids included. Rows without an id are new ones."""
        given = scratch(with_ids(rows).withColumn("__new", F.col("id").isNull() if "id" in rows.columns else F.lit(True)), "restore")
        gone = (self._txns.write_ids(given.where("NOT __new")),) if "id" in rows.columns else ()
        self._txns.commit(Change(self._files(last_by_id(given.drop("__new"), order)), gone))
        return given.count()

    def delete(self, ids: DataFrame) -> None:
        self._txns.commit(Change(gone=(self._txns.write_ids(ids),)))

    def clear(self) -> None:
        """Transactions only; dismissed findings stay."""
        self._txns.commit(Change(replaces=True))

    def ignored(self) -> DataFrame:
        try:
            return self._ignored.read(self._ignored.snapshot(), IGNORED)
        except AnalysisException:
            return self.spark.createDataFrame([], IGNORED)

    def set_ignored(self, ids: DataFrame) -> None:
        self._ignored.commit(Change(self._ignored.write(ids.select("id").distinct(), IGNORED), replaces=True))


#: Most days of an insertion that are looked up one by one; of more the whole time between the first and the last is.
MOST_DAYS = 10_000


def _reach(rows: DataFrame, within_ms: int = WINDOW_MS) -> list[tuple[int, int]]:
    """Times in which a row may refuse one of these (with `__ms`): each day that has one, and the window on both sides."""
    day = F.floor(F.col("__ms") / DAY_MS).cast("long")
    days = rows.where("__ms IS NOT NULL").select(day.alias("day")).distinct().limit(MOST_DAYS + 1).collect()
    if len(days) > MOST_DAYS:
        ends = rows.agg(F.min("__ms").alias("first"), F.max("__ms").alias("last")).first()
        return [(ends.first - within_ms, ends.last + within_ms)]
    return [(r.day * DAY_MS - within_ms, (r.day + 1) * DAY_MS - 1 + within_ms) for r in days]


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def with_ids(rows: DataFrame, now: str | None = None) -> DataFrame:
    """Rows with `id` and `createdAt`: given ones stay; a new id is of its own for every row, alike ones included."""
    now = now or _now()
    made = F.substring(F.sha2(F.uuid(), 256), 1, 24)
    given = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("id", F.coalesce(given("id"), made)).withColumn("createdAt", F.coalesce(given("createdAt"), F.lit(now)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, `value` its whole text."""
    return spark.read.text(path, wholetext=True)


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of JSON backups, an array or an object with `transactions`; `seq` is their order, by file name and place.

    An object without `transactions` is empty; one that is a transaction itself (JSON lines) is an error.
    """
    rows = T.ArrayType(TRANSACTION)
    wrapped = T.StructType([T.StructField("version", T.LongType()), T.StructField("transactions", rows)])
    read = read_texts(spark, path)
    files = F.array(*[F.lit(f) for f in sorted(read.inputFiles())]).cast("array<string>")
    text = read.withColumn("__file", F.array_position(files, F.input_file_name()) - 1)
    plain = F.when(F.ltrim("value").startswith("["), F.from_json("value", rows))
    lone = F.coalesce(*[F.get_json_object("value", f"$.{c}") for c in ("id", "amountSantim", "type")]).isNotNull()
    empty = F.get_json_object("value", "$.transactions").isNull() & F.get_json_object("value", "$").isNotNull() & ~lone
    inside = F.when(F.ltrim("value").startswith("{"), F.coalesce(F.from_json("value", wrapped)["transactions"], F.when(empty, F.array().cast(rows))))
    found = F.coalesce(plain, inside)
    checked = text.select("__file", F.when(found.isNull(), F.raise_error(F.lit("Invalid JSON backup"))).otherwise(found).alias("rows"))
    placed = checked.select("__file", F.posexplode_outer("rows").alias("__at", "t")).where("__at IS NOT NULL")
    return placed.select((F.col("__file") * (1 << 32) + F.col("__at")).alias("seq"), "t.*")


def backup_rows(txns: DataFrame) -> DataFrame:
    """`value`: the JSON record of each transaction, missing fields left out, with its date and id."""
    fields = [n for n in TRANSACTION.names if n in txns.columns]
    return txns.select("id", "date", F.to_json(F.struct(*fields)).alias("value"))


def write_backup(txns: DataFrame, path: str, part_rows: int = BACKUP_ROWS) -> None:
    """A folder of JSON backups for read_backup, newest first by file name, each a document of about part_rows transactions."""
    lines = backup_rows(txns)
    order = [F.desc("date"), F.asc("id")]
    parts = lines.repartitionByRange(lines.count() // part_rows + 1, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = '{"version":1,"transactions":['
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                out.append(before + value)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]}" if before == "," else before + "]}"])], ["value"])

    parts.select("value").mapInArrow(run, "value string").write.option("maxRecordsPerFile", 0).text(path)


def backup_document(txns: DataFrame) -> DataFrame:
    """One row with the whole backup as one JSON document, for ledgers that fit in one string."""
    newest = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("date").alias("__d"), *TRANSACTION.names))))
    body = F.transform(newest, lambda t: F.struct(*[t[n].alias(n) for n in TRANSACTION.names]))
    return txns.agg(F.to_json(F.struct(F.lit(1).alias("version"), body.alias("transactions"))).alias("value"))


def csv_rows(txns: DataFrame) -> DataFrame:
    """`value`: the CSV line of each transaction, with its date and id."""
    settled = F.when(F.col("type") == "credit", F.when(F.coalesce("settled", F.lit(False)), "yes").otherwise("no"))
    cells = ["date", "type", santim_to_etb("amountSantim"), "party", "channel", "reference", "note", settled]
    return txns.select("id", "date", F.concat_ws(",", *map(csv_cell, cells)).alias("value"))


def write_csv(txns: DataFrame, path: str) -> None:
    """Header and lines, newest first, in the order of the part files."""
    head = txns.sparkSession.createDataFrame([(0, "", "", CSV_HEADER)], "k int, date string, id string, value string")
    lines = csv_rows(txns).select(F.lit(1).alias("k"), "date", "id", "value").unionByName(head)
    lines.orderBy("k", F.desc("date"), "id").select("value").write.text(path)


def from_form(entries: DataFrame, tz: str | None = None) -> DataFrame:
    """Typed entries (amount text, party, ...) that have a positive amount and a party; with tz a `date` is wall-clock time there (yyyy-MM-ddTHH:mm) and becomes UTC."""
    blank = lambda c: F.nullif(trim_all(c), F.lit(""))
    rows = entries.withColumn("amountSantim", entry_to_santim("amount")).withColumn("party", blank("party"))
    rows = rows.withColumn("reference", blank("reference")).withColumn("note", blank("note"))
    if tz:
        utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col("date").cast("timestamp_ntz"))
        rows = rows.withColumn("date", F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return rows.where((F.col("amountSantim") > 0) & F.col("party").isNotNull()).drop("amount")


def from_parsed(parsed: DataFrame, as_of: str) -> DataFrame:
    """Good parsed rows as transactions: party Unknown, channel Other and date as_of where missing; zero amounts pass."""
    blank = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    keep = [c for c in parsed.columns if c not in ("ok", "raw", "needsReview", "party", "channel", "date")]
    return parsed.where("ok").select(*keep, blank("party", "Unknown"), blank("channel", "Other"), blank("date", as_of))


def valid_dates(txns: DataFrame) -> DataFrame:
    return txns.where(iso_millis("date").isNotNull())
