"""One JSON document of any size: read by many tasks, written as one file.

A document is an array of records or an object with such an array, `transactions`. Spark's
text source cuts it into blocks, and those into pieces at every opening brace, also inside
texts. Whether a block begins inside a string, and how deep in braces, follows from those
before it, so the first reading sums each block up in one row, for both cases, and the second
one, which knows where it stands, gives records. Nothing is shuffled but records
that a block's end parts, one a block at most. A task holds a record whole, never a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TRANSACTION
from .scratch import scratch, scratch_path

ESCAPED = re.compile(r"\\.", re.S)
#: A string, whole or up to the piece's end (then without group 1), or a closing brace; the rest of a string.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("?)|\}', re.S)
REST = re.compile(r'(?:[^"\\]|\\.)*+("?)', re.S)
ARRAY = re.compile(r'"transactions"\s*:\s*\[\s*$')
LONE = re.compile(r'"(?:id|amountSantim|type)"\s*:')
WHOLE, OPENED, GOES_ON = 0, 1, 2
INVALID = "Invalid JSON backup"
#: Places in one file; longer files would need wider numbers.
PLACES = 1 << 44
#: Records of one line of a written document.
PIECE_ROWS = 1_000
_BLOCK = ("file", "block")
_SUMS = "file string, block long, parity int, deeper_out long, deeper_in long, first string, pieces long"
_FOUND = "file string, block long, at long, kind int, text string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "{").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")


def _depths(piece: str) -> tuple[int, int, int]:
    """Quotes, and what the closing and opening braces add to the depth if the piece begins outside of a string, and inside."""
    parts = (ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    return len(parts) - 1, -sum(p.count("}") for p in parts[::2]), -sum(p.count("}") for p in parts[1::2])


def block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block, whose pieces come one after another: the parity of its quotes, its depth's change in both cases, a file's first piece."""
    at, out = None, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)

    names = [c.split()[0] for c in _SUMS.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for n, c in zip(names, _SUMS.split(", "))])
    for batch in batches:
        for file, block, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != at:
                at = file, block
                out.append([file, block, 0, 0, 0, piece if block == 0 else None, 0])
            row = out[-1]
            if row[6] or block:  # an opening brace before it
                row[3 + row[2]] += 1
            quotes, outside, inside = _depths(piece)
            same = row[2] == 0
            row[3] += outside if same else inside
            row[4] += inside if same else outside
            row[2] = (row[2] + quotes) % 2
            row[6] += 1
    yield rows()


def _starts(sums: DataFrame) -> DataFrame:
    """(file, block, inside, depth, root) at the beginning of each block; a row a block. An unfinished document is an error."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = Window.partitionBy("file").orderBy("block")
    inside = F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2
    rows = sums.withColumn("inside", inside).withColumn("deeper", F.when(F.col("inside") == 1, F.col("deeper_in")).otherwise(F.col("deeper_out")))
    rows = rows.withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)))
    rows = rows.withColumn("root", F.regexp_replace(F.first("first").over(ends), r"[\s\x{FEFF}]", "")).withColumn("last", F.lead("block").over(ends).isNull())
    unfinished = F.col("last") & ((F.col("depth") + F.col("deeper") != 0) | ((F.col("inside") + F.col("parity")) % 2 == 1))
    wrong = unfinished | ~F.coalesce(F.col("root"), F.lit("?")).isin("", "[", "[]")
    return rows.select(*_BLOCK, F.when(wrong, F.raise_error(F.lit(INVALID)).cast("long")).otherwise(F.col("inside")).alias("inside"), "depth", "root")


class _Records:
    """The records of one block, from what is known of its beginning."""

    def __init__(self, inside: bool, depth: int, array: bool, first: bool):
        self.inside, self.depth, self.array, self.first = inside, depth, array, first
        self.level = 1 if array else 2
        self.text = [] if depth >= self.level else None  # of the open record
        self.kind, self.place, self.pieces = GOES_ON, 0, 0
        self.between = None if not first else ""  # what precedes the next record; unknown at the start of a later block

    def feed(self, piece: str) -> Iterator[tuple[int, int, str]]:
        """(place, kind, text) of the records that end in the piece."""
        if self.pieces or not self.first:
            if not self.inside:
                self.depth += 1
                if self.depth == self.level:
                    self._begin()
            self._keep("{")
        self.pieces += 1
        at = begun = 0
        if self.inside:
            rest = REST.match(piece)
            self.inside, at = not rest[1], rest.end()
        for token in TOKEN.finditer(piece, at):
            if token[0] != "}":
                self.inside = not token[1]
                continue
            self.depth -= 1
            if self.depth == self.level - 1:
                self.text.append(piece[begun : token.end()])
                yield self.place, self.kind, "".join(self.text)
                self.text, self.between, begun = None, "", token.end()
        self._keep(piece[begun:])

    def _begin(self) -> None:
        before = self.between
        if before is not None and not before.rstrip().endswith(("[", ",") if self.array else ",") and not ARRAY.search(before):
            raise ValueError(INVALID)
        self._check()
        self.text, self.kind, self.place = [], WHOLE, self.pieces

    def _keep(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)
        else:
            self.between = (self.between or "") + text

    def _check(self) -> None:
        if self.between and LONE.search(self.between):  # the document is a record itself
            raise ValueError(INVALID)

    def rest(self) -> Iterator[tuple[int, int, str]]:
        """The record that the block's end leaves open."""
        self._check()
        if self.text is not None:
            yield self.place, OPENED if self.kind == WHOLE else GOES_ON, "".join(self.text)


def block_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, at, kind, text) from pieces with the state of their block's beginning, blocks one after another."""
    at, records = None, None
    names = ["file", "block", "at", "kind", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, types)], names)
    for batch in batches:
        out = []
        for file, block, inside, depth, root, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != at:
                if records:
                    out += [(*at, *r) for r in records.rest()]
                at, records = (file, block), _Records(inside == 1, depth, root.startswith("["), block == 0)
            out += [(file, block, *r) for r in records.feed(piece)]
        yield made(out)
    if records:
        yield made([(*at, *r) for r in records.rest()])


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of a JSON document or a folder of such; `seq` is their order, by file name and place.

    Members of an object other than `transactions` may not hold objects; an object without it
    is empty, as is an empty file. A record may hold objects. A document that ends early, is
    none, holds what are no records or is a record itself is an error.
    """
    sums = scratch(_pieces(spark, path).mapInArrow(block_sums, _SUMS).where("file IS NOT NULL"), "blocks")
    starts = scratch(_starts(sums), "starts")  # a row a block
    pieces = _pieces(spark, path).join(F.broadcast(starts), list(_BLOCK)).select(*_BLOCK, "inside", "depth", "root", "value")
    found = scratch(pieces.mapInArrow(block_records, _FOUND), "records")
    parted = found.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind_order").rowsBetween(Window.unboundedPreceding, 0)
    parted = parted.withColumn("kind_order", F.when(F.col("kind") == GOES_ON, 0).otherwise(1)).withColumn("record", F.sum("kind_order").over(order))
    part = F.struct("block", "kind_order", "at", "text")
    joined = parted.groupBy("file", "record").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = joined.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"), F.array_join("parts.text", "").alias("text"))
    records = found.where(F.col("kind") == WHOLE).select("file", "block", "at", "text").unionByName(joined)
    files = F.array(*[F.lit(f) for f in sorted(r.file for r in sums.select("file").distinct().collect())]).cast("array<string>")
    parsed = records.withColumn("t", F.from_json("text", TRANSACTION))
    known = F.coalesce("t.id", "t.type", F.col("t.amountSantim").cast("string")).isNotNull()
    row = F.when(known, F.col("t")).otherwise(F.raise_error(F.lit(INVALID)).cast(TRANSACTION))
    return parsed.select(((F.array_position(files, F.col("file")) - 1) * PLACES + F.col("block") + F.col("at")).alias("seq"), row.alias("t")).select("seq", "t.*")


def write_document(txns: DataFrame, path: str) -> None:
    """All transactions, newest first, as the one JSON document `path`.

    Rows are sorted and written by many tasks, each its range as one line of the document. A
    single file has a single writer, which sorts nothing: it copies these lines one after
    another, PIECE_ROWS rows at a time. A failed write leaves no file.
    """
    fields = [n for n in TRANSACTION.names if n in txns.columns]
    order = [F.desc("date"), F.asc("id")]
    lines = txns.select("date", "id", F.to_json(F.struct(*fields)).alias("value")).orderBy(*order).select("value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([",".join(batch.column(0).slice(at, PIECE_ROWS).to_pylist())], pa.string())], ["value"])

    spark = txns.sparkSession
    ranges, parts = scratch_path(spark, "ranges"), scratch_path(spark, "document")
    lines.mapInArrow(run, "value string").write.option("maxRecordsPerFile", 0).text(ranges)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = lambda fs, folder: sorted(str(s.getPath()) for s in fs.listStatus(at(folder)) if s.getPath().getName().startswith("part-") and s.getLen())
    found = files(at(ranges).getFileSystem(spark._jsc.hadoopConfiguration()), ranges)
    _write_one(spark, found, parts)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    written = files(fs, parts)
    draft = at(f"{path}.{parts.rsplit('-', 1)[1]}")
    if len(written) != 1 or not fs.rename(at(written[0]), draft):
        raise OSError(f"{path} was not written")
    fs.delete(at(path), False)
    if not fs.rename(draft, at(path)):
        raise OSError(f"{path} was not written")


def _write_one(spark: SparkSession, files: list[str], folder: str) -> None:
    """One text file with the lines of these files, in their order, as a document's records."""

    def document(lines: Iterator[str]) -> Iterator[str]:
        yield '{"version":1,"transactions":['
        for at, line in enumerate(lines):
            yield "," + line if at else line
        yield "]}"

    sc = spark.sparkContext
    lines = sc.textFile(",".join(files)) if files else sc.parallelize([], 1)
    lines.coalesce(1).mapPartitions(document).saveAsTextFile(folder)
